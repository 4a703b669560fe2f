"""Alignment of tokens against a plain version over the libraries' own ids."""
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from touchline.llm import alignment


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.byte_bpe_path())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.piece_path())


def byte_alphabet():
    shown = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    table, n = {}, 256
    for b in range(256):
        table[chr(b) if b in shown else chr(n)] = b
        n += b not in shown
    return table


def tokens(libraries, text):
    """[(id, bytes)] of both streams, or two empty lists."""
    a, b = libraries
    if not text:
        return [], []
    table = byte_alphabet()
    own = a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(table[c] for c in t)) for i, t in zip(own.ids, own.tokens)]
    right = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    want = (" " + text).encode()
    if b"".join(t for _, t in left) != want or b"".join(t for _, t in right) != want:
        return [], []
    return left, right


def ranges(side):
    out, at = [], 0
    for i, t in side:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


def plain(libraries, rows):
    held, docs = defaultdict(set), []
    for r, (d, text) in enumerate(rows):
        left, right = map(ranges, tokens(libraries, text))
        ends = sorted({e for _, _, e in left} & {e for _, _, e in right})
        links, j = [], 0
        for i, s, e in left:
            while j and right[j][1] > s:
                j -= 1
            while right[j][2] <= s:
                j += 1
            k = j
            while k < len(right) and right[k][1] < e:
                links.append((i, right[k][0]))
                k += 1
        groups, x, y = [], 0, 0
        for end in ends:
            own, other = [], []
            while x < len(left) and left[x][2] <= end:
                own.append(str(left[x][0]))
                x += 1
            while y < len(right) and right[y][2] <= end:
                other.append(str(right[y][0]))
                y += 1
            groups.append(",".join(own) + "|" + ",".join(other))
        for p in links:
            held[p].add(r)
        docs.append((d, len(left), len(right), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if left else ""))
    n = {p: len(s) for p, s in held.items()}
    most = defaultdict(int)
    for (a, _), c in n.items():
        most[a] = max(most[a], c)
    return Counter((d, na, nb, ng, len(links), sum(n[p] == most[p[0]] for p in links), sum(n[p] for p in links), h)
                   for d, na, nb, ng, links, h in docs)


@pytest.mark.parametrize("name", ["small_docs", "odd_docs"])
def test_alignment(request, texts, libraries, name):
    docs = request.getfixturevalue(name)
    got = alignment.op12_alignment(docs).collect()
    assert Counter(tuple(r) for r in got) == plain(libraries, texts(docs))


SIGNS = [*"abcdefghijklmnop  \n\n\t▁éß漢😀.,'-#0123THE", "the", "ing", "   ", "́", "<s>", "<0x0A>", "\x00", "aaaa", "----", " ", "\x85", " ",
         "<|endoftext|>", "'s", "'LL", "ǅ", "ɏ", "×", "᠎", "​", "٣", "Ⅷ", "²", "\x1c", "\r\n", "ﬁ"]


def test_ids_are_those_of_the_libraries(libraries, small_docs):
    """Both ways to the first stream's ids give those of its own library."""
    model, rng = alignment.Tokenizers.of(alignment.byte_bpe_path(), alignment.piece_path()), random.Random(6)
    texts = ["".join(rng.choices(SIGNS, k=rng.randint(1, 40))) for _ in range(4000)] + ["x" * 3000, "a b " * 2000, " lead", "tail ", "Ā " * 50]
    texts += ["".join(rng.choices([s for s in SIGNS if alignment.SURE.fullmatch(s)], k=rng.randint(1, 40))) for _ in range(4000)]
    texts += [r.text for r in small_docs.collect()]
    a, b = model.encode(texts)
    assert 3000 < sum(alignment.SURE.fullmatch(t) is not None for t in texts) < len(texts) - 3000
    for text, x, y in zip(texts, a, b):
        left, right = tokens(libraries, text)
        assert x.tolist() == [i for i, _ in left] and y.tolist() == [i for i, _ in right]


def test_every_token_is_what_its_bytes_merge_to():
    model = alignment.Tokenizers.of(alignment.byte_bpe_path(), alignment.piece_path())
    for spelt, i in model.quick._mergeable_ranks.items():
        assert model.quick._core_bpe.encode_single_piece(spelt) == [i]
    assert len(model.quick._mergeable_ranks) == 50256


@pytest.mark.parametrize("lane", [1, 3, 10**6])
def test_lockstep(lane):
    """Lanes of any length give the links and cuts of the overlap rule."""
    rng = np.random.default_rng(lane)
    a_end, b_end, a_of, at = [], [], [0], 0
    for _ in range(60):
        size = int(rng.integers(0, 40))
        inner = np.arange(1, size)
        for ends, share in ((a_end, 0.3), (b_end, 0.5)):
            ends += [at + int(i) for i in inner[rng.random(inner.size) < share]] + ([at + size] if size else [])
        at += size
        a_of.append(len(a_end))
    la, lb, ca, cb = alignment.lockstep(np.array(a_end), np.array(b_end), np.array(a_of), lane)
    begins = [0, *a_end[:-1]], [0, *b_end[:-1]]
    want = {(i, j) for i in range(len(a_end)) for j in range(len(b_end)) if begins[0][i] < b_end[j] and begins[1][j] < a_end[i]}
    assert set(zip(la.tolist(), lb.tolist())) == want and len(la) == len(want)
    ends = sorted(set(a_end) & set(b_end))
    assert [a_end[i] for i in ca] == ends and [b_end[i] for i in cb] == ends


def test_align(odd_docs, texts, libraries):
    paths = alignment.byte_bpe_path(), alignment.piece_path()
    got = {}
    for r in alignment.align(odd_docs, *paths).collect():
        got.setdefault(r.doc_id, []).append(r)
    for d, text in texts(odd_docs):
        left, right = tokens(libraries, text)
        r = next(x for x in got[d] if x.a_ids == [i for i, _ in left])
        assert r.b_ids == [i for i, _ in right] and len(r.links) == len({(x.a, x.b) for x in r.links})
        if left:
            assert r.groups[-1] == (len(left), len(right)) and [tuple(x) for x in r.links] == sorted(tuple(x) for x in r.links)
        a_end, b_end = [e for _, _, e in ranges(left)], [e for _, _, e in ranges(right)]
        assert [a_end[g.a - 1] for g in r.groups] == [b_end[g.b - 1] for g in r.groups] == sorted(set(a_end) & set(b_end))


def test_pair_counts(odd_docs, no_docs):
    paths = alignment.byte_bpe_path(), alignment.piece_path()
    rows = alignment.pair_counts(odd_docs, *paths).collect()
    assert len({(r.a_id, r.b_id) for r in rows}) == len(rows) > 100
    most = defaultdict(int)
    for r in rows:
        most[r.a_id] = max(most[r.a_id], r.n_docs)
    assert all(r.best == (r.n_docs == most[r.a_id]) for r in rows)
    assert alignment.op12_alignment(no_docs).count() == 0 and alignment.pair_counts(no_docs, *paths).count() == 0
