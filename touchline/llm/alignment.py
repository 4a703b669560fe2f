"""Alignment of two tokenizers' tokens by lockstep merging.

Both token streams of a text cover the same bytes. All texts of a slice are
merged at once: one state vector holds a pointer into each stream for every
text still running; a step links the two tokens under the pointers, notes a cut
where both end at the same byte, and moves on whichever token ends first (both
at a cut). Lanes that are done are compacted away. A long text is dealt to
several lanes of :data:`LANE` first-stream tokens: a lane starts at the other
stream's token that holds its first byte, so no link is made twice and the
number of steps is bounded.

Link counts over the corpus (how many documents hold an id pair linked) are
summed by slice before they are shuffled. Each slice then gets the counts of
the pairs it holds and nothing else, so no table is broadcast and no key is
hotter than the number of slices.

Tokens are the libraries' own. Texts of common signs get their first-stream ids
from a faster library with the ranks of the same vocabulary: merging by rank of
the joined bytes equals merging by the list of pairs where every token is what
its own bytes merge to (a region that no merge has crossed yet merges as if it
stood alone), which a test checks for all of the vocabulary. Other texts go to
the vocabulary's own library, whose letters may follow another Unicode version.

Defined cases: null and empty texts, and texts whose joined token bytes differ
from a space and the text (for instance those with U+2581), have no tokens.
Each row is a document, also a repeated one or one with a null id. Special
tokens' strings are plain text. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl, frame, rows_of, slices, stored

META = "▁"
#: First-stream tokens of a lane.
LANE = 512
#: Text bytes merged at a time.
SLICE = 4 << 20
#: Signs that are letter, mark or white space alike in every Unicode version.
SURE = re.compile("[\t\n\r -~À-ɏ–—‘’“”…一-龥]*")


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Tokenizers:
    """The two tokenizers with the bytes of every id."""

    _made: dict[tuple[str, str], "Tokenizers"] = {}

    def __init__(self, a_path: str, b_path: str):
        import os

        from public_tokenizers import PATTERN as split

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(META, " ").encode())
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        ranks = {self.a_bytes[i]: i for token, i in vocab.items() if token not in special}
        self.quick = tiktoken.Encoding("a", pat_str=split, mergeable_ranks=ranks, special_tokens={})
        # an id as text with the sign that follows it: inside a group, at its end
        self.a_text = np.array([f"{i}{s}" for s in ",|" for i in range(self.a_size.size)], object)
        self.b_text = np.array([f"{i}{s}" for s in ",;" for i in range(self.b_size.size)], object)

    @classmethod
    def of(cls, a_path: str, b_path: str) -> "Tokenizers":
        if (a_path, b_path) not in cls._made:
            cls._made[a_path, b_path] = cls(a_path, b_path)
        return cls._made[a_path, b_path]

    def _first(self, texts: list[str]) -> list[np.ndarray]:
        """First-stream ids of a space and each text."""
        sure = [SURE.fullmatch(t) is not None for t in texts]
        rest = iter(self.a.encode_batch_fast([" " + t for t, s in zip(texts, sure) if not s], add_special_tokens=False))
        return [self.quick.encode_to_numpy(" " + t, disallowed_special=()) if s else np.array(next(rest).ids, np.uint32)
                for t, s in zip(texts, sure)]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of each text in both streams; a text that its tokens do not spell
        has none."""
        a_bytes, b_bytes = self.a_bytes, self.b_bytes
        none = np.empty(0, np.uint32)
        out_a, out_b = self._first(texts), []
        for i, (text, ids) in enumerate(zip(texts, self.b.encode(texts, num_threads=1))):
            want = b" " + text.encode()
            if text and b"".join([b_bytes[x] for x in ids]) == want and b"".join([a_bytes[x] for x in out_a[i].tolist()]) == want:
                out_b.append(np.array(ids, np.uint32))
            else:
                out_a[i] = none
                out_b.append(none)
        return out_a, out_b


def _starts(sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(sizes.size + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


def lockstep(a_end: np.ndarray, b_end: np.ndarray, a_of: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, ...]:
    """Merge token streams given by the byte at which each token ends.

    The streams of all texts stand one after the other; ``a_of`` holds where
    each text's tokens start in ``a_end``, and the end. Returns links and cuts
    as indices ``(link_a, link_b, cut_a, cut_b)``: links by step, cuts in order.
    """
    first = np.concatenate([np.arange(x, y, lane) for x, y in zip(a_of[:-1], a_of[1:])] or [np.empty(0, np.int64)]).astype(np.int64)
    stop = np.minimum(first + lane, a_of[np.searchsorted(a_of, first, side="right")])
    a = first
    b = np.searchsorted(b_end, np.where(a > 0, a_end[a - 1], 0) if a.size else a, side="right")
    link_a, link_b, cut_a, cut_b = [], [], [], []
    while a.size:
        link_a.append(a)
        link_b.append(b)
        x, y = a_end[a], b_end[b]
        both = x == y
        cut_a.append(a[both])
        cut_b.append(b[both])
        a = a + (x <= y)
        b = b + (y <= x)
        live = a < stop
        if not live.all():
            a, b, stop = a[live], b[live], stop[live]

    def joined(parts: list) -> np.ndarray:
        return np.concatenate(parts) if parts else np.empty(0, np.int64)

    return joined(link_a), joined(link_b), np.sort(joined(cut_a)), np.sort(joined(cut_b))


class Merged:
    """A slice of texts: ids of both streams, links and cuts."""

    def __init__(self, model: Tokenizers, texts: list[str]):
        a, b = model.encode(texts)
        self.n_a, self.n_b = np.array([x.size for x in a], np.int64), np.array([x.size for x in b], np.int64)
        self.a_of, self.b_of = _starts(self.n_a), _starts(self.n_b)
        self.a = np.concatenate(a).astype(np.int64) if a else np.empty(0, np.int64)
        self.b = np.concatenate(b).astype(np.int64) if b else np.empty(0, np.int64)
        a_end, b_end = np.cumsum(model.a_size[self.a]), np.cumsum(model.b_size[self.b])
        self.link_a, self.link_b, self.cut_a, self.cut_b = lockstep(a_end, b_end, self.a_of)
        self.cut_of = np.searchsorted(self.cut_a, self.a_of)  # cuts of text i: cut_of[i]:cut_of[i + 1]
        self.model = model

    def groups(self) -> list[str]:
        """Ids by group, ``a1,a2|b1;a3|b2,b3``, of each text."""
        model, n = self.model, self.a.size + self.b.size
        text = np.empty(n, object)
        end = np.zeros(self.a.size, np.int64)
        end[self.cut_a] = 1
        # groups before a token; ids of a group stand together, the first stream's before the other's
        before = np.cumsum(end) - end
        b_before = np.concatenate(([0], self.cut_b + 1))  # second-stream tokens up to each cut
        text[np.arange(self.a.size) + b_before[before]] = model.a_text[end * model.a_size.size + self.a]
        end = np.zeros(self.b.size, np.int64)
        end[self.cut_b] = 1
        before = np.cumsum(end) - end
        a_until = self.cut_a + 1  # first-stream tokens up to the end of each group
        text[np.arange(self.b.size) + a_until[before] if self.b.size else np.empty(0, np.int64)] = model.b_text[end * model.b_size.size + self.b]
        at = self.a_of + self.b_of
        return ["".join(text[x:y].tolist())[:-1] for x, y in zip(at[:-1], at[1:])]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct id pairs of the slice (first id << 32 | second) with the
        documents that hold them, and by document the numbers of its pairs with
        their links: ``pairs, documents, starts, number, links``."""
        code = self.a[self.link_a] << 32 | self.b[self.link_b]
        pairs, number = np.unique(code, return_inverse=True)
        text = np.searchsorted(self.a_of, self.link_a, side="right") - 1
        held, links = np.unique(text * max(1, pairs.size) + number, return_counts=True)
        number = held % max(1, pairs.size)
        starts = np.searchsorted(held, np.arange(self.n_a.size + 1) * max(1, pairs.size))
        return pairs, np.bincount(number, minlength=pairs.size), starts, number, links

    def links_of(self) -> np.ndarray:
        """Links of each text."""
        text = np.searchsorted(self.a_of, self.link_a, side="right") - 1
        return np.bincount(text, minlength=self.n_a.size)


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, a_ids, b_ids, links, groups`` of each row's whole text: ids of
    both streams, links as ``struct<a, b>`` of token positions in order, and
    for each group the positions one past its last tokens."""
    rows = rows_of(docs, id_col, text_col)
    pair = pa.struct([("a", pa.int32()), ("b", pa.int32())])

    def listed(starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays(
            [pa.array(a, pa.int32()), pa.array(b, pa.int32())], fields=list(pair)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Tokenizers.of(a_path, b_path)
        for batch in slices(batches):
            m = Merged(model, batch.column(1).to_pylist())
            order = np.lexsort((m.link_b, m.link_a))
            la, lb = m.link_a[order], m.link_b[order]
            text = np.searchsorted(m.a_of, la, side="right") - 1
            of_cut = np.searchsorted(m.a_of, m.cut_a, side="right") - 1
            yield frame(batch, ["doc_id"],
                        a_ids=pa.ListArray.from_arrays(pa.array(m.a_of, pa.int32()), pa.array(m.a, pa.int32())),
                        b_ids=pa.ListArray.from_arrays(pa.array(m.b_of, pa.int32()), pa.array(m.b, pa.int32())),
                        links=listed(np.searchsorted(la, m.a_of), la - m.a_of[text], lb - m.b_of[text]),
                        groups=listed(m.cut_of, m.cut_a + 1 - m.a_of[of_cut], m.cut_b + 1 - m.b_of[of_cut]))

    return rows.mapInArrow(run, f"doc_id {ddl(rows, 'doc_id')}, a_ids array<int>, b_ids array<int>, "
                                "links array<struct<a:int,b:int>>, groups array<struct<a:int,b:int>>")


def _merged(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> DataFrame:
    """One row a document with its digest, and its id pairs as 32-bit numbers
    (differences) into the pairs of its slice, which stand in the slice's first row."""
    rows = rows_of(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Tokenizers.of(a_path, b_path)
        name = TaskContext.get().partitionId() << 32
        sha = hashlib.sha256
        for batch in slices(batches, most=SLICE):
            m = Merged(model, batch.column(1).to_pylist())
            pairs, held, starts, number, links = m.pairs()
            step = np.diff(number, prepend=0)
            step[starts[:-1][np.diff(starts) > 0]] = number[starts[:-1][np.diff(starts) > 0]]
            step, links = step.astype("<u4"), links.astype("<u4")
            rest = [None] * (batch.num_rows - 1)
            yield frame(batch, ["doc_id"], slice=pa.array(np.full(batch.num_rows, name)), n_a=pa.array(m.n_a), n_b=pa.array(m.n_b),
                        n_groups=pa.array(np.diff(m.cut_of)), n_links=pa.array(m.links_of()),
                        groups_sha256=pa.array([sha(g.encode()).hexdigest() if n else "" for g, n in zip(m.groups(), m.n_a)]),
                        step=pa.array([step[x:y].tobytes() for x, y in zip(starts[:-1], starts[1:])], pa.binary()),
                        links=pa.array([links[x:y].tobytes() for x, y in zip(starts[:-1], starts[1:])], pa.binary()),
                        pairs=pa.array([pairs, *rest], pa.list_(pa.int64())), held=pa.array([held, *rest], pa.list_(pa.int64())))
            name += 1

    return rows.mapInArrow(run, f"doc_id {ddl(rows, 'doc_id')}, slice long, n_a long, n_b long, n_groups long, n_links long, "
                                "groups_sha256 string, step binary, links binary, pairs array<long>, held array<long>")


def _counts(merged: DataFrame) -> DataFrame:
    """``pair, n_docs, best``: documents that hold a pair linked, and whether no
    pair of the same first id has more (an id has at most as many pairs as the
    second vocabulary has ids)."""
    from pyspark.sql import Window

    summed = (merged.filter("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "held")).alias("p"))
              .groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.held").alias("n_docs")))
    of_first = Window.partitionBy(F.shiftright("pair", 32))
    return summed.select("pair", "n_docs", (F.col("n_docs") == F.max("n_docs").over(of_first)).alias("best"))


def pair_counts(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``a_id, b_id, n_docs, best`` of every id pair linked anywhere."""
    found = _counts(stored(_merged(docs, a_path, b_path, id_col, text_col)))
    return found.select(F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b_id"), "n_docs", "best")


def link_support(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256``, all but the last long."""
    merged = stored(_merged(docs, a_path, b_path, id_col, text_col))
    known = _counts(merged)
    asked = merged.filter("pairs IS NOT NULL").select("slice", F.posexplode("pairs").alias("number", "pair"))
    answers = asked.join(known, "pair").select(F.col("slice").alias("of"), "number", "n_docs", "best")
    counted = ["n_a", "n_b", "n_groups", "n_links"]

    def judge(rows: pa.Table, found: pa.Table) -> pa.Table:
        n_docs, best = np.zeros(found.num_rows, np.int64), np.zeros(found.num_rows, np.int64)
        number = found["number"].to_numpy()
        n_docs[number], best[number] = found["n_docs"].to_numpy(), found["best"].to_numpy().astype(np.int64)
        n_best, total = [], []
        for step, links in zip(rows["step"].to_pylist(), rows["links"].to_pylist()):
            own, times = np.cumsum(np.frombuffer(step, "<u4").astype(np.int64)), np.frombuffer(links, "<u4").astype(np.int64)
            n_best.append(int(best[own] @ times))
            total.append(int(n_docs[own] @ times))
        return rows.select(["doc_id", *counted, "groups_sha256"]).append_column("n_best", pa.array(n_best, pa.int64())) \
            .append_column("count_sum", pa.array(total, pa.int64()))

    left = merged.select("slice", "doc_id", *counted, "groups_sha256", "step", "links")
    schema = f"doc_id {ddl(merged, 'doc_id')}, {', '.join(f'{c} long' for c in counted)}, groups_sha256 string, n_best long, count_sum long"
    return left.groupBy("slice").cogroup(answers.groupBy("of")).applyInArrow(judge, schema).select(
        "doc_id", *counted, "n_best", "count_sum", "groups_sha256")


def op12_alignment(docs: DataFrame) -> DataFrame:
    return link_support(docs, byte_bpe_path(), piece_path())
