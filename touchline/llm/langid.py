"""Language ID by unigram pieces, with the segmentation summed out.

Each language has a probability for every piece of a fixed public vocabulary.
The score of a word is the sum over all its segmentations into pieces, found
by the forward algorithm, for all languages at once; a text's score is the sum
of its words' log scores. The probabilities are fitted by EM (forward-backward
expected counts) on word counts of a bounded, labelled sample of documents.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Recent, serve, slices, stored
from .pieces import META, Pieces, model_path

#: Labelled documents of each language that the fit draws (about, by hash).
SAMPLE = 1_500
ROUNDS, SMOOTH = 3, 0.1
#: Probability of a character that no piece covers.
UNKNOWN_CHAR = 1e-8
#: Letters scored together; a longer run of letters is scored in parts.
PART = 32
_RUN = re.compile(r"[^\W\d_]+")


def letter_runs(text: str) -> list[str]:
    """Lower-case runs of word characters of a text (see :func:`parts`)."""
    return _RUN.findall(text.lower())


def parts(run: str) -> list[str]:
    """The letters of a run, in parts of bounded length."""
    letters = run if run.isalpha() else "".join(filter(str.isalpha, run))
    return [letters[i:i + PART] for i in range(0, len(letters), PART)]


class Lattice:
    """All piece matches of many words, and sums over their segmentations."""

    _automata: dict[str, tuple[ahocorasick.Automaton, list[str]]] = {}

    def __init__(self, path: str):
        if path not in self._automata:
            chosen = [p for p in Pieces.of(path).rank if p == p.lower() and p.lstrip(META).isalpha() and len(p.lstrip(META)) == len(p.replace(META, ""))]
            found = ahocorasick.Automaton()
            for i, p in enumerate(chosen):
                found.add_word(p, len(p) << 32 | i)
            found.make_automaton()
            self._automata[path] = found, chosen
        self.automaton, self.pieces = self._automata[path]

    def matches(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """(first, stop, piece, step) of the matches in the words written one after
        the other, sorted by the stop's place in its word; each word's start
        and end. Places lie between characters."""
        text = "\n".join(META + w for w in words)
        flat = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        last, size, piece = flat[:, 0], flat[:, 1] >> 32, flat[:, 1] & 0xFFFFFFFF
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        begin = np.cumsum(np.concatenate(([0], sizes[:-1] + 1)))
        stop = last + 1
        place = np.arange(int(sizes.sum()) + len(words)) - np.repeat(begin, sizes + 1)
        step = place[last] + 1
        order = np.argsort(step.astype(np.int16), kind="stable")
        return (stop - size)[order], stop[order], piece[order], step[order], begin, begin + sizes

    def forward(self, found: tuple, weights: np.ndarray) -> np.ndarray:
        """Sums over the ways to reach each place; ``weights`` per match (k x L)."""
        first, stop, _, step, begin, end = found
        longest = int((end - begin).max(initial=0))
        alpha = np.zeros((int(end.max(initial=0)) + 2, weights.shape[1]))
        alpha[begin] = 1.0
        cuts = np.searchsorted(step, np.arange(longest + 2))
        for j in range(1, longest + 1):
            here = begin[end - begin >= j] + j
            alpha[here] = alpha[here - 1] * UNKNOWN_CHAR
            a, b = cuts[j], cuts[j + 1]
            if a < b:
                at = stop[a:b]
                heads = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                alpha[at[heads]] += np.add.reduceat(alpha[first[a:b]] * weights[a:b], heads, axis=0)
        return alpha

    def backward(self, found: tuple, weights: np.ndarray) -> np.ndarray:
        """Sums over the ways from each place to its word's end."""
        first, stop, _, _, begin, end = found
        back = (end[np.searchsorted(begin, first, "right") - 1] - first)  # distance of the match's first place to the end
        order = np.lexsort((first, back))
        first, stop, weights, back = first[order], stop[order], weights[order], back[order]
        longest = int((end - begin).max(initial=0))
        beta = np.zeros((int(end.max(initial=0)) + 2, weights.shape[1]))
        beta[end] = 1.0
        cuts = np.searchsorted(back, np.arange(longest + 2))
        for j in range(1, longest + 1):
            here = end[end - begin >= j] - j
            beta[here] = beta[here + 1] * UNKNOWN_CHAR
            a, b = cuts[j], cuts[j + 1]
            if a < b:
                at = first[a:b]
                heads = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                beta[at[heads]] += np.add.reduceat(beta[stop[a:b]] * weights[a:b], heads, axis=0)
        return beta

    def log_scores(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """Log of each word's summed probability (words x languages)."""
        if not words:
            return np.zeros((0, table.shape[1]))
        found = self.matches(words)
        return np.log(self.forward(found, table[found[2]])[found[5]])

    def expected(self, words: list[str], langs: np.ndarray, counts: np.ndarray, table: np.ndarray) -> Counter:
        """Expected uses of each (language, piece) in counted words."""
        found = self.matches(words)
        first, stop, piece, _, begin, end = found
        owner = np.searchsorted(begin, first, "right") - 1
        weight = table[piece, langs[owner]][:, None]
        alpha, beta = self.forward(found, weight), self.backward(found, weight)
        total = alpha[end, 0][owner]
        uses = alpha[first, 0] * weight[:, 0] * beta[stop, 0] / total * counts[owner]
        cell = langs[owner] * len(self.pieces) + piece
        sums = np.bincount(cell, uses, minlength=0)
        some = np.flatnonzero(sums)
        return Counter(dict(zip(some.tolist(), sums[some].tolist())))


class Model:
    """Fitted probabilities: ``table`` (pieces x languages) and the languages' names."""

    def __init__(self, path: str, langs: list[str], table: np.ndarray):
        self.path, self.langs, self.table = path, langs, table
        self.digest = hashlib.sha256(table.tobytes() + repr(langs).encode()).hexdigest()


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE,
        rounds: int = ROUNDS, path: str | None = None) -> Model:
    """Fit on labelled documents that are not held out (a null id is held out).

    About ``sample`` documents of each language are drawn by a hash of the id:
    the one bound of the fit. Word counts stay in Spark; each EM round brings
    back one number per piece and language. No labelled row gives a model
    without languages.
    """
    path = path or model_path()
    spark = docs.sparkSession
    pool = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in pool.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model(path, [], np.zeros((0, 0)))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    bound = F.coalesce(*(F.when(F.col("lang") == l, F.lit(int(min(1.0, sample / sizes[l]) * (1 << 20)))) for l in langs))
    drawn = pool.filter(draw < bound).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve()
        for batch in slices(batches):
            seen: Counter = Counter()
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                number = langs.index(lang)
                for run, n in Counter(letter_runs(text)).items():
                    for part in parts(run):
                        seen[number, part] += n
            yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in seen], pa.int32()), "word": pa.array([k[1] for k in seen], pa.string()),
                                              "n": pa.array(list(seen.values()), pa.int64())})

    words = stored(drawn.mapInArrow(count, "lang int, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    size = len(Lattice(path).pieces)
    table = np.full((size, len(langs)), 1.0 / size)
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(table)  # pieces x languages: bounded by the vocabulary

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            serve()
            lattice = Lattice(path)
            for batch in batches:
                for at in range(0, batch.num_rows, 5000):
                    part = batch.slice(at, 5000)
                    own = lattice.expected(part.column(1).to_pylist(), part.column(0).to_numpy().astype(np.int64),
                                           part.column(2).to_numpy().astype(float), now.value)
                    yield pa.RecordBatch.from_pydict({"cell": pa.array(list(own), pa.int64()), "uses": pa.array(list(own.values()), pa.float64())})

        # summed as decimals, so the order of the parts does not show
        uses = words.mapInArrow(expect, "cell long, uses double").groupBy("cell").agg(F.sum(F.col("uses").cast("decimal(28,9)")).cast("double").alias("uses")).collect()
        counts = np.full((len(langs), size), SMOOTH)
        for r in uses:
            counts[r["cell"] // size, r["cell"] % size] += r["uses"]
        table = (counts / counts.sum(1, keepdims=True)).T.copy()
        now.unpersist()
    return Model(path, langs, table)


class Scorer:
    """Scores of texts under a model; tokens and runs of letters seen before are looked up."""

    _made: dict[str, "Scorer"] = {}

    def __init__(self, model: Model):
        self.model, self.lattice = model, Lattice(model.path)
        self.runs = Recent(lambda run: self.score([run])[0], 50_000)
        self.tokens = Recent(self.token, 75_000)

    @classmethod
    def of(cls, model: Model) -> "Scorer":
        serve(cls._made)
        if model.digest not in cls._made:
            cls._made.clear()
            cls._made[model.digest] = cls(model)
        return cls._made[model.digest]

    def score(self, runs: list[str]) -> list[bytes]:
        """Log score per language and the letter count of each run, as 32-bit floats."""
        cut = [parts(r) for r in runs]
        flat = [p for own in cut for p in own]
        each = np.concatenate([self.lattice.log_scores(flat, self.model.table), np.array([len(p) for p in flat], float).reshape(-1, 1)], 1)
        if len(flat) != len(runs) or not all(cut):
            whole = np.zeros((len(runs), each.shape[1]))
            np.add.at(whole, np.repeat(np.arange(len(runs)), [len(own) for own in cut]), each)
            each = whole
        data, width = each.astype("<f4").tobytes(), 4 * each.shape[1]
        return [data[i:i + width] for i in range(0, len(data), width)]

    def token(self, token: str) -> bytes:
        return self.summed(letter_runs(token), self.runs)

    def summed(self, own: list[str], runs: dict) -> bytes:
        """Summed scores of the runs of a token between white space."""
        if len(own) == 1:
            return runs[own[0]]
        parts_of = b"".join([runs[r] for r in own])
        return np.frombuffer(parts_of, "<f4").reshape(-1, len(self.model.langs) + 1).sum(0, dtype=np.float32).tobytes()

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs = self.model.langs
        cut = [(t or "").split() for t in texts]
        # a batch holds what it found in plain dicts: what a full lookup lets go is not scored again, run by run
        tokens, new = self.tokens.known({t for own in cut for t in own})
        runs_of = [letter_runs(t) for t in new]
        runs, fresh = self.runs.known({r for own in runs_of for r in own})
        for at in range(0, len(fresh), 5000):
            some = fresh[at:at + 5000]
            values = self.score(some)
            runs.update(zip(some, values))
            self.runs.keep_all(some, values)
        values = [self.summed(own, runs) for own in runs_of]
        tokens.update(zip(new, values))
        self.tokens.keep_all(new, values)
        names, scores = [], []
        for own in cut:
            sums = np.frombuffer(b"".join([tokens[t] for t in own]), "<f4").reshape(-1, len(langs) + 1).sum(0, dtype=float)
            if not langs or not own or sums[-1] == 0:
                names.append("und")
                scores.append(0.0)
                continue
            best = int(sums[:-1].argmax())
            rest = (sums[:-1] - sums[best]) / np.sqrt(sums[-1])
            names.append(langs[best])
            scores.append(float(1.0 / np.exp(rest).sum()))
        return names, scores


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """The table with two more columns: the likeliest language (ties: the first
    by name; ``und`` for a null text or one without a letter, and where the
    model has no language) and its score, a posterior tempered by the square
    root of the number of letters. A column of either name is replaced."""
    kept = docs.drop(lang_out, score_out)
    schema = T.StructType([*kept.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer.of(model) if model.langs else None
        for batch in slices(batches, text_col):
            texts = batch.column(names.index(text_col)).to_pylist()
            langs, scores = scorer(texts) if scorer else (["und"] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, lang_out, score_out])

    return kept.mapInArrow(run, schema)


def op6_language(docs: DataFrame) -> DataFrame:
    model = fit(docs)
    rows = docs.select("doc_id", "text")
    return predict(rows, model).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
