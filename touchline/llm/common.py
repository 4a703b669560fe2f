"""Helpers shared by the training-data operators.

Words are maximal runs of characters other than space and U+0009..U+000D, the
bytes at which ``bytes.split()`` splits UTF-8 text. Python stages read Arrow
batches in slices of bounded size, so a worker's memory does not follow the
batch size the session sets.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: A word, as a regular expression for Spark SQL and Python.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes handled at a time by a Python stage (one text may be longer).
SLICE_BYTES = 1 << 20
#: Multiplier of the rolling word hash; odd, so it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15 | 1


# ---------------------------------------------------------------- intermediates

def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: the plan
    restarts from files that every executor can reach."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ddl(df: DataFrame, column: str) -> str:
    """Type of a column as a schema string."""
    return df.schema[column].dataType.simpleString()


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, text)`` of a table; a null text counts as empty. Any other
    column, whatever its name, is left behind."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


# ---------------------------------------------------------------- Arrow slices

def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``most`` bytes in each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.array(pc.binary_length(col).fill_null(0), dtype=np.int64)
        part = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
        del batch, col  # before the next one is read


def raw(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """A string column as UTF-8 bytes."""
    col = batch.column(batch.schema.get_field_index(column))
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def frame(batch: pa.RecordBatch, keep: list[str], **columns) -> pa.RecordBatch:
    """Columns of ``batch`` plus new ones."""
    own = {k: batch.column(batch.schema.get_field_index(k)) for k in keep}
    return pa.RecordBatch.from_pydict(own | columns)


class Recent(dict):
    """A dict that computes missing values and holds at most ``2 * most``
    entries: a full generation becomes the old one, and old entries that are
    asked for again move back."""

    def __init__(self, make, most: int = 150_000):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.keep(key, value)
        return value

    def known(self, keys: set) -> tuple[dict, list]:
        """The values held for some of the keys, and the other keys; old
        entries move back."""
        missing = keys.difference(self)
        found = {key: self[key] for key in keys - missing}
        new = missing.difference(self.old)
        moved = {key: self.old[key] for key in missing - new}
        self.keep_all(list(moved), list(moved.values()))
        return found | moved, list(new)

    def keep(self, key, value) -> None:
        if len(self) >= self.most:
            self.turn()
        self[key] = value

    def keep_all(self, keys: list, values: list) -> None:
        if len(self) + len(keys) > self.most:
            self.turn()
        self.update(zip(keys, values))

    def turn(self) -> None:
        self.old = {}  # goes before the copy is made, so that never three tables are held
        self.old = dict(self)
        self.clear()
        trim()


_SERVING: list[dict] = []


def serve(made: dict | None = None) -> None:
    """Note that this worker now works for the operator that keeps its lookups in
    ``made`` (None: one without lookups). A Python worker outlives its task and
    serves one operator after the other: what another one kept goes."""
    if _SERVING and _SERVING[0] is not made:
        _SERVING.pop().clear()
        gc.collect()  # a lookup and its maker refer to each other
        trim()
    if made is not None and not _SERVING:
        _SERVING.append(made)


def trim() -> None:
    """Give freed memory back to the system, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


# ---------------------------------------------------------------- word hashes

def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads the bits of a 64-bit word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int, base: int, kind: str) -> np.ndarray:
    """base^0 .. base^n modulo 2^64, kept between calls for usual sizes."""
    have = _POWERS[kind]
    if have.size <= n:
        have = np.empty(n + 1, np.uint64)
        have[0] = 1
        filled = 1
        step = base
        while filled <= n:  # doubling: powers[filled:2*filled] = powers[:filled] * base^filled
            take = min(filled, n + 1 - filled)
            have[filled:filled + take] = have[:take] * np.uint64(step)
            filled += take
            step = step * step % (1 << 64)
        if n <= 8 * SLICE_BYTES:
            _POWERS[kind] = have
    return have[:n + 1]


_INVERSE = pow(BASE, -1, 1 << 64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, in order, and the word count of
    each text. Prefix sums of a polynomial over the bytes give each word's hash."""
    joined = b"\n".join(texts)
    data = np.frombuffer(joined, np.uint8)
    if not data.size:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    space = _IS_SPACE[data]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers(data.size, BASE, "up"), _powers(data.size, _INVERSE, "down")
    total = np.empty(data.size + 1, np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:data.size], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    firsts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    at = np.searchsorted(start, firsts)
    return h, np.diff(at)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive words (n - k + 1 of them)."""
    n = words.size - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _powers(words.size, BASE, "up"), _powers(words.size, _INVERSE, "down")
    total = np.empty(words.size + 1, np.uint64)
    total[0] = 0
    np.cumsum(words * up[:words.size], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[:n])


# ---------------------------------------------------------------- components

def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links(a, b)`` (64-bit integers).

    Alternating large-star and small-star steps: each round every node's
    larger neighbours, then its smaller ones, are re-tied to the least node
    known. Minima are pre-aggregated before the shuffle, each round is cut by a
    written table, and the loop ends when a round changes nothing. Returns
    ``(node, root)`` for every node in a link; ``root`` is the least node.
    """
    def star(edges: DataFrame) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))

    def tied(edges: DataFrame) -> DataFrame:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return least.select("a", F.col("m").alias("b")).unionByName(moved).distinct()

    def mark(edges: DataFrame):
        return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .filter("a <> b").distinct())
    seen = mark(edges)
    while seen[0]:
        edges = stored(tied(star(edges).filter("a <> b").distinct()))
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
