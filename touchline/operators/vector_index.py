"""A partitioned vector index: coarse cells, multi-probe search, exact re-ranking.

**Fit.** Spherical k-means on at most :data:`SAMPLE` entries (those of least
id hash). There are about as many cells as the square root of the entries, at
most :data:`MOST_CELLS`, so the centres may go to every task.

**Layout.** Every entry with a usable vector is stored in the folder of its
cell, a cell of many entries (or of many copies of one) in several parts by a
hash of the id. Nulls, vectors with a null or without a length are left out: they
have no distance to anything.

**Probes.** A question asks the cells whose centres are nearest to it. How many is
measured when the index is built: enough that, among the sample, the wanted share
of exact neighbours lies in the cells asked. More probes raise recall; all
cells give the exact answer.

**Search.** Distances inside the cells are exact. Few questions (at most
:data:`FEW`, counted first) go to the entries, which then are not shuffled; more
are dealt to the parts of the cells they ask, where each entry travels once for
every :data:`BLOCK` questions of its own cell, not once for every block of all questions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLE = 20_000
MOST_CELLS = 1_000
PART = 20_000
FEW = 2_000
BLOCK = 20_000
ROUNDS = 10
CALIBRATE = 500


def usable(vec: Column) -> Column:
    """Vectors that have a direction."""
    return vec.isNotNull() & ~F.exists(vec, lambda x: x.isNull()) & F.exists(vec, lambda x: x != 0)


def unit_rows(vectors) -> np.ndarray:
    mat = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return mat / np.linalg.norm(mat, axis=1, keepdims=True)


def _centres(mat: np.ndarray, n: int) -> np.ndarray:
    """Unit centres of ``n`` cells: Lloyd rounds by cosine from distinct rows."""
    _, first = np.unique(mat.round(12), axis=0, return_index=True)
    own = mat[np.sort(first)[:n]]
    for _ in range(ROUNDS):
        of = np.argmax(mat @ own.T, axis=1)
        total = np.zeros_like(own)
        np.add.at(total, of, mat)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        own = np.where(size > 0, total / np.where(size > 0, size, 1), own)
    return own


def _probes(mat: np.ndarray, centres: np.ndarray, k: int, want: float) -> tuple[int, float]:
    """Least number of cells to ask, and the share of neighbours it reaches in
    the sample."""
    asked = mat[:: max(1, len(mat) // CALIBRATE)][:CALIBRATE]
    near = np.argsort(-(asked @ mat.T), axis=1, kind="stable")[:, :k]
    cell = np.argmax(mat @ centres.T, axis=1)
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)  # of each cell, by question
    needed = np.sort(np.take_along_axis(place, cell[near], 1).ravel()) + 1
    probes = int(needed[min(needed.size - 1, int(np.ceil(want * needed.size)) - 1)])
    return probes, float((needed <= probes).mean())


@dataclass
class VectorIndex:
    """A stored index. ``entries`` holds the id, the vector, the kept columns,
    ``cell`` and ``part``."""

    entries: DataFrame
    centres: np.ndarray
    parts: np.ndarray  # parts of each cell
    probes: int
    reached: float  # share of neighbours in the asked cells, in the sample
    entry_id: str
    vec: str


def build(entries: DataFrame, path: str, entry_id: str = "entry_id", vec: str = "embedding", keep: tuple[str, ...] = (),
          k: int = 10, want: float = 0.97, sample: int = SAMPLE, cells: int | None = None, part: int = PART) -> None:
    """Write an index of ``entries`` to ``path``: the entries by cell, and the
    centres with what was measured. An empty table gives an index without cells."""
    spark = entries.sparkSession
    e = entries.where(usable(F.col(vec))).select(entry_id, vec, *keep)
    n = e.count()
    drawn = e.select(F.xxhash64(entry_id).alias("h"), vec).orderBy("h").limit(sample).toPandas()[vec] if n else []
    if not n:
        centres, probes, reached, parts = np.zeros((0, 0)), 0, 1.0, np.zeros(0, np.int64)
    else:
        mat = unit_rows(drawn)
        centres = _centres(mat, max(1, min(cells or int(np.ceil(np.sqrt(n))), MOST_CELLS, len(mat))))
        probes, reached = _probes(mat, centres, k, want)
        share = np.bincount(np.argmax(mat @ centres.T, axis=1), minlength=len(centres)) / len(mat)
        parts = np.maximum(1, np.ceil(share * n / part)).astype(np.int64)
    about = [(i, [float(x) for x in c], int(p), probes, reached) for i, (c, p) in enumerate(zip(centres, parts))]
    spark.createDataFrame(about, "cell int, centre array<double>, parts int, probes int, reached double").write.parquet(f"{path}/cells")

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                batch["cell"] = np.argmax(unit_rows(batch[vec]) @ centres.T, axis=1).astype(np.int32)
                yield batch

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in e.schema.fields)
    placed = e.mapInPandas(assign, f"{fields}, cell int")
    n_parts = F.element_at(F.array(*(F.lit(int(p)) for p in parts)), F.col("cell") + 1) if len(parts) else F.lit(1)
    placed = placed.withColumn("part", F.pmod(F.xxhash64(entry_id), n_parts).cast("int"))
    placed.repartition("cell", "part").write.partitionBy("cell").parquet(f"{path}/entries")


def load(spark: SparkSession, path: str, entry_id: str = "entry_id", vec: str = "embedding") -> VectorIndex:
    about = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # at most MOST_CELLS rows
    entries = spark.read.parquet(f"{path}/entries") if about else None
    return VectorIndex(entries, np.array([r.centre for r in about]), np.array([r.parts for r in about], np.int64),
                       about[0].probes if about else 0, about[0].reached if about else 1.0, entry_id, vec)


def top_of(mat_q: np.ndarray, mat_e: np.ndarray, ids: np.ndarray, k: int, allowed: np.ndarray | None = None,
           best: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distances and ids of the ``k`` nearest entries of each question, by
    rounded distance, then id; ``best`` is what earlier entries gave."""
    dist = 1.0 - mat_q @ mat_e.T
    if allowed is not None:
        dist = np.where(allowed, dist, np.inf)
    own = np.broadcast_to(ids, dist.shape)
    if best is not None:
        dist, own = np.concatenate([best[0], dist], axis=1), np.concatenate([best[1], own], axis=1)
    order = np.lexsort((own, np.round(dist, 9)), axis=1)[:, :k]
    return np.take_along_axis(dist, order, 1), np.take_along_axis(own, order, 1)


def ranked(found: DataFrame, k: int, query_id: str, entry_id: str) -> DataFrame:
    """The ``k`` best of all candidates of each question, with their rank."""
    w = Window.partitionBy(query_id).orderBy(F.round("distance", 9), entry_id)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(index: VectorIndex, queries: DataFrame, k: int, query_id: str = "query_id", group: str | None = None,
           probes: int | None = None, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """``query_id, entry_id, distance, rank`` of the ``k`` nearest entries found
    in the cells each question asks. With ``group``, only entries of the
    question's group count; a question without one has none. Ids are whole numbers."""
    spark = queries.sparkSession
    schema = f"{query_id} long, {index.entry_id} long, distance double"
    if not len(index.centres):
        return spark.createDataFrame([], f"{schema}, rank int")
    q = queries.where(usable(F.col(index.vec))).select(F.col(query_id).cast("long").alias(query_id), *(
        F.col(c).alias(c) for c in (index.vec, *([group] if group else []))))
    n_asked = min(probes or index.probes, len(index.centres))
    e = index.entries.select(index.entry_id, index.vec, *([group] if group else []), "cell", "part")
    if q.limit(few + 1).count() <= few:
        found = _few(index, e, q.toPandas(), k, query_id, group, n_asked, schema)
    else:
        found = _many(index, e, q, k, query_id, group, n_asked, block, schema)
    return ranked(found, k, query_id, index.entry_id)


def _asked_cells(mat: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    return np.argsort(-(mat @ centres.T), axis=1, kind="stable")[:, :n]


def _same(asked: pd.DataFrame, stored: pd.DataFrame, group: str | None) -> np.ndarray | None:
    if not group:
        return None
    return (stored[group].to_numpy()[None, :] == asked[group].to_numpy()[:, None]) & stored[group].notna().to_numpy()[None, :]


def _few(index: VectorIndex, entries: DataFrame, asked: pd.DataFrame, k: int, query_id: str, group: str | None, n: int, schema: str) -> DataFrame:
    """Questions (a bounded number) go to the tasks that read the asked cells."""
    spark, entry_id, vec = entries.sparkSession, index.entry_id, index.vec
    if not len(asked):
        return spark.createDataFrame([], schema)
    mat = unit_rows(asked[vec])
    cells = _asked_cells(mat, index.centres, n)
    sent = spark.sparkContext.broadcast((asked[[query_id, *([group] if group else [])]], mat, cells))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, mat, cells = sent.value
        for batch in batches:
            for cell, rows in batch.groupby("cell"):
                here = np.flatnonzero((cells == cell).any(axis=1))
                if len(here):
                    some = own.iloc[here]
                    d, i = top_of(mat[here], unit_rows(rows[vec]), rows[entry_id].to_numpy(np.int64), k, _same(some, rows, group))
                    at, c = np.nonzero(np.isfinite(d))
                    yield pd.DataFrame({query_id: some[query_id].to_numpy(np.int64)[at], entry_id: i[at, c], "distance": d[at, c]})

    wanted = [int(c) for c in np.unique(cells)]
    return entries.where(F.col("cell").isin(wanted)).mapInPandas(run, schema)


def _many(index: VectorIndex, entries: DataFrame, q: DataFrame, k: int, query_id: str, group: str | None, n: int, block: int, schema: str) -> DataFrame:
    """Questions are dealt to all parts of the cells they ask; a cell that very
    many ask is met in several blocks of them."""
    centres, parts, entry_id, vec = index.centres, index.parts, index.entry_id, index.vec
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in q.schema.fields)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cells = _asked_cells(unit_rows(batch[vec]), centres, n)
                out = batch.iloc[np.repeat(np.arange(len(batch)), cells.shape[1])].copy()
                out["cell"] = cells.ravel().astype(np.int32)
                yield out

    asked = q.mapInPandas(ask, f"{fields}, cell int")
    sizes = {r.cell: r.n for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most MOST_CELLS rows
    blocks = [max(1, -(-sizes.get(c, 0) // block)) for c in range(len(centres))]

    def of_cell(values) -> Column:
        return F.element_at(F.array(*(F.lit(int(v)) for v in values)), F.col("cell") + 1)

    asked = asked.withColumn("block", F.pmod(F.xxhash64(query_id), of_cell(blocks)).cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), of_cell(parts) - 1)))
    held = entries.where(F.col("cell").isin(list(sizes))).withColumn("block", F.explode(F.sequence(F.lit(0), of_cell(blocks) - 1)))

    def score(some: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(some) and len(rows):
            mat_e, ids = unit_rows(rows[vec]), rows[entry_id].to_numpy(np.int64)
            for at in range(0, len(some), 1_000):
                own, best = some.iloc[at:at + 1_000], None
                mat_q = unit_rows(own[vec])
                for x in range(0, len(rows), 2_000):
                    best = top_of(mat_q, mat_e[x:x + 2_000], ids[x:x + 2_000], k, _same(own, rows.iloc[x:x + 2_000], group), best)
                i, c = np.nonzero(np.isfinite(best[0]))
                out.append(pd.DataFrame({query_id: own[query_id].to_numpy(np.int64)[i], entry_id: best[1][i, c], "distance": best[0][i, c]}))
        return pd.concat(out) if out else pd.DataFrame({query_id: np.empty(0, np.int64), entry_id: np.empty(0, np.int64), "distance": np.empty(0)})

    keys = ["cell", "part", "block"]
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(score, schema)


def recall(found: DataFrame, exact: DataFrame, query_id: str = "query_id", entry_id: str = "entry_id") -> DataFrame:
    """One row: questions, neighbours wanted, neighbours found, their share."""
    both = exact.select(query_id, entry_id).join(found.select(query_id, entry_id, F.lit(1).alias("hit")), [query_id, entry_id], "left")
    return both.agg(F.countDistinct(query_id).alias("questions"), F.count("*").alias("wanted"), F.count("hit").alias("found")).withColumn(
        "recall", F.when(F.col("wanted") > 0, F.col("found") / F.col("wanted")).otherwise(F.lit(1.0)))
