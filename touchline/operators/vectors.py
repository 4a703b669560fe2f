"""Vector retrieval: cosine distance, exact k-nearest search, cache lookup.

Exact search never forms the full question x entry product as rows. At most
``QUERY_BLOCK`` questions (counted first) go to the entries, which stay where they
are: each task scores what it reads with matrix products and keeps the top k per
question. More questions are dealt into blocks and entries into parts of bounded size;
each pair of a block and a part meets in one cogrouped call. A window over those few
candidates picks the global top k. :mod:`vector_index` is the approximate search.

Null vectors, those with a null and those without a length have no distance (null)
and are nobody's neighbour.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vector_index import ranked, top_of, unit_rows, usable

QUERY_BLOCK = 2_000  # about the questions of a block
ENTRY_PART = 20_000  # about the entries of a part; smaller ones share out a small table
ENTRY_BLOCK = 1_000  # entries scored at a time
MOST_TASKS = 10_000
CACHE_SIMILARITY = 0.97


def _as_double(arr: Column) -> Column:
    return F.transform(arr, lambda x: x.cast("double"))


def cosine_distance(a: Column, b: Column) -> Column:
    """O1: 1 - a.b / (|a| |b|) with built-in higher-order functions."""
    a, b = _as_double(a), _as_double(b)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda acc, x: acc + x * x))
    return 1.0 - dot / F.nullif(na * nb, F.lit(0.0))


def dimension_check(vectors: DataFrame, col: str, dim: int) -> DataFrame:
    """Vector count per dimension and whether it is the expected one."""
    return vectors.groupBy(F.size(col).alias("dimension")).agg(F.count(F.lit(1)).alias("vectors")).withColumn(
        "ok", F.col("dimension") == dim)


def nearest(entries: DataFrame, queries: DataFrame, k: int, entry_id: str = "entry_id", query_id: str = "query_id",
            vec: str = "embedding", group: str | None = None, block_size: int = QUERY_BLOCK) -> DataFrame:
    """O2: the k nearest entries (cosine distance, ties by entry id) per query.

    With ``group`` set, only entries of the query's group are candidates
    (the cache's same-language rule).
    """
    q = queries.where(usable(F.col(vec))).select(*(F.col(c).alias(c) for c in (query_id, vec, *([group] if group else []))))
    e = entries.where(usable(F.col(vec))).select(entry_id, vec, *([group] if group else []))
    schema = f"{query_id} long, {entry_id} long, distance double"
    if q.limit(block_size + 1).count() <= block_size:
        return ranked(_against_few(e, q.toPandas(), k, entry_id, query_id, vec, group, schema), k, query_id, entry_id)
    n_entries = e.count()
    blocks = max(1, math.ceil(q.count() / block_size))
    parts = max(1, math.ceil(n_entries / min(ENTRY_PART, max(ENTRY_BLOCK, n_entries // 32))))
    tasks = min(blocks * parts, MOST_TASKS)
    q = _dealt(q, "__block", query_id, blocks, "__part", parts).repartition(tasks, "__block", "__part")
    e = _dealt(e, "__part", entry_id, parts, "__block", blocks).repartition(tasks, "__block", "__part")

    def score(asked: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        return _nearest_of(asked, stored, k, entry_id, query_id, vec, group)

    found = q.groupBy("__block", "__part").cogroup(e.groupBy("__block", "__part")).applyInPandas(
        score, schema)
    return ranked(found, k, query_id, entry_id)


def _against_few(entries: DataFrame, asked: pd.DataFrame, k: int, entry_id: str, query_id: str, vec: str, group: str | None, schema: str) -> DataFrame:
    """Candidates of a bounded number of questions: every task scores the entries it reads."""
    spark = entries.sparkSession
    if not len(asked):
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast(asked)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _nearest_of(sent.value, batch, k, entry_id, query_id, vec, group)

    return entries.mapInPandas(run, schema)


def _dealt(df: DataFrame, own: str, key: str, n_own: int, other: str, n_other: int) -> DataFrame:
    """Each row in its own block (by a hash of its key), once for every block of the other side."""
    return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n_own)).cast("int")).withColumn(
        other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))


def _nearest_of(asked: pd.DataFrame, stored: pd.DataFrame, k: int, entry_id: str, query_id: str, vec: str,
                group: str | None) -> pd.DataFrame:
    """The k nearest entries of one part for every question of one block."""
    best = None
    mat_q = unit_rows(asked[vec]) if len(asked) else None
    for at in range(0, len(stored) if len(asked) else 0, ENTRY_BLOCK):
        part = stored.iloc[at:at + ENTRY_BLOCK]
        same = None
        if group:
            same = (part[group].to_numpy()[None, :] == asked[group].to_numpy()[:, None]) & part[group].notna().to_numpy()[None, :]
        best = top_of(mat_q, unit_rows(part[vec]), part[entry_id].to_numpy(np.int64), k, same, best)
    if best is None:
        return pd.DataFrame({query_id: np.empty(0, np.int64), entry_id: np.empty(0, np.int64), "distance": np.empty(0)})
    q, c = np.nonzero(np.isfinite(best[0]))
    return pd.DataFrame({query_id: asked[query_id].to_numpy(np.int64)[q], entry_id: best[1][q, c], "distance": best[0][q, c]})


def cache_lookup(entries: DataFrame, queries: DataFrame, threshold: float = CACHE_SIMILARITY,
                 max_age_seconds: float = 0, now_col: str | None = None) -> DataFrame:
    """O3: the nearest stored entry of the same language within 1 - threshold,
    newer than ``max_age_seconds`` when that is positive; one or none per question."""
    e = entries
    if max_age_seconds and now_col:
        e = e.where(F.col("created_at") >= F.col(now_col) - F.make_dt_interval(secs=F.lit(max_age_seconds)))
    best = nearest(e, queries, 1, group="language")
    return best.where(F.col("distance") <= 1.0 - threshold).drop("rank")
