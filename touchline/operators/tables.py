"""Table maintenance: upserts, insert-ignore, owned deletes, row counts,
column population, allow-lists and caps, all as joins and aggregations that
produce a new table version (the write itself is a columnar parquet write).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .totals import insert_ignore, upsert  # noqa: F401  (A15 / A16)


def delete_where_owned(table: DataFrame, requests: DataFrame, id_col: str, owner_col: str) -> tuple[DataFrame, DataFrame]:
    """Delete rows matching (id AND owner); requests matching nothing are
    returned as 'not found'."""
    keys = [id_col, owner_col]
    kept = table.join(requests.select(*keys), keys, "left_anti")
    not_found = requests.select(*keys).join(table.select(*keys), keys, "left_anti")
    return kept, not_found


def row_count_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table with its row count (one aggregation per table, unioned)."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
             for name, df in tables.items()]
    return reduce(DataFrame.unionAll, parts)


def idempotency_check(first: DataFrame, second: DataFrame) -> DataFrame:
    """Tables whose count changed between two runs."""
    a = first.withColumnRenamed("row_count", "first_count")
    b = second.withColumnRenamed("row_count", "second_count")
    return a.join(b, "table_name").where(F.col("first_count") != F.col("second_count"))


def column_population(df: DataFrame, columns: list[str]) -> DataFrame:
    """Non-null count per column, in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in columns])
    stacked = ", ".join(f"'{c}', `{c}`" for c in columns)
    return counts.select("rows", F.expr(f"stack({len(columns)}, {stacked}) AS (column_name, non_null)"))


def allowlist(items: DataFrame, requested: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Keep requested keys (an empty request keeps all); also list the
    requested keys that match nothing. The caller fails when nothing matched."""
    if requested.limit(1).count() == 0:
        return items, requested
    kept = items.join(requested.select(key), key, "left_semi")
    unmatched = requested.select(key).join(items.select(key), key, "left_anti")
    return kept, unmatched


def first_n_per(df: DataFrame, n: int, order: list, partition: list | None = None) -> DataFrame:
    """The first ``n`` rows by ``order`` (per ``partition`` when given)."""
    w = Window.partitionBy(*partition).orderBy(*order) if partition else Window.orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")
