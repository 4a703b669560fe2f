"""A stored table that batches are merged into by key.

Rows lie in buckets by a hash of their key, one folder each. A merge reads the
buckets its batch touches and no others, joins them with the batch, writes the
new state of these buckets to a staging folder, puts it in place by dynamic
partition overwrite, and notes the batch's name. A batch that is noted already
is left out; one that failed anywhere before the note is merged again, and
gives the same rows, since every way of merging here (replace, keep, newest
version) has that property. One writer at a time.

Keys may be null; nulls are equal to each other. Among rows of one key in a
batch the highest ``version`` wins, ties by the row's hash, so a repeated row counts once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import _file_system

BUCKETS = 64


def _exists(spark: SparkSession, path: str) -> bool:
    at, fs = _file_system(spark, path)
    return fs.exists(at)


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of the table; an absent table has none."""
    if not _exists(spark, f"{path}/rows"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, `_bucket` int").parquet(f"{path}/rows").drop("_bucket")


def merged(spark: SparkSession, path: str, batch: str) -> bool:
    return _exists(spark, f"{path}/batches/{batch}")


def merge(rows: DataFrame, path: str, keys: list[str], batch: str, version: str | None = None, keep: bool = False,
          buckets: int = BUCKETS, before_note=None) -> bool:
    """Merge a batch; False if it was merged before.

    A row of the batch replaces the stored row of its key, unless ``keep`` is set
    or the stored ``version`` is higher. ``before_note`` is called when the rows are in place but
    the batch is not noted yet (tests fail there)."""
    spark = rows.sparkSession
    if merged(spark, path, batch):
        return False
    columns = rows.columns
    order = ([F.desc_nulls_last(version)] if version else []) + [F.xxhash64(*columns)]
    newest = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
    staged = f"{path}/staging/{uuid.uuid4().hex}"
    newest.withColumn("_bucket", _bucket(keys, buckets)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{staged}/new")
    new = spark.read.schema(f"{_ddl(rows)}, `_bucket` int").parquet(f"{staged}/new")
    touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # at most `buckets` numbers
    if touched:
        if _exists(spark, f"{path}/rows"):
            old = spark.read.schema(f"{_ddl(rows)}, `_bucket` int").parquet(f"{path}/rows").where(F.col("_bucket").isin(touched))
            new = _joined(old, new, keys, version, keep)
        new.write.partitionBy("_bucket").parquet(f"{staged}/all")
        spark.read.schema(f"{_ddl(rows)}, `_bucket` int").parquet(f"{staged}/all").repartition("_bucket").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(f"{path}/rows")
    if before_note:
        before_note()
    at, fs = _file_system(spark, f"{path}/batches/{batch}")
    fs.mkdirs(at)
    staging, fs = _file_system(spark, staged)
    fs.delete(staging, True)
    return True


def _joined(old: DataFrame, new: DataFrame, keys: list[str], version: str | None, keep: bool) -> DataFrame:
    columns = new.columns
    a = old.select(F.struct(*columns).alias("o"), *(F.col(k).alias(f"o_{i}") for i, k in enumerate(keys)))
    b = new.select(F.struct(*columns).alias("n"), *(F.col(k).alias(f"n_{i}") for i, k in enumerate(keys)))
    both = a.join(b, [F.col(f"o_{i}").eqNullSafe(F.col(f"n_{i}")) for i in range(len(keys))], "full")
    stays = F.col("o").isNotNull() & (F.lit(True) if keep else (F.col(f"o.{version}") > F.col(f"n.{version}")) if version else F.lit(False))
    row = F.when(F.col("n").isNull() | F.coalesce(stays, F.lit(False)), F.col("o")).otherwise(F.col("n"))
    return both.select(row.alias("r")).select("r.*")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def state(df: DataFrame) -> DataFrame:
    """``row_count, checksum`` of a table: the checksum does not depend on the
    order of rows and changes with any of them."""
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).alias("checksum"))
