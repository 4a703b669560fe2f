"""Structured Streaming twins of the usage and totals jobs.

Every stream reads files as they land (a file source). The caller names the
folder ``at`` of a query: its checkpoint, state and output lie there, so a query started
again with the same name resumes where it stopped, after a kill in the middle of a batch too
(the batch is run again and replaces its own output). Without a name a query is a run of
its own, under the shared ``spark.checkpoint.dir``. ``run_available`` drives a query with
``trigger(availableNow=True)``, i.e. it processes everything that has landed
and stops; a deployment runs the same query with a processing-time trigger.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.usage import rate_decisions, rate_windows
from ..session import scratch_path
from ..sources import stored
from . import limiter

WATERMARK = "10 minutes"


def own_folder(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"streams/{name}-{uuid.uuid4().hex[:12]}")


def run_available(stream: DataFrame, name: str, mode: str = "append", foreach_batch=None, at: str | None = None,
                  conf: dict[str, str] | None = None, read: bool = True) -> DataFrame | None:
    """Run a streaming DataFrame over the files that have landed and return its
    output as a batch DataFrame read from the sink (``<at>/out``). ``conf`` holds while
    the query starts, which keeps it."""
    spark = stream.sparkSession
    at = at or own_folder(spark, name)
    out = f"{at}/out"
    writer = stream.writeStream.option("checkpointLocation", f"{at}/checkpoint").outputMode(mode).trigger(availableNow=True)
    if foreach_batch is not None:
        writer = writer.foreachBatch(lambda df, batch_id: foreach_batch(df, batch_id, out))
    else:
        writer = writer.format("parquet").option("path", out)
    before = {k: spark.conf.get(k, None) for k in conf or {}}
    for k, v in (conf or {}).items():
        spark.conf.set(k, v)
    try:
        q = writer.start()
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.parquet(out) if read else None


def rate_windows_stream(requests: DataFrame) -> DataFrame:
    """Q1s: per-subject minute counts with a watermark; a window is emitted
    once the watermark passes its end (append mode), later rows are dropped."""
    return (requests.withWatermark("ts", WATERMARK)
            .groupBy("subject_kind", "subject", F.window("ts", "1 minute").alias("w"))
            .agg(F.count(F.lit(1)).alias("request_count"))
            .select("subject_kind", "subject", F.col("w.start").alias("window_start"), "request_count"))


def metric_totals_stream(events: DataFrame, matches: DataFrame) -> DataFrame:
    """Q4: live event counts per team and competition (stream-static join with
    the match table; the state is one row per team-competition)."""
    m = matches.select("match_id", "competition_id")
    e = events.drop("competition_id").join(m, "match_id")
    t, o = F.col("type"), F.col("outcome")
    return e.where(F.col("team_id").isNotNull()).groupBy("team_id", "competition_id").agg(
        F.count_if(t == "Shot").alias("shots"),
        F.count_if((t == "Shot") & (o == "Goal")).alias("goals"),
        F.count_if(t == "Pass").alias("passes"),
        F.count(F.lit(1)).alias("events"))


TOTAL_KEYS = ["team_id", "competition_id"]
TOTAL_SCHEMA = "team_id string, competition_id string, shots long, goals long, passes long, events long"


def stored_totals(events: DataFrame, matches: DataFrame, at: str | None = None) -> DataFrame:
    """Q4 into a stored table: in update mode a micro-batch carries only the
    keys it changed, and only their buckets are read and written."""
    spark = events.sparkSession
    at = at or own_folder(spark, "metric_totals")

    def merge(df: DataFrame, batch_id: int, out: str) -> None:
        stored.merge(df, out, TOTAL_KEYS, f"batch-{batch_id}")

    run_available(metric_totals_stream(events, matches), "metric_totals", "update", merge, at, read=False)
    return stored.read(spark, f"{at}/out", TOTAL_SCHEMA)


# ----------------------------------------------------------- Q2s decisions
WINDOW_SCHEMA = "subject_kind string, subject string, window_kind string, window_start timestamp, request_count long"
INDEX_SCHEMA = "day int, batch long"


def rate_limiter_stream(requests: DataFrame, limits: DataFrame, at: str | None = None, **options) -> DataFrame:
    """Q2s with keyed state and timers (:mod:`limiter`)."""
    return run_available(limiter.decisions(requests, limits, **options), "rate_limiter", at=at,
                         conf={"spark.sql.streaming.stateStore.providerClass": limiter.ROCKSDB,
                               # with clock timers, batches without data would follow each other without end
                               "spark.sql.streaming.noDataMicroBatches.enabled": "false"})


def rate_decisions_stream(requests: DataFrame, limits: DataFrame, at: str | None = None) -> DataFrame:
    """Q2s: every micro-batch is decided by the batch plan plus the counts that
    earlier batches left in each subject's minute and day window.

    Within a batch requests count in (ts, id) order, in whatever order they
    arrive; a request that arrives in a later batch counts after those already
    decided, as a limiter counts it. Blocked requests count. The counts of every
    window are kept, however late a request comes: they lie in the shared folder
    by day, and a batch reads and writes only the days of its own requests. An
    index (one row a day) names the batch that wrote a day last; a batch that is
    run again after a failure replaces its own counts, index and output.
    """
    spark = requests.sparkSession
    at = at or own_folder(spark, "rate_decisions")
    root = f"{at}/state"

    def apply(batch: DataFrame, batch_id: int, out: str) -> None:
        rows = batch.persist()
        try:
            decide(rows, batch_id, out)
        finally:
            rows.unpersist()

    def decide(rows: DataFrame, batch_id: int, out: str) -> None:
        session = rows.sparkSession
        index = session.read.schema(INDEX_SCHEMA).parquet(f"{root}/index/v{batch_id - 1}") if batch_id else session.createDataFrame([], INDEX_SCHEMA)
        days = rows.where(F.col("ts").isNotNull()).select(_day("ts").alias("day")).distinct()
        # bounded by the calendar: one path for each day of the batch that has counts
        known = [f"{root}/counts/batch={r['batch']}/day={r['day']}" for r in index.join(days, "day").collect()]
        before = session.read.schema(WINDOW_SCHEMA).parquet(*known) if known else session.createDataFrame([], WINDOW_SCHEMA)
        rate_decisions(rows, limits, before).select(*DECISION_COLUMNS).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        both = before.unionByName(rate_windows(rows)).where(F.col("window_start").isNotNull()).groupBy(
            "subject_kind", "subject", "window_kind", "window_start").agg(F.sum("request_count").alias("request_count"))
        both.withColumn("day", _day("window_start")).hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(
            f"{root}/counts/batch={batch_id}")
        index.join(days, "day", "left_anti").unionByName(days.withColumn("batch", F.lit(batch_id).cast("long"))).coalesce(1).write.mode(
            "overwrite").parquet(f"{root}/index/v{batch_id}")

    return run_available(requests, "rate_decisions", foreach_batch=apply, at=at).drop("batch")


def _day(ts: str) -> Column:
    return F.unix_date(F.to_date(ts))


DECISION_COLUMNS = ("request_id", "subject_kind", "subject", "minute_count", "day_count", "allowed")
