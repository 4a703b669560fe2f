"""Streaming twins (T): each runs a Structured Streaming query over landed
files to completion and is checked against its batch twin's SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ratings as R
from ..session import scratch_path
from ..sources.projections import MatchData
from ..sources.tables import table_path
from ..streaming import jobs as J
from .accounts import ENT_SQL, LIMITS_SQL, REQUESTS_SQL, SUBS_SQL, limits, requests_from
from .catalog import register

#: Micro-batches, at most, that the landed event files are read in.
EVENT_BATCHES = 4


def _land(md: MatchData, df: DataFrame, name: str) -> str:
    """Write a derived table as landed files in the shared folder."""
    path = scratch_path(md.spark, f"landing/{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return path


@register("rate_windows_stream", """
SELECT subject_kind, subject, date_trunc('minute', ts) AS window_start, count(*) AS request_count
FROM r GROUP BY 1, 2, 3
HAVING date_trunc('minute', ts) + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM r) - INTERVAL 10 MINUTE
""", (), {"r": REQUESTS_SQL})
def rate_windows_stream(md: MatchData) -> DataFrame:
    """Q1s: the events file as a stream; closed minute windows (watermark 10 min)."""
    schema = md.read("events").schema
    events = (md.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("pathGlobFilter", table_path(md.sf_dir, "events").rsplit("/", 1)[1]).parquet(md.sf_dir))
    stream = J.rate_windows_stream(requests_from(events.withColumn("ts", F.col("ts").cast("timestamp"))))
    return J.run_available(stream, "rate_windows")


@register("metric_totals_stream", """
SELECT e.team_id, m.competition_id, count(*) FILTER (WHERE e.type = 'Shot') AS shots,
       count(*) FILTER (WHERE e.type = 'Shot' AND e.outcome = 'Goal') AS goals,
       count(*) FILTER (WHERE e.type = 'Pass') AS passes, count(*) AS events
FROM v_events e JOIN v_matches m ON m.match_id = e.match_id WHERE e.team_id IS NOT NULL GROUP BY 1, 2
""", ("v_events", "v_matches"))
def metric_totals_stream(md: MatchData) -> DataFrame:
    """Q4: live counts per team and competition over landed event files, in update
    mode: a micro-batch merges the keys it changed into the stored table."""
    path, files = landed_events(md)
    events = md.spark.readStream.schema(md.events.schema).option("maxFilesPerTrigger", -(-files // EVENT_BATCHES)).parquet(path)
    return J.stored_totals(events, md.matches)


def landed_events(md: MatchData) -> tuple[str, int]:
    """Folder and number of the landed event files: one a scan task, so a task's
    share is bounded by the split size, whatever the number of events."""
    path = _land(md, md.events, "events")
    return path, max(1, len(md.spark.read.parquet(path).inputFiles()))


@register("elo_stream", "SELECT team_id, elo_rating, matches_played FROM v_elo_final", ("v_elo_final",))
def elo_stream(md: MatchData) -> DataFrame:
    """Q3: ratings updated as results land, one season file per micro-batch.
    A result touches two teams, so each batch is applied with ``foreachBatch``
    against the stored rating table (a new table version per batch)."""
    spark = md.spark
    base = scratch_path(spark, f"landing/matches-{uuid.uuid4().hex[:12]}")
    m = md.matches.select("match_id", "match_date", "home_team_id", "away_team_id", "home_score", "away_score")
    years = sorted(r[0] for r in m.select(F.year("match_date")).distinct().collect())  # one file per season
    for y in years:
        m.where(F.year("match_date") == y).coalesce(1).write.parquet(f"{base}/season={y}")
    stream = (spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(base))
    state_root = scratch_path(spark, f"streams/elo-state-{uuid.uuid4().hex[:12]}")

    def apply(batch: DataFrame, batch_id: int, out: str) -> None:
        # the first batch has no stored ratings; any later read that fails stops the stream
        state = spark.read.parquet(f"{state_root}/v{batch_id - 1}") if batch_id else spark.createDataFrame([], R.STATE_SCHEMA)
        touched = R.elo_update(batch, state)
        new = state.join(touched.select("team_id"), "team_id", "left_anti").unionByName(touched)
        new.write.mode("overwrite").parquet(f"{state_root}/v{batch_id}")
        new.write.mode("overwrite").parquet(out)

    final = J.run_available(stream, "elo", foreach_batch=apply)
    return final.where(F.col("played") > 0).select(
        "team_id", F.round("rating", 2).alias("elo_rating"), F.col("played").alias("matches_played"))


DECISIONS_SQL = """
SELECT request_id, subject_kind, subject, minute_count, day_count,
       minute_count <= l.minute_limit AND day_count <= l.day_limit AS allowed
FROM (SELECT request_id, subject_kind, subject,
             row_number() OVER (PARTITION BY subject_kind, subject, date_trunc('minute', ts) ORDER BY ts, request_id) AS minute_count,
             row_number() OVER (PARTITION BY subject_kind, subject, date_trunc('day', ts) ORDER BY ts, request_id) AS day_count
      FROM r) x
JOIN (SELECT subject_kind, subject,
             CASE tier WHEN 'anonymous' THEN 12 WHEN 'user' THEN 30 ELSE 90 END AS minute_limit,
             CASE tier WHEN 'anonymous' THEN 300 WHEN 'user' THEN 1000 ELSE 3000 END AS day_limit FROM lim) l USING (subject_kind, subject)
"""
DECISION_VIEWS = {"r": REQUESTS_SQL, "subs": SUBS_SQL, "ent": ENT_SQL, "lim": LIMITS_SQL}


def _request_stream(md: MatchData) -> DataFrame:
    schema = md.read("events").schema
    events = (md.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("pathGlobFilter", table_path(md.sf_dir, "events").rsplit("/", 1)[1]).parquet(md.sf_dir))
    return requests_from(events.withColumn("ts", F.col("ts").cast("timestamp")))


@register("rate_decisions_stream", DECISIONS_SQL, (), DECISION_VIEWS)
def rate_decisions_stream(md: MatchData) -> DataFrame:
    """Q2s: the rate decision inside a stream (window counts carried between batches)."""
    return J.rate_decisions_stream(_request_stream(md), limits(md))


@register("rate_limiter_stream", DECISIONS_SQL, (), DECISION_VIEWS)
def rate_limiter_stream(md: MatchData) -> DataFrame:
    """Q2s with keyed state: one state a subject, cleared by a timer when idle."""
    return J.rate_limiter_stream(_request_stream(md), limits(md)).drop("reason")
