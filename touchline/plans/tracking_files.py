"""Tracking files landed as JSON documents and read back (2.A, A11 / A12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import tracking_files as TF
from ..sources.projections import MatchData
from .catalog import register
from .providers import _landing
from .replay import track_points

#: Clips have frames of several sizes; every 9th has none.
SIZE_SQL = "CASE clip_name::bigint % 9 WHEN 0 THEN NULL ELSE 100 + 20 * (clip_name::bigint % 4) END"


def land_tracks(md: MatchData) -> str:
    """One document a clip (its points are those of one match): every 20th in a
    file of its own over many lines, the others on a line each."""
    path = _landing(md, "track-files")
    n = F.col("clip_name").cast("long")
    size = F.when(n % 9 != 0, (100 + 20 * (n % 4)).cast("double"))
    point = F.struct("frame_index", "time_seconds", F.struct(F.col("cx").alias("x"), F.col("cy").alias("y")).alias("center"))
    tracks = track_points(md).groupBy("clip_name", "track_id").agg(F.array_sort(F.collect_list(point)).alias("trajectory"))
    docs = tracks.groupBy("clip_name").agg(F.collect_list(F.struct("track_id", "trajectory")).alias("tracks")).select(
        "clip_name", n.alias("clip"), F.struct(F.concat(F.lit("/videos/"), "clip_name", F.lit(".mp4")).alias("input_video"), size.alias("width"), (size / 2).alias("height")).alias("metadata"), "tracks")
    doc = F.struct("metadata", "tracks")
    docs.where(n % 20 == 0).select("clip", F.to_json(doc, {"pretty": "true"}).alias("text")).repartition("clip").write.partitionBy("clip").text(f"{path}/pretty")
    docs.where(n % 20 != 0).select(F.to_json(doc).alias("text")).write.text(f"{path}/lines")
    return path


@register("load_track_files", f"""
SELECT 'cv:' || clip_name AS clip_id, 'cv:' || clip_name || ':' || track_id AS track_id, frame_index, time_seconds,
       round(cx / ({SIZE_SQL}), 6) AS x, round(cy / ({SIZE_SQL} / 2.0), 6) AS y, 'broadcast_cv' AS source
FROM v_track_points WHERE clip_name::bigint % 9 <> 0
""", ("v_track_points",))
def load_track_files(md: MatchData) -> DataFrame:
    return TF.read_tracks(md.spark, land_tracks(md))[0]


@register("failed_track_files", """
SELECT DISTINCT clip_name, 'no frame size' AS reason FROM v_track_points WHERE clip_name::bigint % 9 = 0
""", ("v_track_points",))
def failed_track_files(md: MatchData) -> DataFrame:
    return TF.read_tracks(md.spark, land_tracks(md))[1].select("clip_name", "reason")


def land_metrics(md: MatchData) -> str:
    path = _landing(md, "metric-files")
    n = F.col("clip_name").cast("long")
    per = track_points(md).groupBy("clip_name", "track_id").agg(
        F.count(F.lit(1)).alias("frame_count"), F.min("frame_index").cast("long").alias("first_frame"), F.max("frame_index").cast("long").alias("last_frame"),
        F.max("time_seconds").alias("time_tracked_seconds"))
    own = F.when(F.col("last_frame") % 4 == 0, "meters")
    docs = per.groupBy("clip_name").agg(F.collect_list(F.struct("track_id", "frame_count", "first_frame", "last_frame", "time_tracked_seconds",
                                                                (F.col("last_frame") * 1.5).alias("total_distance"), own.alias("distance_units"))).alias("tracks"))
    docs.select(F.struct("clip_name", F.lit("").alias("license"), F.lit(25.0).alias("fps"), (n % 5 + 100).alias("width"), F.when(n % 2 == 0, n % 7).alias("frame_count"),
                         F.when(n % 3 == 0, "yards").alias("distance_units"), (n % 13 != 0).alias("rights_confirmed")).alias("metadata"), "tracks").write.json(path)
    return path


@register("load_metric_clips", """
SELECT DISTINCT 'cv:' || clip_name AS clip_id, clip_name, NULL::varchar AS license, 25.0::double AS fps, CASE WHEN clip_name::bigint % 2 = 0 THEN clip_name::bigint % 7 END AS frame_count,
       clip_name::bigint % 5 + 100 AS width, NULL::bigint AS height, false AS calibrated, CASE WHEN clip_name::bigint % 3 = 0 THEN 'yards' ELSE 'pixels' END AS distance_units,
       'pixels_per_second' AS speed_units
FROM v_track_points WHERE clip_name::bigint % 13 <> 0
""", ("v_track_points",))
def load_metric_clips(md: MatchData) -> DataFrame:
    """A12, clips half, with frame count and size."""
    return TF.read_metrics(md.spark, land_metrics(md))[0].select(
        "clip_id", "clip_name", "license", "fps", "frame_count", "width", "height", "calibrated", "distance_units", "speed_units")


@register("load_metric_tracks", """
SELECT 'cv:' || clip_name AS clip_id, 'cv:' || clip_name || ':' || track_id AS track_id, 'broadcast_cv' AS source, 'unknown' AS class, count(*) AS frame_count,
       cast(min(frame_index) AS bigint) AS first_frame, cast(max(frame_index) AS bigint) AS last_frame, max(time_seconds) AS time_tracked_seconds,
       max(frame_index) * 1.5::double AS total_distance, NULL::double AS top_speed, NULL::double AS average_speed,
       CASE WHEN max(frame_index) % 4 = 0 THEN 'meters' WHEN clip_name::bigint % 3 = 0 THEN 'yards' ELSE 'pixels' END AS distance_units, 'pixels_per_second' AS speed_units
FROM v_track_points WHERE clip_name::bigint % 13 <> 0 GROUP BY clip_name, track_id
""", ("v_track_points",))
def load_metric_tracks(md: MatchData) -> DataFrame:
    """A12, tracks half: the track's own units, else the clip's."""
    return TF.read_metrics(md.spark, land_metrics(md))[1]
