"""Tracking files: tracks with their trajectories, and clip and track metrics.

A file is a JSON document with ``metadata`` and ``tracks`` for one clip, on one
line or many (see :mod:`envelopes`). Readers return what loads and what does
not: a tracks file without a frame size cannot be normalised, a clip without
confirmed rights is refused, and text that is no such document is a reject; each comes back
with its name, and :func:`require` stops a load on them. A repeated
(clip, track, frame) keeps its last point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import envelopes

PREFIX, SOURCE = "cv:", "broadcast_cv"
TRACKS = (
    "metadata struct<input_video:string,width:double,height:double>, tracks array<struct<track_id:string,"
    "trajectory:array<struct<frame_index:bigint,time_seconds:double,center:struct<x:double,y:double>>>>>")
_TEXTS = "source_video:string,license:string,license_url:string,author:string"
METRICS = (
    f"metadata struct<clip_name:string,{_TEXTS},fps:double,width:bigint,height:bigint,frame_count:bigint,calibrated:boolean,"
    "distance_units:string,speed_units:string,rights_confirmed:boolean>, tracks array<struct<track_id:string,class:string,"
    "frame_count:bigint,first_frame:bigint,last_frame:bigint,time_tracked_seconds:double,total_distance:double,top_speed:double,"
    "average_speed:double,distance_units:string,speed_units:string>>")
FAILED = "path string, clip_name string, reason string"
SHOWN = 20


def _clip_of(video: Column) -> Column:
    """A video's file name without its last ending, 'clip' where there is none."""
    name = F.regexp_extract(F.coalesce(video, F.lit("")), r"([^/]+)/*$", 1)
    return F.coalesce(F.nullif(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.lit("")), F.lit("clip"))


def _documents(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    rows = envelopes.parsed(spark, path, StructType.fromDDL(schema), ("metadata",))
    bad = rows.where(F.col("reason").isNotNull()).select("path", F.lit(None).cast("string").alias("clip_name"), "reason")
    return rows.where(F.col("reason").isNull()).select("path", "record.metadata", "record.tracks"), bad


def read_tracks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(points, failed)``: a point per frame of a track with its centre as a share of
    the clip's own frame size."""
    docs, bad = _documents(spark, path, TRACKS)
    docs = docs.withColumn("clip_name", _clip_of(F.col("metadata.input_video")))
    sized = F.coalesce((F.col("metadata.width") > 0) & (F.col("metadata.height") > 0), F.lit(False))
    failed = bad.unionByName(docs.where(~sized).select("path", "clip_name", F.lit("no frame size").alias("reason")))
    points = docs.where(sized).select(
        F.concat(F.lit(PREFIX), "clip_name").alias("clip_id"), "path", F.col("metadata.width").alias("w"), F.col("metadata.height").alias("h"),
        F.posexplode("tracks").alias("place", "t")).select("*", F.posexplode("t.trajectory").alias("step", "p"))
    found = points.where(F.col("p.frame_index").isNotNull()).select(
        "clip_id", F.concat("clip_id", F.lit(":"), F.coalesce("t.track_id", F.lit("None"))).alias("track_id"), F.col("p.frame_index").cast("int").alias("frame_index"),
        F.struct("path", "place", "step").alias("at"), F.struct(F.col("p.time_seconds").alias("time_seconds"), F.round(F.col("p.center.x") / F.col("w"), 6).alias("x"),
                                                                F.round(F.col("p.center.y") / F.col("h"), 6).alias("y")).alias("v"))
    last = found.groupBy("clip_id", "track_id", "frame_index").agg(F.max_by("v", "at").alias("v"))
    return last.select("clip_id", "track_id", "frame_index", "v.*", F.lit(SOURCE).alias("source")), failed


def read_metrics(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(clips, tracks, failed)``. Empty texts of a clip are null; a track's units
    are its own, else its clip's, else pixels."""
    docs, bad = _documents(spark, path, METRICS)
    docs = docs.withColumn("clip_name", F.coalesce("metadata.clip_name", F.lit("clip"))).withColumn("clip_id", F.concat(F.lit(PREFIX), "clip_name"))
    allowed = F.coalesce("metadata.rights_confirmed", F.lit(False))
    failed = bad.unionByName(docs.where(~allowed).select("path", "clip_name", F.lit("rights not confirmed").alias("reason")))
    good = docs.where(allowed).select("*", F.coalesce("metadata.distance_units", F.lit("pixels")).alias("du"), F.coalesce("metadata.speed_units", F.lit("pixels_per_second")).alias("su"))
    clips = good.select("clip_id", F.lit(SOURCE).alias("source"), "clip_name",
                        *(F.nullif(F.col(f"metadata.{c}"), F.lit("")).alias(c) for c in ("source_video", "license", "license_url", "author")),
                        *(F.col(f"metadata.{c}").alias(c) for c in ("fps", "frame_count", "width", "height")),
                        F.coalesce("metadata.calibrated", F.lit(False)).alias("calibrated"), F.col("du").alias("distance_units"), F.col("su").alias("speed_units"))
    t = good.select("clip_id", "du", "su", F.explode("tracks").alias("t"))
    tracks = t.select("clip_id", F.concat("clip_id", F.lit(":"), F.coalesce("t.track_id", F.lit("None"))).alias("track_id"), F.lit(SOURCE).alias("source"),
                      F.coalesce("t.class", F.lit("unknown")).alias("class"), F.coalesce("t.frame_count", F.lit(0)).alias("frame_count"),
                      *(F.col(f"t.{c}").alias(c) for c in ("first_frame", "last_frame", "time_tracked_seconds", "total_distance", "top_speed", "average_speed")),
                      F.coalesce("t.distance_units", "du").alias("distance_units"), F.coalesce("t.speed_units", "su").alias("speed_units"))
    return clips, tracks, failed


def require(failed: DataFrame) -> None:
    """Stop a load that has failed files, naming the first of them."""
    first = failed.orderBy("path").limit(SHOWN).collect()
    if first:
        names = ", ".join(f"{r.clip_name or r.path} ({r.reason})" for r in first)
        raise ValueError(f"{failed.count()} files do not load: {names}")
