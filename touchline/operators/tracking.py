"""Tracking time series: points, per-track summaries and movement metrics.

All per-track work is a window over (clip, track) ordered by frame plus a
grouped aggregation; calibration (a 3 x 3 homography per clip) is fitted per
clip with a grouped pandas function on at most a handful of point pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CV_PREFIX = "cv:"
TRAIL_FRAMES = 20
POINT_LIMIT = 20_000
# fixed values: detector class aliases and targets
CLASS_ALIASES = {"person": "player", "sports ball": "ball"}
TARGET_CLASSES = ("person", "sports ball")


def bbox_center(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """Centre of a box."""
    return (x1 + x2) / 2.0, (y1 + y2) / 2.0


def frame_time(frame: Column, fps: Column) -> Column:
    """Time of a frame, null without a positive fps."""
    return F.when(fps > 0, frame / fps)


def load_track_points(points: DataFrame, width: float, height: float) -> DataFrame:
    """One row per (clip, track, frame) with x, y normalised to the frame
    (rounded 6); the clip id is the ``cv:`` prefixed clip name, which also
    prefixes the track id."""
    if not width or not height:
        raise ValueError("track points need the frame width and height")
    clip = F.concat(F.lit(CV_PREFIX), F.col("clip_name"))
    return points.select(
        clip.alias("clip_id"), F.concat(clip, F.lit(":"), F.col("track_id").cast("string")).alias("track_id"),
        "frame_index", "time_seconds",
        F.round(F.col("cx") / float(width), 6).alias("x"), F.round(F.col("cy") / float(height), 6).alias("y"))


def track_summary(points: DataFrame) -> DataFrame:
    """Per track: majority class (ties: the class seen first), frame
    count, first and last frame."""
    per_class = points.groupBy("clip_name", "track_id", "class").agg(
        F.count(F.lit(1)).alias("n"), F.min("frame_index").alias("first_seen"), F.max("frame_index").alias("last_seen"))
    return per_class.groupBy("clip_name", "track_id").agg(
        F.sum("n").alias("frame_count"), F.min("first_seen").alias("first_frame"), F.max("last_seen").alias("last_frame"),
        F.max_by("class", F.struct(F.col("n"), -F.col("first_seen"))).alias("class"))


def replay_tracks(points: DataFrame, classes: DataFrame) -> DataFrame:
    """K8: the points of every track of a clip in the order of frames, as lists of
    frame, time, x and y; a clip has its first POINT_LIMIT points by track and
    frame, of which those without a place are left out. A track's class is that
    of ``classes`` (clip_id, track_id, class), else 'player'; a clip's frames are
    its highest frame + 1."""
    first = Window.partitionBy("clip_id").orderBy("track_id", "frame_index")
    capped = points.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= POINT_LIMIT)
    placed = capped.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    point = F.struct("frame_index", "time_seconds", "x", "y")
    tracks = (placed.groupBy("clip_id", "track_id")
              .agg(F.count(F.lit(1)).alias("points"), F.max("frame_index").alias("last_frame"), F.array_sort(F.collect_list(point)).alias("path"))
              .join(classes, ["clip_id", "track_id"], "left"))
    return tracks.select(
        "clip_id", "track_id", F.coalesce("class", F.lit("player")).alias("track_class"), "points", "last_frame",
        (F.max("last_frame").over(Window.partitionBy("clip_id")) + 1).alias("frame_count"),
        F.col("path.frame_index").alias("frames"), F.col("path.time_seconds").alias("times"), F.col("path.x").alias("xs"), F.col("path.y").alias("ys"))


def track_movement(points: DataFrame, x: str = "cx", y: str = "cy") -> DataFrame:
    """Distance (sum of segments), top speed over segments with dt > 0,
    time tracked (last - first known time), average speed; rounded to 3."""
    w = Window.partitionBy("clip_name", "track_id").orderBy("frame_index")
    dx = F.col(x) - F.lag(x).over(w)
    dy = F.col(y) - F.lag(y).over(w)
    dt = F.col("time_seconds") - F.lag("time_seconds").over(w)
    seg = points.select("clip_name", "track_id", "time_seconds", "frame_index",
                        F.sqrt(dx * dx + dy * dy).alias("seg"), dt.alias("dt"))
    speed = F.when(F.col("dt") > 0, F.col("seg") / F.col("dt"))
    timed = F.when(F.col("time_seconds").isNotNull(), F.col("frame_index"))
    # the window's order by track also serves the aggregation: one shuffle
    j = seg.groupBy("clip_name", "track_id").agg(
        F.coalesce(F.sum("seg"), F.lit(0.0)).alias("dist"), F.coalesce(F.max(speed), F.lit(0.0)).alias("top"),
        F.min_by("time_seconds", timed).alias("t0"), F.max_by("time_seconds", timed).alias("t1"), F.count("time_seconds").alias("nt"))
    tracked = F.when((F.col("nt") >= 2) & (F.col("t1") - F.col("t0") > 0), F.col("t1") - F.col("t0")).otherwise(0.0)
    return j.select("clip_name", "track_id",
                    F.round(tracked, 3).alias("time_tracked_seconds"),
                    F.round("dist", 3).alias("total_distance"),
                    F.round("top", 3).alias("top_speed"),
                    F.round(F.when(tracked > 0, F.col("dist") / tracked).otherwise(0.0), 3).alias("average_speed"))


def metric_units(calibrated: Column, pitch_units: Column) -> tuple[Column, Column]:
    """Distance and speed unit names."""
    base = F.when(calibrated, pitch_units).otherwise(F.lit("pixels"))
    return base, F.concat(base, F.lit("_per_second"))


def calibrated_movement(points: DataFrame, homographies: DataFrame, pitch_units: str) -> DataFrame:
    """N3 after N5: the points of clips with a homography are projected to the
    pitch before distances are measured; those of other clips stay pixels. The
    unit names say which."""
    known = homographies.select("clip_id").distinct().withColumn("calibrated", F.lit(True))
    own = points.withColumn("clip_id", F.concat(F.lit(CV_PREFIX), F.col("clip_name")))
    placed = apply_calibration(own.select("clip_id", "track_id", "frame_index", F.col("cx").alias("x"), F.col("cy").alias("y")), homographies)
    placed = placed.select("clip_id", "track_id", "frame_index", "pitch_x", "pitch_y")
    both = own.join(placed, ["clip_id", "track_id", "frame_index"], "left").select(
        "clip_name", "track_id", "frame_index", "time_seconds", F.coalesce("pitch_x", "cx").alias("x"), F.coalesce("pitch_y", "cy").alias("y"))
    moved = track_movement(both, "x", "y").withColumn("clip_id", F.concat(F.lit(CV_PREFIX), F.col("clip_name"))).join(known, "clip_id", "left")
    distance, speed = metric_units(F.coalesce("calibrated", F.lit(False)), F.lit(pitch_units))
    return moved.select("clip_id", "track_id", "time_tracked_seconds", "total_distance", "top_speed", "average_speed",
                        distance.alias("distance_units"), speed.alias("speed_units"))


def license_lookup(clips: DataFrame, licences: DataFrame) -> DataFrame:
    """Licence by lower-cased file base name, else 'unknown'."""
    base = F.lower(F.regexp_extract(F.col("source_video"), r"([^/\\]+)$", 1))
    c = clips.withColumn("__base", base)
    lic = licences.select(F.lower("file_name").alias("__base"), "license")
    return c.join(lic, "__base", "left").withColumn("license", F.coalesce("license", F.lit("unknown"))).drop("__base")


def frame_stride_cap(frames: DataFrame, stride: int, fps: float, seconds: float | None, max_frames: int | None) -> DataFrame:
    """Every ``stride``-th frame, at most min(int(seconds*fps), max_frames)."""
    caps = [c for c in ((int(seconds * fps) if seconds else None), max_frames) if c]
    kept = frames.where(F.col("frame_index") % stride == 0)
    if caps:
        kept = kept.where(F.col("frame_index") < min(caps))
    return kept


def detection_filter(detections: DataFrame, min_confidence: float) -> DataFrame:
    """Target classes only, aliased to neutral names, confidence floor."""
    alias = F.create_map(*[x for k, v in CLASS_ALIASES.items() for x in (F.lit(k), F.lit(v))])
    return (detections.where(F.col("class").isin(*TARGET_CLASSES) & (F.col("confidence") >= min_confidence))
            .withColumn("class", F.element_at(alias, F.col("class"))))


# ------------------------------------------------------------ calibration
def _unit_scaled(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points in homogeneous form around 0 with a mean distance of sqrt(2), and the map that does this."""
    centre = points.mean(axis=0)
    scale = np.sqrt(2) / max(float(np.linalg.norm(points - centre, axis=1).mean()), 1e-12)
    to_unit = np.array([[scale, 0, -scale * centre[0]], [0, scale, -scale * centre[1]], [0, 0, 1]])
    return np.c_[points, np.ones(len(points))] @ to_unit.T, to_unit


def homography(pixels: np.ndarray, pitch: np.ndarray) -> np.ndarray:
    """The matrix H with pitch x (H pixel) = 0 in least squares over all pairs,
    solved on scaled points; its last element is 1."""
    p, p_unit = _unit_scaled(pixels)
    q, q_unit = _unit_scaled(pitch)
    none = np.zeros_like(p)
    cross = np.block([[none, -p, q[:, [1]] * p], [p, none, -q[:, [0]] * p]])
    least = np.linalg.svd(cross)[2][-1].reshape(3, 3)
    h = np.linalg.solve(q_unit, least @ p_unit)
    if abs(h[2, 2]) < 1e-12 * np.linalg.norm(h):
        raise ValueError("degenerate homography")
    return h / h[2, 2]


def calibrate_clips(pairs: DataFrame) -> DataFrame:
    """One homography per clip from >= 4 (pixel, pitch) pairs (DLT by SVD).

    ``pairs``: clip_id, px, py, X, Y. Each group is one clip's few pairs.
    """
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < 4:
            raise ValueError(f"clip {pdf['clip_id'].iloc[0]}: at least 4 point pairs are needed")
        h = homography(pdf[["px", "py"]].to_numpy(float), pdf[["X", "Y"]].to_numpy(float))
        return pd.DataFrame([[pdf["clip_id"].iloc[0], *h.ravel().tolist()]],
                            columns=["clip_id"] + [f"h{i}" for i in range(9)])

    schema = "clip_id string, " + ", ".join(f"h{i} double" for i in range(9))
    return pairs.groupBy("clip_id").applyInPandas(fit, schema)


def apply_calibration(points: DataFrame, homographies: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Project points with their clip's homography; scale 0 is an error."""
    # one row per clip; Spark broadcasts it only when its measured size allows
    j = points.join(homographies, "clip_id")
    w = F.col("h6") * F.col(x) + F.col("h7") * F.col(y) + F.col("h8")
    checked = F.when(w == 0, F.raise_error(F.lit("point maps to infinity (scale 0)"))).otherwise(w)
    return j.select(*points.columns,
                    ((F.col("h0") * F.col(x) + F.col("h1") * F.col(y) + F.col("h2")) / checked).alias("pitch_x"),
                    ((F.col("h3") * F.col(x) + F.col("h4") * F.col(y) + F.col("h5")) / checked).alias("pitch_y"))
