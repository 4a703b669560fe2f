"""Remaining loaders and lookups: lineups, squads, clip metrics and the rights
gate, calibration, licences, glossary load, cache appends, featured entities,
follow cards, report sink and the published-grid path of xT."""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, LongType, StringType, StructField,
                               StructType)

from ..operators import tracking as TR
from ..operators import xt as XT
from ..session import scratch_path
from ..sources.projections import SOURCE_EVENTS, SOURCE_FEED, MatchData
from .catalog import register
from .replay import track_metrics, track_points
from .valuation import _rounded, shot_xg, spadl


def _landing(md: MatchData, name: str) -> str:
    return scratch_path(md.spark, f"landing/{name}-{uuid.uuid4().hex[:12]}")


POSITIONS = ("Goalkeeper", "Defender", "Midfielder", "Attacker")


def _pos(expr: F.Column) -> F.Column:
    out = None
    for i, p in enumerate(POSITIONS):
        out = F.when(expr == i, p) if out is None else out.when(expr == i, p)
    return out


# -------------------------------------------------------------------- A5
LINEUP_SCHEMA = StructType([
    StructField("match_id", LongType()), StructField("team_id", LongType()), StructField("team_name", StringType()),
    StructField("lineup", ArrayType(StructType([
        StructField("player_id", LongType()), StructField("player_name", StringType()),
        StructField("player_nickname", StringType()), StructField("jersey_number", LongType()),
        StructField("country", StructType([StructField("name", StringType())])),
        StructField("positions", ArrayType(StructType([StructField("position", StringType())])))])))])


def land_lineups(md: MatchData) -> str:
    """Each team's eleven in each match (jersey and position move with the match)."""
    path = _landing(md, "lineups")
    m = md.matches.where(F.col("source") == SOURCE_EVENTS).select(
        "match_id", F.explode(F.array(F.struct(F.col("home_team_id").alias("t"), F.col("home_team_name").alias("tn")),
                                      F.struct(F.col("away_team_id").alias("t"), F.col("away_team_name").alias("tn")))).alias("s"))
    slots = F.sequence(F.lit(0), F.lit(10))
    players = F.transform(slots, lambda n: F.struct(
        (F.col("s.t").cast("long") * 100 + n).alias("player_id"),
        F.concat(F.col("s.tn"), F.lit(" "), n.cast("string")).alias("player_name"),
        F.lit(None).cast("string").alias("player_nickname"),
        (n + 1 + F.col("match_id") % 3).cast("long").alias("jersey_number"),
        F.struct(F.lit("Land").alias("name")).alias("country"),
        F.array(F.struct(_pos((n + F.col("match_id")) % 4).alias("position")),
                F.struct(_pos((n + F.col("match_id")) % 4).alias("position")),
                F.struct(_pos((n + 1) % 4).alias("position"))).alias("positions")))
    m.select("match_id", F.col("s.t").cast("long").alias("team_id"), F.col("s.tn").alias("team_name"),
             players.alias("lineup")).write.json(path)
    return path


def read_lineups(md: MatchData, path: str) -> DataFrame:
    """A5: per team, every lineup of its matches; the last (by match date, id)
    row per player wins; its distinct positions in sorted order."""
    lu = md.spark.read.schema(LINEUP_SCHEMA).json(path).select(
        "team_id", "lineup", F.coalesce("match_id", F.regexp_extract(F.col("_metadata.file_path"), r"(?:match_id=|/)(\d+)(?:/[^/]*)?(?:\.json)?$", 1)
                                        .try_cast("bigint")).alias("match_id"))
    order = md.matches.select("match_id", "match_date")
    ex = lu.select("match_id", F.col("team_id").cast("string").alias("team_id"), F.explode("lineup").alias("p")).join(order, "match_id")
    last = ex.groupBy("team_id", F.col("p.player_id").cast("string").alias("player_id")).agg(
        F.max_by("p", F.struct("match_date", "match_id")).alias("p"))
    return last.select("team_id", "player_id", F.col("p.player_name").alias("name"),
                       F.col("p.player_nickname").alias("display_name"), F.col("p.country.name").alias("country"),
                       F.col("p.jersey_number").cast("int").alias("jersey_number"),
                       F.array_sort(F.array_distinct(F.transform("p.positions", lambda x: x["position"]))).alias("positions"))


@register("read_lineups", """
SELECT team_id, player_id, name, NULL::varchar AS display_name, 'Land' AS country, jersey_number,
       CASE WHEN p1 = p2 THEN [p1] ELSE [least(p1, p2), greatest(p1, p2)] END AS positions FROM (
  SELECT s.team_id, cast(cast(s.team_id AS bigint) * 100 + n AS varchar) AS player_id, s.tn || ' ' || cast(n AS varchar) AS name,
         cast(n + 1 + s.match_id % 3 AS integer) AS jersey_number,
         ['Goalkeeper', 'Defender', 'Midfielder', 'Attacker'][cast((n + s.match_id) % 4 AS integer) + 1] AS p1,
         ['Goalkeeper', 'Defender', 'Midfielder', 'Attacker'][cast((n + 1) % 4 AS integer) + 1] AS p2,
         row_number() OVER (PARTITION BY s.team_id, n ORDER BY s.match_date DESC, s.match_id DESC) AS rn
  FROM (SELECT match_id, match_date, home_team_id AS team_id, home_team_name AS tn FROM v_matches WHERE source = 'statsbomb'
        UNION ALL SELECT match_id, match_date, away_team_id, away_team_name FROM v_matches WHERE source = 'statsbomb') s,
       (SELECT cast(range AS integer) AS n FROM range(11)) k) x
WHERE rn = 1
""", ("v_matches",))
def read_lineups_query(md: MatchData) -> DataFrame:
    return read_lineups(md, land_lineups(md))


# -------------------------------------------------------------------- A9
SQUAD_SCHEMA = StructType([
    StructField("team", StructType([StructField("id", LongType()), StructField("name", StringType())])),
    StructField("players", ArrayType(StructType([
        StructField("id", LongType()), StructField("name", StringType()), StructField("age", LongType()),
        StructField("number", LongType()), StructField("position", StringType())])))])


@register("squads_to_players", """
SELECT 'af:4' AS team_id, cast(cast(substr(p.team_id, 4) AS bigint) * 100 + cast(split_part(p.player_id, '-P', 2) AS bigint) AS varchar) AS player_id,
       p.name, p.jersey_number,
       CASE WHEN cast(split_part(p.player_id, '-P', 2) AS int) % 4 = 3 THEN [] ELSE [['Goalkeeper', 'Defender', 'Midfielder', 'Attacker'][cast(split_part(p.player_id, '-P', 2) AS int) % 4 + 1]] END AS positions
FROM v_players p WHERE p.team_id = (SELECT min(team_id) FROM v_teams WHERE source = 'api_football' AND team_id <> 'af:4')
""", ("v_players", "v_teams"))
def squads_to_players(md: MatchData) -> DataFrame:
    """The squad of the asked team, else the first squad; positions =
    [position] or []. Asked for team 4, which has no squad in the response."""
    path = _landing(md, "squads")
    p = md.players.where(F.col("source") == SOURCE_FEED)
    n = F.regexp_extract("player_id", r"-P(\d+)$", 1).cast("int")
    squads = p.groupBy("team_id").agg(F.array_sort(F.collect_list(F.struct(
        (F.regexp_replace("team_id", "^af:", "").cast("long") * 100 + n).alias("id"), F.col("name"),
        F.lit(25).cast("long").alias("age"), F.col("jersey_number").cast("long").alias("number"),
        F.when(n % 4 != 3, _pos(n % 4)).alias("position")))).alias("players"))
    squads.where(F.col("team_id") != "af:4").select(
        F.struct(F.regexp_replace("team_id", "^af:", "").cast("long").alias("id"), F.lit("x").alias("name")).alias("team"),
        "players").write.json(path)
    sq = md.spark.read.schema(SQUAD_SCHEMA).json(path)
    asked = 4
    # the asked team's squad, else the first one by id (a one-row choice)
    pick = sq.select("team", "players", F.when(F.col("team.id") == asked, 0).otherwise(1).alias("miss"),
                     F.col("team.id").cast("string").alias("tid")).orderBy("miss", "tid").limit(1)
    ex = pick.select(F.explode("players").alias("pl"))
    return ex.select(F.lit(f"af:{asked}").alias("team_id"), F.col("pl.id").cast("string").alias("player_id"),
                     F.col("pl.name").alias("name"), F.col("pl.number").cast("int").alias("jersey_number"),
                     F.when(F.col("pl.position").isNotNull(), F.array("pl.position")).otherwise(
                         F.array().cast("array<string>")).alias("positions"))


# ------------------------------------------------------------- A12 / A13
METRICS_SCHEMA = StructType([
    StructField("metadata", StructType([StructField(n, t) for n, t in (
        ("clip_name", StringType()), ("source_video", StringType()), ("license", StringType()),
        ("license_url", StringType()), ("author", StringType()), ("fps", DoubleType()), ("width", LongType()),
        ("height", LongType()), ("frame_count", LongType()), ("calibrated", BooleanType()),
        ("distance_units", StringType()), ("speed_units", StringType()), ("rights_confirmed", BooleanType()))])),
    StructField("tracks", ArrayType(StructType([StructField(n, t) for n, t in (
        ("track_id", StringType()), ("class", StringType()), ("frame_count", LongType()), ("first_frame", LongType()),
        ("last_frame", LongType()), ("time_tracked_seconds", DoubleType()), ("total_distance", DoubleType()),
        ("top_speed", DoubleType()), ("average_speed", DoubleType()))])))])


def land_clip_metrics(md: MatchData) -> str:
    """One metrics file per clip; every 13th clip lacks confirmed rights and
    every 3rd has an empty licence string."""
    path = _landing(md, "clip-metrics")
    t = track_metrics(md)
    per_clip = t.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct(
        "track_id", "class", F.col("frame_count").cast("long").alias("frame_count"),
        F.col("first_frame").cast("long").alias("first_frame"), F.col("last_frame").cast("long").alias("last_frame"),
        "time_tracked_seconds", "total_distance", "top_speed", "average_speed"))).alias("tracks"))
    m = F.regexp_extract("clip_id", r"(\d+)$", 1).cast("long")
    per_clip.select(F.struct(
        F.regexp_replace("clip_id", "^cv:", "").alias("clip_name"),
        F.concat(F.lit("/videos/Clip_"), m.cast("string"), F.lit(".MP4")).alias("source_video"),
        F.when(m % 3 == 0, F.lit("")).otherwise(F.lit("CC-BY-4.0")).alias("license"),
        F.lit(None).cast("string").alias("license_url"), F.lit("")
        .alias("author"), F.lit(25.0).alias("fps"), F.lit(120).cast("long").alias("width"),
        F.lit(80).cast("long").alias("height"), F.lit(None).cast("long").alias("frame_count"),
        F.lit(False).alias("calibrated"), F.lit(None).cast("string").alias("distance_units"),
        F.lit(None).cast("string").alias("speed_units"), (m % 13 != 0).alias("rights_confirmed")).alias("metadata"),
        "tracks").write.json(path)
    return path


def load_clip_metrics(md: MatchData) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A12 + A13: cv_clips and cv_track_metrics rows ('cv:' ids, defaults,
    empty text -> null); clips without confirmed rights are refused."""
    raw = md.spark.read.schema(METRICS_SCHEMA).json(land_clip_metrics(md))
    ok = F.coalesce(F.col("metadata.rights_confirmed"), F.lit(False))
    refused = raw.where(~ok).select(F.col("metadata.clip_name").alias("clip_name"))
    good = raw.where(ok)
    clip_id = F.concat(F.lit(TR.CV_PREFIX), F.coalesce("metadata.clip_name", F.lit("clip")))
    dist_u = F.coalesce("metadata.distance_units", F.lit("pixels"))
    speed_u = F.coalesce("metadata.speed_units", F.lit("pixels_per_second"))
    clips = good.select(
        clip_id.alias("clip_id"), F.lit("broadcast_cv").alias("source"),
        F.coalesce("metadata.clip_name", F.lit("clip")).alias("clip_name"),
        *[F.nullif(F.col(f"metadata.{c}"), F.lit("")).alias(c) for c in ("source_video", "license", "license_url", "author")],
        F.col("metadata.fps").alias("fps"), F.coalesce("metadata.calibrated", F.lit(False)).alias("calibrated"),
        dist_u.alias("distance_units"), speed_u.alias("speed_units"))
    tracks = good.select(clip_id.alias("clip_id"), dist_u.alias("du"), speed_u.alias("su"),
                         F.explode("tracks").alias("t")).select(
        "clip_id", F.concat("clip_id", F.lit(":"), F.col("t.track_id")).alias("track_id"),
        F.coalesce("t.class", F.lit("unknown")).alias("class"), F.coalesce("t.frame_count", F.lit(0)).alias("frame_count"),
        F.col("t.total_distance").alias("total_distance"), F.col("du").alias("distance_units"),
        F.col("su").alias("speed_units"))
    return clips, tracks, refused


@register("load_clip_metrics", f"""
SELECT 'cv:' || cast(match_id AS varchar) AS clip_id, 'broadcast_cv' AS source, cast(match_id AS varchar) AS clip_name,
       '/videos/Clip_' || cast(match_id AS varchar) || '.MP4' AS source_video,
       CASE WHEN match_id % 3 = 0 THEN NULL ELSE 'CC-BY-4.0' END AS license, NULL::varchar AS license_url,
       NULL::varchar AS author, 25.0::double AS fps, false AS calibrated, 'pixels' AS distance_units, 'pixels_per_second' AS speed_units
FROM (SELECT DISTINCT match_id FROM v_events WHERE location_x IS NOT NULL AND location_y IS NOT NULL) c WHERE match_id % 13 <> 0
""", ("v_events",))
def load_clip_metrics_query(md: MatchData) -> DataFrame:
    return load_clip_metrics(md)[0]


@register("rights_gate", """
SELECT DISTINCT cast(match_id AS varchar) AS clip_name FROM v_events
WHERE location_x IS NOT NULL AND location_y IS NOT NULL AND match_id % 13 = 0
""", ("v_events",))
def rights_gate(md: MatchData) -> DataFrame:
    """The refused clips (the loader fails when this is not empty)."""
    return load_clip_metrics(md)[2]


# ------------------------------------------------------------- N4 / N5 / N7
def _true_h(clip_num: F.Column) -> list[F.Column]:
    """The known pixel -> pitch homography of a clip (scale, offset, mild perspective)."""
    s = 105.0 / 120.0
    k = (clip_num % 7) / 100000.0
    return [F.lit(s), F.lit(0.0), clip_num % 5, F.lit(0.0), F.lit(68.0 / 80.0), F.lit(0.0), k, F.lit(0.0), F.lit(1.0)]


def calibration_pairs(md: MatchData) -> DataFrame:
    """Four frame corners + centre per clip, with their pitch positions."""
    clips = track_points(md).select(F.col("clip_name")).distinct()
    n = clips.select(F.concat(F.lit("cv:"), "clip_name").alias("clip_id"), F.col("clip_name").cast("long").alias("num"))
    corners = F.array(*[F.struct(F.lit(float(x)).alias("px"), F.lit(float(y)).alias("py"))
                        for x, y in ((0, 0), (120, 0), (120, 80), (0, 80), (60, 40))])
    pts = n.select("clip_id", "num", F.explode(corners).alias("c")).select("clip_id", "num", "c.px", "c.py")
    h = _true_h(F.col("num"))
    w = h[6] * F.col("px") + h[7] * F.col("py") + h[8]
    return pts.select("clip_id", "px", "py",
                      ((h[0] * F.col("px") + h[1] * F.col("py") + h[2]) / w).alias("X"),
                      ((h[3] * F.col("px") + h[4] * F.col("py") + h[5]) / w).alias("Y"))


@register("calibrate_clips", """
SELECT DISTINCT 'cv:' || clip_name AS clip_id, 0.875::double AS h0, 0.0::double AS h1, (clip_name::bigint % 5)::double AS h2,
       0.0::double AS h3, 0.85::double AS h4, 0.0::double AS h5, (clip_name::bigint % 7) / 100000.0 AS h6, 0.0::double AS h7, 1.0::double AS h8
FROM v_track_points
""", ("v_track_points",))
def calibrate_clips(md: MatchData) -> DataFrame:
    """The fitted matrices; the points were made with known ones."""
    h = TR.calibrate_clips(calibration_pairs(md))
    return h.select("clip_id", *((F.round(f"h{i}", 6) + 0.0).alias(f"h{i}") for i in range(9)))


@register("calibrated_movement", """
SELECT s.clip_id, s.track_id, round(t, 3) AS time_tracked_seconds, round(coalesce(d, 0), 3) AS total_distance,
       round(coalesce(v, 0), 3) AS top_speed, CASE WHEN even THEN 'meters' ELSE 'pixels' END AS distance_units,
       CASE WHEN even THEN 'meters' ELSE 'pixels' END || '_per_second' AS speed_units
FROM spans s LEFT JOIN (SELECT clip_id, track_id, sum(d) AS d, max(CASE WHEN dt > 0 THEN d / dt END) AS v FROM steps GROUP BY ALL) m
  ON m.clip_id = s.clip_id AND m.track_id = s.track_id
""", ("v_track_points",), {
    "placed": """
  SELECT 'cv:' || clip_name AS clip_id, track_id, frame_index, time_seconds, even,
         CASE WHEN even THEN (0.875 * cx + n % 5) / w ELSE cx END AS x, CASE WHEN even THEN 0.85 * cy / w ELSE cy END AS y
  FROM (SELECT *, n % 2 = 0 AS even, (n % 7) / 100000.0 * cx + 1.0 AS w FROM (SELECT *, clip_name::bigint AS n FROM v_track_points))""",
    "steps": """
  SELECT a.clip_id, a.track_id, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS d, b.time_seconds - a.time_seconds AS dt
  FROM placed a ASOF JOIN placed b ON b.clip_id = a.clip_id AND b.track_id = a.track_id AND b.frame_index > a.frame_index""",
    "spans": """SELECT clip_id, track_id, even, max(time_seconds) - min(time_seconds) AS t FROM placed GROUP BY ALL"""})
def calibrated_movement(md: MatchData) -> DataFrame:
    """N3 with every second clip calibrated."""
    pairs = calibration_pairs(md).where(F.regexp_extract("clip_id", r"(\d+)$", 1).cast("long") % 2 == 0)
    out = TR.calibrated_movement(track_points(md), TR.calibrate_clips(pairs), "meters")
    return out.select("clip_id", "track_id", "time_tracked_seconds", "total_distance",
                      "top_speed", "distance_units", "speed_units")


@register("apply_calibration", """
SELECT 'cv:' || clip_name AS clip_id, track_id, frame_index,
       round((105.0 / 120.0 * cx + cast(clip_name AS bigint) % 5) / ((cast(clip_name AS bigint) % 7) / 100000.0 * cx + 1.0), 4) AS pitch_x,
       round((68.0 / 80.0 * cy) / ((cast(clip_name AS bigint) % 7) / 100000.0 * cx + 1.0), 4) AS pitch_y
FROM v_track_points
""", ("v_track_points",))
def apply_calibration(md: MatchData) -> DataFrame:
    """Every tracked point projected with its clip's fitted homography."""
    h = TR.calibrate_clips(calibration_pairs(md))
    pts = track_points(md).select(F.concat(F.lit("cv:"), "clip_name").alias("clip_id"), "track_id", "frame_index",
                                  F.col("cx").alias("x"), F.col("cy").alias("y"))
    out = TR.apply_calibration(pts, h)
    return out.select("clip_id", "track_id", "frame_index", F.round("pitch_x", 4).alias("pitch_x"),
                      F.round("pitch_y", 4).alias("pitch_y"))


@register("clip_license_lookup", """
SELECT 'cv:' || cast(match_id AS varchar) AS clip_id, CASE WHEN match_id % 3 = 0 THEN 'CC-BY-4.0' ELSE 'unknown' END AS license
FROM v_matches
""", ("v_matches",))
def clip_license_lookup(md: MatchData) -> DataFrame:
    """Licence by lower-cased file base name; unknown without an entry."""
    clips = md.matches.select(F.concat(F.lit("cv:"), F.col("match_id").cast("string")).alias("clip_id"),
                              F.concat(F.lit("/videos/Clip_"), F.col("match_id").cast("string"), F.lit(".MP4")).alias("source_video"))
    lic = md.matches.where(F.col("match_id") % 3 == 0).select(
        F.concat(F.lit("CLIP_"), F.col("match_id").cast("string"), F.lit(".mp4")).alias("file_name"),
        F.lit("CC-BY-4.0").alias("license"))
    return TR.license_lookup(clips, lic).select("clip_id", "license")


# ------------------------------------------------------------------ A24
GLOSSARY_DIM = 64


def glossary(md: MatchData) -> DataFrame:
    """Glossary stand-in: one term per part joined to the stored vector of the same id."""
    p = md.read("part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    e = md.read("embeddings", "vec_id", "embedding")
    return p.join(e, p.p_partkey == e.vec_id).select(
        F.col("p_partkey").alias("term_id"), F.col("p_name").alias("term"),
        F.array("p_brand", F.upper("p_name")).alias("aliases"), F.lower("p_type").alias("category"),
        F.concat(F.lit("A "), F.col("p_name"), F.lit(" of size "), F.col("p_size").cast("string")).alias("definition"),
        F.array(F.lit("part")).alias("related_tables"), F.array(F.lit("p_name"), F.lit("p_type")).alias("related_columns"),
        F.array(F.col("p_size").cast("string")).alias("value_examples"), "embedding")


@register("glossary_load", f"""
SELECT p_partkey AS term_id,
       'term: ' || p_name || chr(10) || 'aliases: ' || p_brand || ', ' || upper(p_name) || chr(10) ||
       'category: ' || lower(p_type) || chr(10) || 'definition: A ' || p_name || ' of size ' || cast(p_size AS varchar) || chr(10) ||
       'tables: part' || chr(10) || 'columns: p_name, p_type' || chr(10) || 'values: ' || cast(p_size AS varchar) AS embedding_text,
       len(e.embedding) = {GLOSSARY_DIM} AS dimension_ok
FROM part JOIN embeddings e ON e.vec_id = p_partkey
""")
def glossary_load(md: MatchData) -> DataFrame:
    """The seven labelled lines embedded per term, plus the dimension check."""
    g = glossary(md)
    text = F.concat_ws("\n",
                       F.concat(F.lit("term: "), "term"), F.concat(F.lit("aliases: "), F.concat_ws(", ", "aliases")),
                       F.concat(F.lit("category: "), "category"), F.concat(F.lit("definition: "), "definition"),
                       F.concat(F.lit("tables: "), F.concat_ws(", ", "related_tables")),
                       F.concat(F.lit("columns: "), F.concat_ws(", ", "related_columns")),
                       F.concat(F.lit("values: "), F.concat_ws(", ", "value_examples")))
    return g.select("term_id", text.alias("embedding_text"), (F.size("embedding") == GLOSSARY_DIM).alias("dimension_ok"))


# ------------------------------------------------------------------ A27
@register("append_cache_entries")
def append_cache_entries(md: MatchData) -> DataFrame:
    """Answered questions appended to the cache with JSON-encoded columns,
    rows and numbers; appending the same answers twice keeps both copies."""
    from ..operators import vectors as V
    from .services import _entries, _questions
    top = V.nearest(_entries(md), _questions(md), 3)
    answers = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "entry_id", "distance"))).alias("rows"))
    q = _questions(md).select("query_id", "language")
    entry = answers.join(q, "query_id").select(
        "query_id", "language", F.to_json(F.array(F.lit("entry_id"), F.lit("distance"))).alias("columns_json"),
        F.to_json("rows").alias("rows_json"),
        F.to_json(F.transform("rows", lambda r: r["entry_id"])).alias("numbers_json"),
        F.size("rows").alias("row_count"), F.lit(False).alias("truncated"))
    return entry.withColumn("run", F.lit(1)).unionByName(entry.withColumn("run", F.lit(2)))


# ------------------------------------------------------------------ A23
@register("write_report")
def write_report(md: MatchData) -> DataFrame:
    """The backtest report's JSON part written as a one-row JSON file, read back."""
    from .forecast import backtest_report
    path = _landing(md, "report")
    backtest_report(md).coalesce(1).write.json(path)
    return md.spark.read.json(path)


# ------------------------------------------------------------------- E6
@register("xt_published_grid", "SELECT cell, round(xt, 6) AS xt FROM v_xt_grid", ("v_xt_grid",))
def xt_published_grid(md: MatchData) -> DataFrame:
    """A grid given as a local JSON file (8 rows of 12, top row first) is
    preferred; here the fitted grid is published to a file and loaded back."""
    from .valuation import xt_grid
    rows = xt_grid(md).orderBy("cell").collect()  # 96 values (bounded by the grid)
    flat = np.array([r["xt"] for r in rows])
    grid = [[float(flat[(XT.W_CELLS - 1 - r) * XT.L_CELLS + c]) for c in range(XT.L_CELLS)] for r in range(XT.W_CELLS)]
    path = _landing(md, "xt-grid")
    md.spark.createDataFrame([(json.dumps(grid),)], "value string").coalesce(1).write.text(path)
    return _rounded(XT.load_grid(md.spark, path), "xt")
