"""Readers for the two provider feeds' landed JSON files -> neutral rows.

Every reader uses an explicit schema (no inference) and column expressions
only; nested structs are addressed by field, arrays are exploded. Match and
fixture ids that only live in a file path come from ``_metadata.file_path``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, LongType, StringType, StructField,
                               StructType)

from ..functions import labels as L
from . import envelopes

EVENTS_SOURCE = "statsbomb"
FEED_SOURCE = "api_football"
FEED_PREFIX = "af:"


def _s(*fields) -> StructType:
    return StructType([StructField(n, t) for n, t in fields])


NAMED = _s(("name", StringType()))
ID_NAME = _s(("id", LongType()), ("name", StringType()))
LOCATION = ArrayType(DoubleType())

COMPETITION_SCHEMA = _s(
    ("competition_id", LongType()), ("season_id", LongType()), ("country_name", StringType()),
    ("competition_name", StringType()), ("competition_gender", StringType()), ("competition_youth", BooleanType()),
    ("competition_international", BooleanType()), ("season_name", StringType()))

MATCH_SCHEMA = _s(
    ("match_id", LongType()), ("match_date", StringType()), ("kick_off", StringType()),
    ("competition", _s(("competition_id", LongType()), ("competition_name", StringType()))),
    ("season", _s(("season_id", LongType()), ("season_name", StringType()))),
    ("home_team", _s(("home_team_id", LongType()), ("home_team_name", StringType()))),
    ("away_team", _s(("away_team_id", LongType()), ("away_team_name", StringType()))),
    ("home_score", LongType()), ("away_score", LongType()), ("match_status", StringType()),
    ("competition_stage", NAMED), ("stadium", NAMED), ("referee", NAMED))

DETAIL = _s(("end_location", LOCATION), ("outcome", NAMED), ("body_part", NAMED), ("type", NAMED),
            ("cross", BooleanType()))
EVENT_SCHEMA = _s(
    ("match_id", LongType()), ("id", StringType()), ("index", LongType()), ("period", LongType()), ("minute", LongType()), ("second", LongType()),
    ("type", NAMED), ("team", ID_NAME), ("player", ID_NAME), ("possession_team", ID_NAME), ("play_pattern", NAMED),
    ("under_pressure", BooleanType()), ("location", LOCATION), ("duration", DoubleType()),
    ("pass", DETAIL), ("shot", DETAIL), ("carry", DETAIL), ("dribble", DETAIL), ("duel", DETAIL),
    ("goalkeeper", DETAIL), ("interception", DETAIL), ("ball_receipt", DETAIL))

LEAGUE_SCHEMA = _s(("league", _s(("id", LongType()), ("name", StringType()), ("type", StringType()))),
                   ("country", _s(("name", StringType()), ("code", StringType()))),
                   ("seasons", ArrayType(_s(("year", LongType())))))

FIXTURE_SCHEMA = _s(
    ("fixture", _s(("id", LongType()), ("date", StringType()), ("timezone", StringType()), ("referee", StringType()),
                   ("venue", _s(("name", StringType()), ("city", StringType()))),
                   ("status", _s(("short", StringType()), ("long", StringType()))))),
    ("league", _s(("id", LongType()), ("name", StringType()), ("season", LongType()), ("round", StringType()))),
    ("teams", _s(("home", ID_NAME), ("away", ID_NAME))),
    ("goals", _s(("home", LongType()), ("away", LongType()))))

SQUAD_SCHEMA = _s(("team", ID_NAME), ("players", ArrayType(_s(
    ("id", LongType()), ("name", StringType()), ("age", LongType()), ("number", LongType()), ("position", StringType())))))

FIXTURE_EVENT = _s(("time", _s(("elapsed", LongType()), ("extra", LongType()))), ("team", ID_NAME),
                   ("player", ID_NAME), ("assist", ID_NAME), ("type", StringType()), ("detail", StringType()),
                   ("comments", StringType()))
#: ``errors`` is a list when empty and an object or a list otherwise, so it is read as its JSON text.
FIXTURE_EVENTS_SCHEMA = _s(("fixture_id", LongType()), ("errors", StringType()),
                           ("response", ArrayType(FIXTURE_EVENT)))


def _json(spark: SparkSession, path: str, schema: StructType, multiline: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


#: Schema and required fields of the landed kinds whose files may be arrays, envelopes or lines.
def _kinds() -> dict[str, tuple[StructType, tuple[str, ...]]]:
    return {"competitions": (COMPETITION_SCHEMA, ("competition_id", "season_id")), "matches": (MATCH_SCHEMA, ("match_id",)),
            "leagues": (LEAGUE_SCHEMA, ("league.id",)), "fixtures": (FIXTURE_SCHEMA, ("fixture.id", "league.id")),
            "squads": (SQUAD_SCHEMA, ("team.id",))}


def _records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return envelopes.records(spark, path, *_kinds()[kind])


def rejects(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``path, reason, text`` of what a reader of this kind left out."""
    return envelopes.rejects(spark, path, *_kinds()[kind])


def read_competitions(spark: SparkSession, path: str) -> DataFrame:
    """A1: open-data competitions -> neutral competition rows."""
    c = _records(spark, path, "competitions")
    return c.select(
        L.competition_key(F.col("competition_id"), F.col("season_id")).alias("competition_id"),
        F.col("competition_name").alias("name"), F.col("country_name").alias("country"), "season_name",
        L.normalize_gender(F.col("competition_gender")).alias("gender"),
        F.coalesce("competition_international", F.lit(False)).alias("is_international"),
        F.coalesce("competition_youth", F.lit(False)).alias("is_youth"),
        F.lit(EVENTS_SOURCE).alias("source"))


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """A2: open-data matches; the score is kept only when both sides are present."""
    m = _records(spark, path, "matches")
    both = F.col("home_score").isNotNull() & F.col("away_score").isNotNull()
    return m.select(
        "match_id",
        L.competition_key(F.col("competition.competition_id"), F.col("season.season_id")).alias("competition_id"),
        F.col("season.season_name").alias("season_name"),
        F.to_date("match_date").alias("match_date"),
        F.substring("kick_off", 1, 8).alias("kickoff_time"),
        F.col("home_team.home_team_id").cast("string").alias("home_team_id"),
        F.col("home_team.home_team_name").alias("home_team_name"),
        F.col("away_team.away_team_id").cast("string").alias("away_team_id"),
        F.col("away_team.away_team_name").alias("away_team_name"),
        F.when(both, F.col("home_score")).cast("int").alias("home_score"),
        F.when(both, F.col("away_score")).cast("int").alias("away_score"),
        L.normalize_match_status(F.col("match_status")).alias("status"),
        F.col("competition_stage.name").alias("stage"),
        F.col("stadium.name").alias("venue"), F.col("referee.name").alias("referee"),
        F.lit(EVENTS_SOURCE).alias("source"))


def event_records(spark: SparkSession, path: str, multiline: bool) -> DataFrame:
    """Raw events with ``__path`` and ``__match``: the record's own match id (files
    of many matches carry one), else that of the folder or file name, else
    null. Files at any depth are read."""
    e = (spark.read.schema(EVENT_SCHEMA).option("multiLine", multiline).option("recursiveFileLookup", "true").json(path)
         .select("*", F.col("_metadata.file_path").alias("__path")))
    named = F.regexp_extract("__path", r"/(\d+)\.json$", 1)
    folder = F.regexp_extract("__path", r"match_id=(\d+)", 1)
    of_path = F.coalesce(F.when(folder != "", folder), F.when(named != "", named)).try_cast("bigint")
    return e.withColumn("__match", F.coalesce("match_id", of_path))


def unnamed_event_files(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Rejects of :func:`read_events`: event files without a match id, and their event counts."""
    e = event_records(spark, path, multiline).where(F.col("__match").isNull())
    return e.groupBy(F.col("__path").alias("path")).agg(F.count(F.lit(1)).alias("events"))


def read_events(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """A3: open-data events; the match id comes from the file name
    (``<match id>.json``) or a ``match_id=`` folder, index -> sequence, the
    first present detail supplies end location and outcome. Files are the
    provider's pretty-printed arrays (``multiline``) or one record a line.
    Events of files whose name holds no id are left out here: see
    :func:`unnamed_event_files`."""
    e = event_records(spark, path, multiline).where(F.col("__match").isNotNull())
    detail = F.coalesce(*[F.col(d) for d in ("pass", "shot", "carry", "dribble", "duel", "goalkeeper",
                                             "interception", "ball_receipt")])  # B13
    lx, ly = L.split_location(F.col("location"))  # B14
    ex, ey = L.split_location(detail["end_location"])
    has_pass, has_shot = F.col("pass").isNotNull(), F.col("shot").isNotNull()
    ident = lambda c: F.col(c + ".id").cast("string")  # noqa: E731  (bare ids on this feed)
    return e.select(
        F.col("id").alias("event_id"),
        F.col("__match").alias("match_id"),
        F.col("index").cast("int").alias("sequence"), F.col("period").cast("int").alias("period"),
        F.col("minute").cast("int").alias("minute"), F.col("second").cast("int").alias("second"),
        F.col("type.name").alias("type"),
        ident("team").alias("team_id"), F.col("team.name").alias("team_name"),
        ident("player").alias("player_id"), F.col("player.name").alias("player_name"),
        ident("possession_team").alias("possession_team_id"), F.col("possession_team.name").alias("possession_team_name"),
        lx.alias("location_x"), ly.alias("location_y"), ex.alias("end_location_x"), ey.alias("end_location_y"),
        F.col("duration").alias("duration_seconds"),
        detail["outcome"]["name"].alias("outcome"),
        L.map_body_part(F.col("pass.body_part.name"), F.col("shot.body_part.name")).alias("body_part"),  # B2
        F.col("under_pressure"),
        L.map_play_pattern(F.col("play_pattern.name")).alias("play_pattern"),  # B3
        L.cross_flag(has_pass, F.col("pass.cross")).alias("is_cross"),  # B6
        L.map_pass_type(has_pass, F.col("pass.type.name")).alias("pass_type"),  # B4
        L.map_shot_type(has_shot, F.col("shot.type.name")).alias("shot_type"),  # B5
        F.lit(EVENTS_SOURCE).alias("source"))


def leagues_to_competitions(spark: SparkSession, path: str) -> DataFrame:
    """One competition per league x season; gender left 'unknown'."""
    lg = _records(spark, path, "leagues")
    s = lg.select("league", "country", F.explode("seasons").alias("season"))
    return s.select(
        L.competition_key(F.col("league.id"), F.col("season.year")).alias("competition_id"),
        F.col("league.name").alias("name"), F.col("country.name").alias("country"),
        F.col("season.year").cast("string").alias("season_name"), F.lit("unknown").alias("gender"),
        F.lit(FEED_SOURCE).alias("source"))


def fixtures_to_matches(spark: SparkSession, path: str) -> DataFrame:
    """date = first 10 characters, kickoff = characters 12-19 when HH:MM:SS."""
    fx = _records(spark, path, "fixtures")
    d = F.col("fixture.date")
    kick = F.substring(d, 12, 8)
    both = F.col("goals.home").isNotNull() & F.col("goals.away").isNotNull()
    return fx.select(
        F.col("fixture.id").alias("match_id"),
        L.competition_key(F.col("league.id"), F.col("league.season")).alias("competition_id"),
        F.col("league.season").cast("string").alias("season_name"),
        F.to_date(F.substring(d, 1, 10)).alias("match_date"),
        F.when(kick.rlike(r"^\d{2}:\d{2}:\d{2}$"), kick).alias("kickoff_time"),
        L.prefix_entity_id(F.col("teams.home.id"), FEED_PREFIX).alias("home_team_id"),  # B11
        F.col("teams.home.name").alias("home_team_name"),
        L.prefix_entity_id(F.col("teams.away.id"), FEED_PREFIX).alias("away_team_id"),
        F.col("teams.away.name").alias("away_team_name"),
        F.when(both, F.col("goals.home")).cast("int").alias("home_score"),
        F.when(both, F.col("goals.away")).cast("int").alias("away_score"),
        L.map_fixture_status(F.col("fixture.status.short")).alias("status"),  # B8
        F.col("league.round").alias("stage"), F.col("fixture.venue.name").alias("venue"),
        F.col("fixture.referee").alias("referee"), F.lit(FEED_SOURCE).alias("source"))


def squads_to_players(spark: SparkSession, path: str) -> DataFrame:
    """One page per asked team (in a folder ``team=<id>`` or a file ``<id>.json``).
    The team's own squad in the page is taken, else the page's first; positions
    are a list of one or none; rows carry the asked team's id."""
    sq = _records(spark, path, "squads").withColumn("asked", F.coalesce(
        F.nullif(F.regexp_extract("__path", r"team=(\d+)", 1), F.lit("")), F.regexp_extract("__path", r"/(\d+)\.json$", 1)).try_cast("bigint"))
    own = F.struct((F.col("team.id") != F.col("asked")).alias("other"), "__place")
    taken = sq.where(F.col("asked").isNotNull()).groupBy("asked").agg(F.min_by("players", own).alias("players"))
    p = taken.select("asked", F.explode("players").alias("p"))
    return p.select(L.prefix_entity_id(F.col("asked"), FEED_PREFIX).alias("team_id"),
                    F.col("p.id").cast("string").alias("player_id"), F.col("p.name").alias("name"), F.col("p.number").cast("int").alias("jersey_number"),
                    F.when(F.col("p.position").isNotNull(), F.array("p.position")).otherwise(F.array().cast("array<string>")).alias("positions"))


def envelope_errors(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A10: split fixture-event envelopes into accepted and rejected ones: a
    non-empty ``errors``, list or object, fails the page even though the
    request succeeded."""
    env = _json(spark, path, FIXTURE_EVENTS_SCHEMA)
    bad = ~F.regexp_replace(F.coalesce("errors", F.lit("")), r"\s", "").isin("", "[]", "{}", "null")
    return env.where(~bad), env.where(bad).select("fixture_id", F.col("errors"))


def fixture_events_to_events(envelopes: DataFrame) -> DataFrame:
    """Event id ``match:index``, period from the minute (an unknown minute
    counts as 0), second 0, the detail as outcome, no coordinates."""
    ex = envelopes.select("fixture_id", F.posexplode("response").alias("idx", "ev"))
    return ex.select(
        F.concat_ws(":", F.col("fixture_id").cast("string"), F.col("idx").cast("string")).alias("event_id"),
        F.col("fixture_id").alias("match_id"), F.col("idx").cast("int").alias("sequence"),
        L.infer_period(F.coalesce(F.col("ev.time.elapsed"), F.lit(0))).alias("period"),  # B10
        F.coalesce(F.col("ev.time.elapsed"), F.lit(0)).cast("int").alias("minute"), F.lit(0).alias("second"),
        L.map_feed_event_type(F.col("ev.type"), F.col("ev.detail")).alias("type"),  # B9
        L.prefix_entity_id(F.col("ev.team.id"), FEED_PREFIX).alias("team_id"),
        L.prefix_entity_id(F.col("ev.player.id"), FEED_PREFIX).alias("player_id"),
        F.col("ev.player.name").alias("player_name"), F.col("ev.detail").alias("outcome"),
        F.lit(None).cast("double").alias("location_x"), F.lit(None).cast("double").alias("location_y"),
        F.lit(None).cast("double").alias("end_location_x"), F.lit(None).cast("double").alias("end_location_y"),
        F.lit(FEED_SOURCE).alias("source"))
