"""Provider-feed loaders (2.A readers, 2.B label maps) checked by round trip.

The projected tables are written out in each provider's file shape (labels
as the provider spells them, nested structs, one folder per match), landed
in the shared folder, and read back by the loaders; the SQL twin states the
neutral rows the loaders must produce.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import feeds as FD
from ..sources.projections import SOURCE_EVENTS, SOURCE_FEED, MatchData
from .catalog import register


def _landing(md: MatchData, name: str) -> str:
    return scratch_path(md.spark, f"landing/{name}-{uuid.uuid4().hex[:12]}")


def _bare(c) -> F.Column:
    """Numeric provider id from a neutral id ('af:3' -> 3, '3' -> 3)."""
    return F.regexp_replace(c, "^af:", "").cast("long")


def _player_num(c) -> F.Column:
    """Numeric provider player id from 'team-Pk' (team * 100 + k)."""
    return (F.regexp_extract(c, r"^(?:af:)?(\d+)-P", 1).cast("long") * 100
            + F.regexp_extract(c, r"-P(\d+)$", 1).cast("long"))


def _provider_label(c) -> F.Column:
    """'from_throw_in' -> 'From Throw In' (the provider's spelling)."""
    return F.initcap(F.regexp_replace(c, "_", " "))


# ----------------------------------------------------------------- A1
def land_competitions(md: MatchData) -> str:
    path = _landing(md, "competitions")
    c = md.competitions.where(F.col("source") == SOURCE_EVENTS)
    parts = F.split("competition_id", ":")
    c.select(parts[0].cast("long").alias("competition_id"), parts[1].cast("long").alias("season_id"),
             F.col("country").alias("country_name"), F.col("name").alias("competition_name"),
             F.when(parts[0].cast("int") % 2 == 0, "male").otherwise("men").alias("competition_gender"),
             F.lit(False).alias("competition_youth"), (parts[0].cast("int") == 1).alias("competition_international"),
             "season_name").write.json(path)
    return path


@register("read_competitions", """
SELECT competition_id, name, country, season_name,
       CASE WHEN cast(split_part(competition_id, ':', 1) AS int) % 2 = 0 THEN 'male' ELSE 'unknown' END AS gender,
       split_part(competition_id, ':', 1) = '1' AS is_international, false AS is_youth, source
FROM v_competitions WHERE source = 'statsbomb'
""", ("v_competitions",))
def read_competitions(md: MatchData) -> DataFrame:
    return FD.read_competitions(md.spark, land_competitions(md))


# ----------------------------------------------------------------- A2
def land_matches(md: MatchData) -> str:
    path = _landing(md, "matches")
    m = md.matches.where(F.col("source") == SOURCE_EVENTS)
    parts = F.split("competition_id", ":")
    m.select(
        "match_id", F.date_format("match_date", "yyyy-MM-dd").alias("match_date"),
        F.when(F.col("match_id") % 2 == 0, F.lit("20:00:00.000")).alias("kick_off"),
        F.struct(parts[0].cast("long").alias("competition_id"), F.lit("x").alias("competition_name")).alias("competition"),
        F.struct(parts[1].cast("long").alias("season_id"), F.col("season_name")).alias("season"),
        F.struct(_bare(F.col("home_team_id")).alias("home_team_id"), F.col("home_team_name")).alias("home_team"),
        F.struct(_bare(F.col("away_team_id")).alias("away_team_id"), F.col("away_team_name")).alias("away_team"),
        "home_score",
        # an unscored match still carries one side: the loader must drop it
        F.coalesce("away_score", F.lit(0)).alias("away_score"),
        F.when(F.col("status") == "complete", "available").otherwise("scheduled").alias("match_status"),
        F.struct(F.col("stage").alias("name")).alias("competition_stage"),
        F.struct(F.concat(F.lit("Stadium "), F.col("match_id").cast("string")).alias("name")).alias("stadium"),
        F.lit(None).cast("struct<name:string>").alias("referee"),
        parts[0].alias("competition_part"), parts[1].alias("season_part"),
    ).write.partitionBy("competition_part", "season_part").json(path)
    return path


@register("read_matches", """
SELECT match_id, competition_id, season_name, match_date,
       CASE WHEN match_id % 2 = 0 THEN '20:00:00' END AS kickoff_time,
       home_team_id, home_team_name, away_team_id, away_team_name, home_score, away_score,
       CASE WHEN status = 'complete' THEN 'available' ELSE 'scheduled' END AS status, stage,
       'Stadium ' || cast(match_id AS varchar) AS venue, NULL::varchar AS referee, source
FROM v_matches WHERE source = 'statsbomb'
""", ("v_matches",))
def read_matches(md: MatchData) -> DataFrame:
    return FD.read_matches(md.spark, land_matches(md))


# ----------------------------------------------------------------- A3
def land_events(md: MatchData) -> str:
    """Events in provider shape, many matches a file, each record with its match id."""
    path = _landing(md, "events")
    e = md.events.where(F.col("source") == SOURCE_EVENTS)
    t = F.col("type")
    body = F.struct(_provider_label(F.col("body_part")).alias("name"))
    outcome = F.when(F.col("outcome").isNotNull(), F.struct(F.col("outcome").alias("name")))
    end = F.when(F.col("end_location_x").isNotNull(), F.array("end_location_x", "end_location_y"))
    pass_type = F.when(F.col("pass_type") == "throw_in", "Throw-in").when(F.col("pass_type") != "open_play",
                                                                          _provider_label(F.col("pass_type")))
    shot_type = _provider_label(F.col("shot_type"))
    pass_detail = F.when(t == "Pass", F.struct(
        end.alias("end_location"), outcome.alias("outcome"), body.alias("body_part"),
        F.when(pass_type.isNotNull(), F.struct(pass_type.alias("name"))).alias("type"),
        F.when(F.col("is_cross"), F.lit(True)).alias("cross")))
    shot_detail = F.when(t == "Shot", F.struct(
        end.alias("end_location"), outcome.alias("outcome"), body.alias("body_part"),
        F.struct(shot_type.alias("name")).alias("type"), F.lit(None).cast("boolean").alias("cross")))
    carry_detail = F.when(t == "Carry", F.struct(
        end.alias("end_location"), F.lit(None).cast("struct<name:string>").alias("outcome"),
        F.lit(None).cast("struct<name:string>").alias("body_part"), F.lit(None).cast("struct<name:string>").alias("type"),
        F.lit(None).cast("boolean").alias("cross")))

    def ent(idc, namec, player=False):
        return F.when(F.col(idc).isNotNull(), F.struct(
            (_player_num(F.col(idc)) if player else _bare(F.col(idc))).alias("id"), F.col(namec).alias("name")))

    e.select(
        "match_id", F.col("event_id").alias("id"), F.col("sequence").cast("long").alias("index"),
        F.col("period").cast("long").alias("period"), F.col("minute").cast("long").alias("minute"),
        F.col("second").cast("long").alias("second"), F.struct(t.alias("name")).alias("type"),
        ent("team_id", "team_name").alias("team"), ent("player_id", "player_name", True).alias("player"),
        ent("possession_team_id", "possession_team_name").alias("possession_team"),
        F.struct(_provider_label(F.col("play_pattern")).alias("name")).alias("play_pattern"),
        "under_pressure",
        F.when(F.col("location_x").isNotNull(), F.array("location_x", "location_y")).alias("location"),
        F.col("duration_seconds").alias("duration"),
        pass_detail.alias("pass"), shot_detail.alias("shot"), carry_detail.alias("carry"),
    ).write.json(path)
    return path


@register("read_events", """
SELECT event_id, match_id, sequence, period, minute, "second", type, team_id, team_name,
       cast(cast(split_part(player_id, '-P', 1) AS bigint) * 100 + cast(split_part(player_id, '-P', 2) AS bigint) AS varchar) AS player_id,
       player_name, possession_team_id, possession_team_name, location_x, location_y,
       CASE WHEN type IN ('Pass', 'Shot', 'Carry') THEN end_location_x END AS end_location_x,
       CASE WHEN type IN ('Pass', 'Shot', 'Carry') THEN end_location_y END AS end_location_y,
       duration_seconds, outcome, body_part, under_pressure, play_pattern, is_cross, pass_type, shot_type, source
FROM v_events WHERE source = 'statsbomb'
""", ("v_events",))
def read_events(md: MatchData) -> DataFrame:
    return FD.read_events(md.spark, land_events(md))


# ----------------------------------------------------------------- A6 / A7
def land_leagues(md: MatchData) -> str:
    path = _landing(md, "leagues")
    c = md.competitions.where(F.col("source") == SOURCE_FEED)
    parts = F.split("competition_id", ":")
    # one league per region; its seasons (a handful of years) as an array
    c.groupBy(parts[0].cast("long").alias("id"), F.col("name"), F.col("country")).agg(
        F.array_sort(F.collect_set(parts[1].cast("long"))).alias("years")).select(
        F.struct("id", "name", F.lit("League").alias("type")).alias("league"),
        F.struct(F.col("country").alias("name"), F.lit("XX").alias("code")).alias("country"),
        F.transform("years", lambda y: F.struct(y.alias("year"))).alias("seasons")).write.json(path)
    return path


@register("leagues_to_competitions", """
SELECT competition_id, name, country, season_name, 'unknown' AS gender, source FROM v_competitions WHERE source = 'api_football'
""", ("v_competitions",))
def leagues_to_competitions(md: MatchData) -> DataFrame:
    return FD.leagues_to_competitions(md.spark, land_leagues(md))


def land_fixtures(md: MatchData) -> str:
    path = _landing(md, "fixtures")
    m = md.matches.where(F.col("source") == SOURCE_FEED)
    parts = F.split("competition_id", ":")
    date = F.when(F.col("match_id") % 2 == 0,
                  F.concat(F.date_format("match_date", "yyyy-MM-dd"), F.lit("T19:00:00+00:00"))).otherwise(
        F.date_format("match_date", "yyyy-MM-dd"))
    short = F.when(F.col("home_score").isNotNull(), F.when(F.col("match_id") % 3 == 0, "AET").otherwise("FT")).when(
        F.col("match_id") % 7 == 0, "PST").otherwise("NS")
    m.select(
        F.struct(F.col("match_id").alias("id"), date.alias("date"), F.lit("UTC").alias("timezone"),
                 F.lit(None).cast("string").alias("referee"),
                 F.struct(F.lit("Ground").alias("name"), F.lit("Town").alias("city")).alias("venue"),
                 F.struct(short.alias("short"), F.lit("x").alias("long")).alias("status")).alias("fixture"),
        F.struct(parts[0].cast("long").alias("id"), F.lit("League").alias("name"), parts[1].cast("long").alias("season"),
                 F.col("stage").alias("round")).alias("league"),
        F.struct(F.struct(_bare(F.col("home_team_id")).alias("id"), F.col("home_team_name").alias("name")).alias("home"),
                 F.struct(_bare(F.col("away_team_id")).alias("id"), F.col("away_team_name").alias("name")).alias("away")
                 ).alias("teams"),
        F.struct(F.col("home_score").cast("long").alias("home"), F.col("away_score").cast("long").alias("away")).alias("goals"),
    ).write.json(path)
    return path


@register("fixtures_to_matches", """
SELECT match_id, competition_id, season_name, match_date, CASE WHEN match_id % 2 = 0 THEN '19:00:00' END AS kickoff_time,
       home_team_id, home_team_name, away_team_id, away_team_name, home_score, away_score,
       CASE WHEN home_score IS NOT NULL THEN 'complete' WHEN match_id % 7 = 0 THEN 'postponed' ELSE 'scheduled' END AS status,
       stage, 'Ground' AS venue, NULL::varchar AS referee, source
FROM v_matches WHERE source = 'api_football'
""", ("v_matches",))
def fixtures_to_matches(md: MatchData) -> DataFrame:
    return FD.fixtures_to_matches(md.spark, land_fixtures(md))


# ----------------------------------------------------------------- A8 / A10
def land_fixture_events(md: MatchData) -> str:
    """One envelope per fixture (its events in sequence order; a fixture's
    event list is bounded by one match). Every 11th envelope carries an error."""
    path = _landing(md, "fixture-events")
    e = md.events.where(F.col("source") == SOURCE_FEED)
    t = F.col("type")
    ptype = F.when(t == "Goal", "Goal").when(t == "Yellow Card", "Card").otherwise("subst")
    detail = F.when(t == "Goal", "Normal Goal").when(t == "Yellow Card", "Yellow Card").otherwise("Substitution 1")
    ev = e.select("match_id", "sequence", F.struct(
        F.struct(F.col("minute").cast("long").alias("elapsed"), F.lit(None).cast("long").alias("extra")).alias("time"),
        F.struct(_bare(F.col("team_id")).alias("id"), F.col("team_name").alias("name")).alias("team"),
        F.struct(_player_num(F.col("player_id")).alias("id"), F.col("player_name").alias("name")).alias("player"),
        F.lit(None).cast("struct<id:bigint,name:string>").alias("assist"),
        ptype.alias("type"), detail.alias("detail"), F.lit(None).cast("string").alias("comments")).alias("ev"))
    env = ev.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("sequence", "ev"))).alias("evs"))
    # the provider sends [] when there is no error, and an object or a list when there is one
    env = env.select(F.col("match_id").alias("fixture_id"), F.transform("evs", lambda x: x["ev"]).alias("response"))
    listed = F.when(F.col("fixture_id") % 22 == 0, F.array(F.lit("rate limit"))).otherwise(F.array().cast("array<string>"))
    env.where(F.col("fixture_id") % 22 != 11).withColumn("errors", listed).write.json(path)
    env.where(F.col("fixture_id") % 22 == 11).withColumn(
        "errors", F.struct(F.lit("Error/Missing application key.").alias("token"))).write.mode("append").json(path)
    return path


@register("fixture_events_to_events", """
SELECT cast(match_id AS varchar) || ':' || cast(sequence - 1 AS varchar) AS event_id, match_id,
       cast(sequence - 1 AS integer) AS sequence,
       CASE WHEN minute > 105 THEN 4 WHEN minute > 90 THEN 3 WHEN minute > 45 THEN 2 ELSE 1 END AS period,
       coalesce(minute, 0) AS minute, 0 AS "second", type, team_id,
       CASE type WHEN 'Goal' THEN 'Normal Goal' WHEN 'Yellow Card' THEN 'Yellow Card' ELSE 'Substitution 1' END AS outcome,
       'af:' || cast(cast(split_part(substr(player_id, 4), '-P', 1) AS bigint) * 100 + cast(split_part(player_id, '-P', 2) AS bigint) AS varchar) AS player_id,
       player_name, NULL::double AS location_x, NULL::double AS location_y, NULL::double AS end_location_x,
       NULL::double AS end_location_y, source
FROM v_events WHERE source = 'api_football' AND match_id % 11 <> 0
""", ("v_events",))
def fixture_events_to_events(md: MatchData) -> DataFrame:
    ok, _ = FD.envelope_errors(md.spark, land_fixture_events(md))
    return FD.fixture_events_to_events(ok)


@register("envelope_errors", """
SELECT DISTINCT match_id AS fixture_id FROM v_events WHERE source = 'api_football' AND match_id % 11 = 0
""", ("v_events",))
def envelope_errors(md: MatchData) -> DataFrame:
    _, bad = FD.envelope_errors(md.spark, land_fixture_events(md))
    return bad.select("fixture_id")


# ------------------------------------- A1, A2, A6, A7, A9: files as the providers send them
def _pretty(md: MatchData, landed: str, name: str, envelope: bool, files: int = 4) -> str:
    """Records landed one a line, rewritten as pretty-printed arrays or envelopes, some records a file."""
    path = _landing(md, name)
    line = md.spark.read.text(landed).select("value", F.pmod(F.xxhash64("value"), F.lit(files)).alias("file"))
    page = line.groupBy("file").agg(F.concat(F.lit("[\n  "), F.array_join(F.sort_array(F.collect_list(
        F.regexp_replace("value", r'([{,])"', '$1\n    "'))), ",\n  "), F.lit("\n]")).alias("text"))
    if envelope:
        page = page.select("file", F.concat(F.lit('{\n "get": "x",\n "errors": [],\n "response": '), F.col("text"), F.lit("\n}")).alias("text"))
    page.repartition(files, "file").write.partitionBy("file").text(path)
    return path


def _twin(name: str) -> str:
    from .catalog import ORACLE
    return ORACLE[name]


register("read_competitions_array", _twin("read_competitions"))(
    lambda md: FD.read_competitions(md.spark, _pretty(md, land_competitions(md), "competitions-array", False)))
register("read_matches_array", _twin("read_matches"))(
    lambda md: FD.read_matches(md.spark, _pretty(md, land_matches(md), "matches-array", False)))
register("leagues_envelope", _twin("leagues_to_competitions"))(
    lambda md: FD.leagues_to_competitions(md.spark, _pretty(md, land_leagues(md), "leagues-envelope", True)))
register("fixtures_envelope", _twin("fixtures_to_matches"))(
    lambda md: FD.fixtures_to_matches(md.spark, _pretty(md, land_fixtures(md), "fixtures-envelope", True)))


def land_squads(md: MatchData) -> str:
    """One envelope per team; the page of every 5th team lists other squads only,
    and the pages of the rest list another squad first."""
    path = _landing(md, "squad-pages")
    p = md.players.where(F.col("source") == SOURCE_FEED)
    n = F.regexp_extract("player_id", r"-P(\d+)$", 1).cast("int")
    team = _bare(F.col("team_id"))
    label = F.element_at(F.array(*(F.lit(x) for x in ("Goalkeeper", "Defender", "Midfielder", "Attacker"))), n % 4 + 1)
    squads = p.groupBy(team.alias("id")).agg(F.array_sort(F.collect_list(F.struct(
        (_bare(F.col("team_id")) * 100 + n).alias("id"), "name", F.lit(25).cast("long").alias("age"), F.col("jersey_number").cast("long").alias("number"),
        F.when(n % 4 != 3, label).alias("position")))).alias("players"))
    one = squads.select(F.struct(F.struct("id", F.lit("x").alias("name")).alias("team"), "players").alias("own"), F.col("id").alias("team"))
    other = squads.agg(F.min_by(F.struct(F.struct("id", F.lit("x").alias("name")).alias("team"), "players"), "id").alias("first"))
    page = one.join(F.broadcast(other)).select("team", F.when(F.col("team") % 5 == 0, F.array("first")).otherwise(F.array("first", "own")).alias("response"))
    page.withColumn("errors", F.array().cast("array<string>")).write.partitionBy("team").json(path)
    return path


@register("squads_to_players_all", """
SELECT t.team_id, cast(cast(substr(p.team_id, 4) AS bigint) * 100 + cast(split_part(p.player_id, '-P', 2) AS bigint) AS varchar) AS player_id,
       p.name, p.jersey_number,
       CASE WHEN cast(split_part(p.player_id, '-P', 2) AS int) % 4 = 3 THEN [] ELSE [['Goalkeeper', 'Defender', 'Midfielder', 'Attacker'][cast(split_part(p.player_id, '-P', 2) AS int) % 4 + 1]] END AS positions
FROM (SELECT DISTINCT team_id, cast(substr(team_id, 4) AS bigint) AS n FROM v_players WHERE source = 'api_football') t
JOIN v_players p ON p.source = 'api_football'
 AND cast(substr(p.team_id, 4) AS bigint) = CASE WHEN t.n % 5 = 0 THEN (SELECT min(cast(substr(team_id, 4) AS bigint)) FROM v_players WHERE source = 'api_football') ELSE t.n END
""", ("v_players",))
def squads_to_players_all(md: MatchData) -> DataFrame:
    """A9 for every team's page."""
    return FD.squads_to_players(md.spark, land_squads(md))
