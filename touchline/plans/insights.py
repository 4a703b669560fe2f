"""Fixed queries: competitions, entities, leaderboards, comparisons, profiles
and pitch events, bound to the golden competition ("WC") of the test tables.

Every leaderboard is a grouped aggregation plus a top-k
(``orderBy(...).limit(k)`` -> per-task top-k + merge) with a total order
(value, then name/id), so the SQL twin returns the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.projections import SOURCE_FEED, MatchData
from .catalog import register
from .golden import WC_VIEWS, bound_competition, wc_events, wc_matches
from .valuation import light_totals, xt_values

LIMIT = 10
MIN_SHOTS = 1
TOT = ("v_player_totals", "v_team_totals")


def _wc_id(md: MatchData) -> DataFrame:
    return F.broadcast(bound_competition(md))


# ------------------------------------------------------------------- I1
@register("list_competitions", """
SELECT competition_id, name, country, season_name, source FROM v_competitions
""", ("v_competitions",))
def list_competitions(md: MatchData) -> DataFrame:
    return md.competitions.select("competition_id", "name", "country", "season_name", "source")


@register("get_competition", """
SELECT c.competition_id, c.name, c.season_name, c.source FROM v_competitions c
JOIN wc_comp w ON w.competition_id = c.competition_id
""", ("v_competitions", "wc_comp"))
def get_competition(md: MatchData) -> DataFrame:
    return md.competitions.join(_wc_id(md), "competition_id").select("competition_id", "name", "season_name", "source")


# ------------------------------------------------------------------- I2
@register("list_entities_players", """
SELECT player_id AS id, player_name AS name FROM v_player_totals
WHERE competition_id IN (SELECT competition_id FROM wc_comp)
""", TOT + ("wc_comp",))
def list_entities_players(md: MatchData) -> DataFrame:
    t = light_totals(md, "player").join(_wc_id(md), "competition_id")
    return t.select(F.col("player_id").alias("id"), F.col("player_name").alias("name"))


def _sides(m: DataFrame) -> DataFrame:
    """Matches as one row per (match, team): the OR join on home/away rewritten
    as stacked rows, so team joins are equi joins."""
    return m.select("match_id", "competition_id", F.explode(F.array("home_team_id", "away_team_id")).alias("team_id"))


#: A row for each side of a match, as the plans stack them.
PLAYED_SQL = "SELECT competition_id, unnest([home_team_id, away_team_id]) AS team_id FROM v_matches"
BOUND_TEAMS_SQL = f"""SELECT team_id AS id, name FROM v_teams SEMI JOIN (SELECT team_id FROM ({PLAYED_SQL}) SEMI JOIN wc_comp USING (competition_id)) p USING (team_id)"""


@register("list_entities_teams", BOUND_TEAMS_SQL, ("v_teams", "v_matches", "wc_comp"))
def list_entities_teams(md: MatchData) -> DataFrame:
    s = _sides(md.matches.join(_wc_id(md), "competition_id")).select("team_id").distinct()
    return s.join(md.teams, "team_id").select(F.col("team_id").alias("id"), F.col("name"))


# ------------------------------------------------------------------- I5
def _feed_comp(md: MatchData) -> DataFrame:
    return F.broadcast(bound_competition(md, SOURCE_FEED))


@register("team_score_goals", """
SELECT team_id, name, cast(coalesce(g.goals, 0) AS bigint) AS goals
FROM (SELECT team_id, name FROM v_teams WHERE source = 'api_football') t
LEFT JOIN (SELECT side.t AS team_id, sum(side.g) AS goals
           FROM (SELECT unnest([{'t': home_team_id, 'g': home_score}, {'t': away_team_id, 'g': away_score}]) AS side
                 FROM v_matches SEMI JOIN feed_comp USING (competition_id)) GROUP BY side.t) g USING (team_id)
""", ("v_teams", "v_matches", "feed_comp"))
def team_score_goals(md: MatchData) -> DataFrame:
    m = md.matches.join(_feed_comp(md), "competition_id")
    home = m.select(F.col("home_team_id").alias("team_id"), F.col("home_score").alias("g"))
    away = m.select(F.col("away_team_id").alias("team_id"), F.col("away_score").alias("g"))
    goals = home.unionAll(away).groupBy("team_id").agg(F.sum("g").alias("goals"))
    t = md.teams.where(F.col("source") == SOURCE_FEED).select("team_id", "name")
    return t.join(goals, "team_id", "left").select("team_id", "name", F.coalesce("goals", F.lit(0)).cast("bigint").alias("goals"))


# ------------------------------------------------------------------- I6
def _totals_leaderboard(md: MatchData, kind: str, column: str) -> DataFrame:
    name = f"{kind}_name"
    t = light_totals(md, kind).join(_wc_id(md), "competition_id").where(F.col("shot_count") >= MIN_SHOTS)
    top = t.select(F.col(name).alias("name"), F.round(column, 6).alias("value"), F.col("shot_count").alias("shots"),
                   F.col(f"{kind}_id").alias("id"))
    top = top.orderBy(F.desc_nulls_last("value"), "name", "id").limit(LIMIT)
    # rank = list position: a window over at most LIMIT rows
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("value"), "name", "id"))).drop("id")


def _totals_leaderboard_sql(kind: str, column: str) -> str:
    return f"""
SELECT name, value, shots, cast(row_number() OVER (ORDER BY value DESC NULLS LAST, name, id) AS integer) AS rank FROM (
  SELECT {kind}_name AS name, round({column}, 6) AS value, shot_count AS shots, {kind}_id AS id
  FROM v_{kind}_totals WHERE competition_id IN (SELECT competition_id FROM wc_comp) AND shot_count >= {MIN_SHOTS}
  ORDER BY value DESC NULLS LAST, name, id LIMIT {LIMIT}) s"""


register("totals_leaderboard", _totals_leaderboard_sql("player", "total_xt"), TOT + ("wc_comp",))(
    lambda md: _totals_leaderboard(md, "player", "total_xt"))
register("totals_leaderboard_teams", _totals_leaderboard_sql("team", "total_xt"), TOT + ("wc_comp",))(
    lambda md: _totals_leaderboard(md, "team", "total_xt"))


# ------------------------------------------------------------------- I7
def _event_leaderboard(md: MatchData, kind: str, metric: str) -> DataFrame:
    key, name = f"{kind}_id", f"{kind}_name"
    cond = ((F.col("type") == "Shot") & (F.col("outcome") == "Goal")) if metric == "goals" else (F.col("type") == "Pass")
    ev = wc_events(md).where(cond & F.col(key).isNotNull())
    tot = light_totals(md, kind).join(_wc_id(md), "competition_id").select(key, "shot_count")
    agg = (ev.groupBy(key).agg(F.max(name).alias("name"), F.count(F.lit(1)).alias("value"))
           .join(tot, key, "left")
           .select(key, "name", "value", F.coalesce("shot_count", F.lit(0)).alias("shots"))
           .where(F.col("shots") >= MIN_SHOTS))
    top = agg.orderBy(F.desc("value"), "name", key).limit(LIMIT)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("value"), "name", key))).drop(key)


def _event_leaderboard_sql(kind: str, metric: str) -> str:
    key, name = f"{kind}_id", f"{kind}_name"
    cond = "type = 'Shot' AND outcome = 'Goal'" if metric == "goals" else "type = 'Pass'"
    return f"""
SELECT c.name, c.value, coalesce(s.shots, 0) AS shots,
       cast(row_number() OVER (ORDER BY c.value DESC, c.name, c.id) AS integer) AS rank
FROM (SELECT {key} AS id, max({name}) AS name, count(*) AS value
      FROM v_events SEMI JOIN wc USING (match_id) WHERE {cond} AND {key} IS NOT NULL GROUP BY {key}) c
LEFT JOIN (SELECT {key} AS id, sum(shot_count) AS shots FROM v_{kind}_totals SEMI JOIN wc_comp USING (competition_id) GROUP BY {key}) s USING (id)
WHERE coalesce(s.shots, 0) >= {MIN_SHOTS} QUALIFY rank <= {LIMIT}"""


register("event_leaderboard", _event_leaderboard_sql("player", "goals"), TOT + WC_VIEWS + ("wc_comp",))(
    lambda md: _event_leaderboard(md, "player", "goals"))
register("event_leaderboard_team_passes", _event_leaderboard_sql("team", "passes"), TOT + WC_VIEWS + ("wc_comp",))(
    lambda md: _event_leaderboard(md, "team", "passes"))


# ------------------------------------------------------------------- I8
@register("score_goal_leaderboard", f"""
SELECT name, value, cast(row_number() OVER (ORDER BY value DESC NULLS LAST, name, team_id) AS integer) AS rank
FROM (SELECT side.team_id AS team_id, cast(sum(side.goals) AS bigint) AS value
      FROM (SELECT unnest([{{'team_id': home_team_id, 'goals': home_score}}, {{'team_id': away_team_id, 'goals': away_score}}]) AS side
            FROM v_matches SEMI JOIN feed_comp USING (competition_id)) GROUP BY 1)
JOIN v_teams USING (team_id) QUALIFY rank <= {LIMIT}
""", ("v_teams", "v_matches", "feed_comp"))
def score_goal_leaderboard(md: MatchData) -> DataFrame:
    m = md.matches.join(_feed_comp(md), "competition_id")
    home = m.select(F.col("home_team_id").alias("team_id"), F.col("home_score").alias("g"))
    away = m.select(F.col("away_team_id").alias("team_id"), F.col("away_score").alias("g"))
    agg = home.unionAll(away).groupBy("team_id").agg(F.sum("g").alias("value")).join(md.teams.select("team_id", "name"), "team_id")
    order = [F.desc_nulls_last("value"), "name", "team_id"]
    top = agg.orderBy(*order).limit(LIMIT)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("name", "value", "rank")


# ------------------------------------------------------------------- I9
# fixed values: which metric each feed carries, per entity kind
AVAILABILITY = (
    [("statsbomb", e, m) for e in ("players", "teams") for m in ("goals", "shots", "passes", "xt", "vaep", "xg")]
    + [("api_football", "teams", "goals")]
)


def availability_frame(spark) -> DataFrame:
    return spark.createDataFrame(AVAILABILITY, "source string, entity string, metric string")


@register("metric_availability", "SELECT c.competition_id, a.entity, a.metric FROM v_competitions c JOIN (VALUES "
          + ", ".join(f"('{s}', '{e}', '{m}')" for s, e, m in AVAILABILITY)
          + ") a(source, entity, metric) ON a.source = c.source", ("v_competitions",))
def metric_availability(md: MatchData) -> DataFrame:
    a = F.broadcast(availability_frame(md.spark))  # 13 fixed rows
    return md.competitions.select("competition_id", "source").join(a, "source").select("competition_id", "entity", "metric")


# ------------------------------------------------------------------- J5
RECENT = 5


@register("recent_matches", f"""
SELECT team_id, match_id, match_date, is_home, goals_for, goals_against,
       CASE WHEN goals_for IS NULL OR goals_against IS NULL THEN NULL
            WHEN goals_for > goals_against THEN 'W' WHEN goals_for < goals_against THEN 'L' ELSE 'D' END AS result
FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY match_date DESC NULLS LAST, match_id DESC) AS rn FROM (
  SELECT home_team_id AS team_id, match_id, match_date, true AS is_home, home_score AS goals_for, away_score AS goals_against FROM v_matches
  UNION ALL
  SELECT away_team_id, match_id, match_date, false, away_score, home_score FROM v_matches) s) r
WHERE rn <= {RECENT}
""", ("v_matches",))
def recent_matches(md: MatchData) -> DataFrame:
    m = md.matches
    s = (m.select(F.col("home_team_id").alias("team_id"), "match_id", "match_date", F.lit(True).alias("is_home"),
                  F.col("home_score").alias("goals_for"), F.col("away_score").alias("goals_against"))
         .unionAll(m.select(F.col("away_team_id").alias("team_id"), "match_id", "match_date", F.lit(False).alias("is_home"),
                            F.col("away_score").alias("goals_for"), F.col("home_score").alias("goals_against"))))
    w = Window.partitionBy("team_id").orderBy(F.desc_nulls_last("match_date"), F.desc("match_id"))
    gf, ga = F.col("goals_for"), F.col("goals_against")
    return (s.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= RECENT).drop("rn")
            .withColumn("result", F.when(gf.isNull() | ga.isNull(), None).when(gf > ga, "W").when(gf < ga, "L").otherwise("D")))


# ------------------------------------------------------------------- J9
@register("pitch_counts_to_minute", """
SELECT k.minute_cap,
       count(*) FILTER (WHERE e.type = 'Shot') AS shots,
       count(*) FILTER (WHERE e.type = 'Shot' AND e.outcome = 'Goal') AS goals,
       count(*) FILTER (WHERE e.type = 'Pass' AND e.outcome IS NULL) AS complete_passes,
       count(*) FILTER (WHERE e.type = 'Pass' AND e.outcome IS NOT NULL) AS incomplete_passes
FROM (SELECT DISTINCT minute AS minute_cap FROM v_events WHERE match_id IN (SELECT match_id FROM wc) AND minute IS NOT NULL) k
JOIN (SELECT * FROM v_events WHERE match_id IN (SELECT match_id FROM wc)) e
  ON e.minute IS NULL OR e.minute <= k.minute_cap
GROUP BY k.minute_cap
""", WC_VIEWS)
def pitch_counts_to_minute(md: MatchData) -> DataFrame:
    """Cumulative counts up to each minute: per-minute counts, then a running
    sum over minutes (events with no minute are counted at every cap)."""
    ev = wc_events(md)
    t, o = F.col("type"), F.col("outcome")
    per = ev.groupBy("minute").agg(
        F.count_if(t == "Shot").alias("s"), F.count_if((t == "Shot") & (o == "Goal")).alias("g"),
        F.count_if((t == "Pass") & o.isNull()).alias("c"), F.count_if((t == "Pass") & o.isNotNull()).alias("i"))
    # one row per minute (bounded by match length); the null-minute row sorts
    # first, so the running sum adds it to every cap
    w = Window.orderBy(F.asc_nulls_first("minute")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = per.select("minute", *[F.sum(c).over(w).alias(c) for c in "sgci"])
    return run.where(F.col("minute").isNotNull()).select(
        F.col("minute").alias("minute_cap"), F.col("s").alias("shots"), F.col("g").alias("goals"),
        F.col("c").alias("complete_passes"), F.col("i").alias("incomplete_passes"))


# ------------------------------------------------------------------ J10
BIN = 10.0


@register("pitch_density", """
SELECT cast(floor(location_x / 10.0) AS integer) AS bx, cast(floor(location_y / 10.0) AS integer) AS "by", count(*) AS n
FROM v_events WHERE match_id IN (SELECT match_id FROM wc) AND location_x IS NOT NULL AND location_y IS NOT NULL
GROUP BY 1, 2
""", WC_VIEWS)
def pitch_density(md: MatchData) -> DataFrame:
    ev = wc_events(md).where(F.col("location_x").isNotNull() & F.col("location_y").isNotNull())
    return ev.groupBy(F.floor(F.col("location_x") / BIN).cast("int").alias("bx"),
                      F.floor(F.col("location_y") / BIN).cast("int").alias("by")).agg(F.count(F.lit(1)).alias("n"))



@register("list_entities", f"""
SELECT 'players' AS entity_type, player_id AS id, player_name AS name FROM v_player_totals SEMI JOIN wc_comp USING (competition_id)
UNION ALL SELECT 'teams', id, name FROM ({BOUND_TEAMS_SQL})
""", TOT + ("v_teams", "v_matches", "wc_comp"))
def list_entities(md: MatchData) -> DataFrame:
    """Both entity kinds of the golden competition."""
    return (list_entities_players(md).select(F.lit("players").alias("entity_type"), "id", "name")
            .unionByName(list_entities_teams(md).select(F.lit("teams").alias("entity_type"), "id", "name")))
