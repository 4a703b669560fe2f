"""Table scans and table maintenance (2.A, relational part) as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import tables as T
from ..sources.projections import SOURCE_FEED, MatchData
from .catalog import register
from .golden import bound_competition

EVENT_MATCH_CAP = 30
REFERENCE_CAP = 500


@register("table_scan", """
SELECT e.match_id, e.event_id, e.period, e.sequence, e.type, e.team_id, e.player_id, e.location_x, e.location_y,
       e.end_location_x, e.end_location_y, e.outcome, e.body_part, e.under_pressure, e.play_pattern, e.is_cross,
       e.pass_type, e.shot_type, e.duration_seconds, e.possession_team_id, e.minute, e."second",
       m.home_team_id, m.away_team_id, m.competition_id
FROM v_events e JOIN v_matches m ON m.match_id = e.match_id
""", ("v_events", "v_matches"))
def table_scan(md: MatchData) -> DataFrame:
    """All events with their match's teams (the valuation read), ordered
    by match, period, sequence when consumed."""
    m = md.matches.select("match_id", "home_team_id", "away_team_id")
    return md.events.join(m, "match_id").select(
        "match_id", "event_id", "period", "sequence", "type", "team_id", "player_id", "location_x", "location_y",
        "end_location_x", "end_location_y", "outcome", "body_part", "under_pressure", "play_pattern", "is_cross",
        "pass_type", "shot_type", "duration_seconds", "possession_team_id", "minute", "second",
        "home_team_id", "away_team_id", "competition_id")


@register("match_by_id", """
SELECT * FROM (SELECT match_id, competition_id, match_date, home_team_id, away_team_id, home_score, away_score, status
               FROM v_matches) m WHERE match_id = (SELECT max(match_id) FROM v_matches) / 2
""", ("v_matches",))
def match_by_id(md: MatchData) -> DataFrame:
    """Point lookup (filter pushed to the scan); empty when absent."""
    mid = md.matches.agg(F.max("match_id")).first()[0] / 2
    return md.matches.where(F.col("match_id") == F.lit(mid)).select(
        "match_id", "competition_id", "match_date", "home_team_id", "away_team_id", "home_score", "away_score", "status")


@register("upsert", """
SELECT match_id, home_score, away_score, status FROM (
  SELECT match_id, home_score, away_score, status FROM v_matches WHERE match_id % 3 <> 0
  UNION ALL
  SELECT match_id, coalesce(home_score, 0) + 1, away_score, 'complete' FROM v_matches WHERE match_id % 3 = 0) s
""", ("v_matches",))
def upsert(md: MatchData) -> DataFrame:
    """Replace every third match with a corrected row (keys = match_id);
    the update batch holds each key twice, the last (higher version) wins."""
    base = md.matches.select("match_id", "home_score", "away_score", "status")
    fix = base.where(F.col("match_id") % 3 == 0)
    stale = fix.select("match_id", "home_score", "away_score", "status", F.lit(1).alias("version"))
    fresh = fix.select("match_id", (F.coalesce("home_score", F.lit(0)) + 1).alias("home_score"), "away_score",
                       F.lit("complete").alias("status"), F.lit(2).alias("version"))
    return T.upsert(base, stale.unionByName(fresh), ["match_id"], order_col="version").select(*base.columns)


@register("insert_ignore", """
SELECT team_id, name FROM v_teams
UNION ALL SELECT 'new:' || cast(n_nationkey AS varchar), n_name FROM nation WHERE n_nationkey % 2 = 0
""", ("v_teams",))
def insert_ignore(md: MatchData) -> DataFrame:
    """Insert teams; existing keys are left as they are (do nothing)."""
    t = md.teams.select("team_id", "name")
    n = md.read("nation", "n_nationkey", "n_name")
    incoming = t.select("team_id", F.concat(F.col("name"), F.lit(" (dup)")).alias("name")).unionByName(
        n.where(F.col("n_nationkey") % 2 == 0).select(
            F.concat(F.lit("new:"), F.col("n_nationkey").cast("string")).alias("team_id"), F.col("n_name").alias("name")))
    return T.insert_ignore(t, incoming, ["team_id"])


@register("delete_where_owned", """
SELECT event_id AS post_id, user_id FROM events WHERE event_type = 'purchase'
  AND NOT (event_id % 4 = 0)
""")
def delete_where_owned(md: MatchData) -> DataFrame:
    """Delete posts by id AND owner: every 4th post is deleted by its
    owner; the requests with a wrong owner (every 6th post) match nothing."""
    e = md.read("events", "event_id", "user_id", "event_type").where(F.col("event_type") == "purchase")
    posts = e.select(F.col("event_id").alias("post_id"), "user_id")
    own = posts.where(F.col("post_id") % 4 == 0)
    wrong = posts.where((F.col("post_id") % 6 == 0) & (F.col("post_id") % 4 != 0)).select(
        "post_id", (F.col("user_id") + 1).alias("user_id"))
    kept, _ = T.delete_where_owned(posts, own.unionByName(wrong), "post_id", "user_id")
    return kept


@register("delete_not_found", """
SELECT event_id AS post_id, user_id + 1 AS user_id FROM events
WHERE event_type = 'purchase' AND event_id % 6 = 0 AND event_id % 4 <> 0
""")
def delete_not_found(md: MatchData) -> DataFrame:
    e = md.read("events", "event_id", "user_id", "event_type").where(F.col("event_type") == "purchase")
    posts = e.select(F.col("event_id").alias("post_id"), "user_id")
    own = posts.where(F.col("post_id") % 4 == 0)
    wrong = posts.where((F.col("post_id") % 6 == 0) & (F.col("post_id") % 4 != 0)).select(
        "post_id", (F.col("user_id") + 1).alias("user_id"))
    return T.delete_where_owned(posts, own.unionByName(wrong), "post_id", "user_id")[1]


@register("row_count_summary", """
SELECT 'teams' AS table_name, count(*) AS row_count FROM v_teams
UNION ALL SELECT 'matches', count(*) FROM v_matches
UNION ALL SELECT 'match_events', count(*) FROM v_events
UNION ALL SELECT 'players', count(*) FROM v_players
""", ("v_teams", "v_matches", "v_events", "v_players"))
def row_count_summary(md: MatchData) -> DataFrame:
    return T.row_count_summary({"teams": md.teams, "matches": md.matches, "match_events": md.events,
                                "players": md.players})


@register("idempotency_check", """
SELECT 'matches' AS table_name, 0 AS changed FROM v_matches LIMIT 0
""", ("v_matches",))
def idempotency_check(md: MatchData) -> DataFrame:
    """Load the match table twice by upsert; no table's count may change."""
    base = md.matches.select("match_id", "home_score", "away_score", "status")
    once = T.upsert(base.limit(0), base, ["match_id"])
    twice = T.upsert(once, base, ["match_id"])
    first = T.row_count_summary({"matches": once})
    second = T.row_count_summary({"matches": twice})
    return T.idempotency_check(first, second).select("table_name", (F.col("second_count") - F.col("first_count")).cast("int").alias("changed"))


ENRICHED = ["body_part", "under_pressure", "play_pattern", "is_cross", "pass_type", "shot_type"]


@register("column_population", "SELECT (SELECT count(*) FROM v_events) AS rows, column_name, non_null FROM ("
          + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS non_null FROM v_events" for c in ENRICHED)
          + ") s", ("v_events",))
def column_population(md: MatchData) -> DataFrame:
    """Non-null count per enriched event column."""
    return T.column_population(md.events, ENRICHED)


@register("competition_allowlist", """
SELECT competition_id, name, season_name FROM v_competitions
WHERE competition_id IN (SELECT competition_id FROM wc_comp UNION ALL SELECT competition_id FROM feed_comp)
""", ("v_competitions", "wc_comp", "feed_comp"))
def competition_allowlist(md: MatchData) -> DataFrame:
    """Keep the requested competitions (the two bound ones plus an unknown id)."""
    req = (bound_competition(md).unionAll(bound_competition(md, SOURCE_FEED))
           .unionAll(md.spark.createDataFrame([("9:1900",)], "competition_id string")))
    kept, unmatched = T.allowlist(md.competitions, req, "competition_id")
    if kept.limit(1).count() == 0:
        raise ValueError("no requested competition matched")
    return kept.select("competition_id", "name", "season_name")


@register("event_match_cap", f"""
SELECT e.match_id, count(*) AS events FROM v_events e
WHERE e.match_id IN (SELECT match_id FROM v_matches WHERE source = 'api_football' ORDER BY match_date, match_id LIMIT {EVENT_MATCH_CAP})
GROUP BY e.match_id
""", ("v_events", "v_matches"))
def event_match_cap(md: MatchData) -> DataFrame:
    """Events only for the first N matches of the capped feed (top-k, then a semi join)."""
    first = (md.matches.where(F.col("source") == SOURCE_FEED).orderBy("match_date", "match_id")
             .limit(EVENT_MATCH_CAP).select("match_id"))
    return md.events.join(F.broadcast(first), "match_id", "left_semi").groupBy("match_id").agg(
        F.count(F.lit(1)).alias("events"))


@register("dimension_reference", f"""
SELECT kind, value FROM (
  SELECT 'competition' AS kind, value FROM (SELECT DISTINCT trim(c.name || ' ' || c.season_name || ' (' || c.source || ')') AS value
                                            FROM v_competitions c WHERE c.name IS NOT NULL) a
  UNION ALL
  SELECT 'team', value FROM (SELECT DISTINCT trim(name) AS value FROM v_teams WHERE name IS NOT NULL) b) s
QUALIFY row_number() OVER (PARTITION BY kind ORDER BY value) <= {REFERENCE_CAP}
""", ("v_competitions", "v_teams"))
def dimension_reference(md: MatchData) -> DataFrame:
    """Distinct, non-null, trimmed competition and team labels, capped per kind."""
    c = md.competitions.where(F.col("name").isNotNull()).select(
        F.lit("competition").alias("kind"),
        F.trim(F.concat_ws("", "name", F.lit(" "), "season_name", F.lit(" ("), "source", F.lit(")"))).alias("value")).distinct()
    t = md.teams.where(F.col("name").isNotNull()).select(F.lit("team").alias("kind"), F.trim("name").alias("value")).distinct()
    return T.first_n_per(c.unionAll(t), REFERENCE_CAP, ["value"], ["kind"])
