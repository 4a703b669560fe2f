"""Label / key normalisation (2.B) and entity resolution (2.C) as queries.

The label maps are applied to provider spellings derived from the neutral
values ('left_foot' -> 'Left Foot' ...), so each query must give back the
neutral value; the others run over text columns of the landed tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..sources.projections import SOURCE_FEED, MatchData
from .catalog import register


def _spelled(c: str) -> F.Column:
    return F.initcap(F.regexp_replace(F.col(c), "_", " "))


# ---------------------------------------------------------------- B1
@register("normalize_provider_label", """
SELECT p_partkey, coalesce(lower(trim(regexp_replace(p_brand || ' -- ' || p_name, '[^A-Za-z0-9]+', ' ', 'g'))), '') AS label
FROM part
""")
def normalize_provider_label(md: MatchData) -> DataFrame:
    p = md.read("part", "p_partkey", "p_name", "p_brand")
    return p.select("p_partkey", L.normalize_provider_label(F.concat(F.col("p_brand"), F.lit(" -- "), F.col("p_name")))
                    .alias("label"))


# ------------------------------------------------------------- B2 - B6
@register("map_body_part", """
SELECT event_id, body_part FROM v_events WHERE type IN ('Pass', 'Shot')
""", ("v_events",))
def map_body_part(md: MatchData) -> DataFrame:
    e = md.events.where(F.col("type").isin("Pass", "Shot"))
    spelled = _spelled("body_part")
    pass_part = F.when(F.col("type") == "Pass", spelled)
    shot_part = F.when(F.col("type") == "Shot", spelled)
    return e.select("event_id", L.map_body_part(pass_part, shot_part).alias("body_part"))


@register("map_play_pattern", "SELECT event_id, play_pattern FROM v_events WHERE play_pattern IS NOT NULL", ("v_events",))
def map_play_pattern(md: MatchData) -> DataFrame:
    e = md.events.where(F.col("play_pattern").isNotNull())
    return e.select("event_id", L.map_play_pattern(_spelled("play_pattern")).alias("play_pattern"))


@register("map_pass_type", "SELECT event_id, pass_type FROM v_events WHERE source = 'statsbomb'", ("v_events",))
def map_pass_type(md: MatchData) -> DataFrame:
    e = md.events.where(F.col("source") != SOURCE_FEED)
    spelled = F.when(F.col("pass_type") == "open_play", F.lit(None)).otherwise(_spelled("pass_type"))
    return e.select("event_id", L.map_pass_type(F.col("type") == "Pass", spelled).alias("pass_type"))


@register("map_shot_type", "SELECT event_id, shot_type FROM v_events WHERE source = 'statsbomb'", ("v_events",))
def map_shot_type(md: MatchData) -> DataFrame:
    e = md.events.where(F.col("source") != SOURCE_FEED)
    return e.select("event_id", L.map_shot_type(F.col("type") == "Shot", _spelled("shot_type")).alias("shot_type"))


@register("cross_flag", "SELECT event_id, is_cross FROM v_events WHERE source = 'statsbomb'", ("v_events",))
def cross_flag(md: MatchData) -> DataFrame:
    e = md.events.where(F.col("source") != SOURCE_FEED)
    provider_cross = F.when(F.col("is_cross"), F.lit(True))  # absent unless true
    return e.select("event_id", L.cross_flag(F.col("type") == "Pass", provider_cross).alias("is_cross"))


# ---------------------------------------------------------------- B7
@register("normalize_enums", """
SELECT c_custkey, CASE WHEN lower(c_mktsegment) IN ('female', 'male', 'mixed') THEN lower(c_mktsegment) ELSE 'unknown' END AS gender,
       CASE WHEN c_custkey % 5 = 0 THEN 'complete' WHEN c_custkey % 5 = 1 THEN 'available' ELSE 'unknown' END AS status
FROM customer
""")
def normalize_enums(md: MatchData) -> DataFrame:
    c = md.read("customer", "c_custkey", "c_mktsegment")
    raw_status = F.when(F.col("c_custkey") % 5 == 0, "complete").when(F.col("c_custkey") % 5 == 1, "available").otherwise(
        F.lower("c_mktsegment"))
    return c.select("c_custkey", L.normalize_gender(F.lower("c_mktsegment")).alias("gender"),
                    L.normalize_match_status(raw_status).alias("status"))


# ------------------------------------------------------------- B8 - B10
@register("map_fixture_status", """
SELECT o_orderkey, CASE s WHEN 'FT' THEN 'complete' WHEN 'AET' THEN 'complete' WHEN 'PEN' THEN 'complete'
  WHEN 'NS' THEN 'scheduled' WHEN 'TBD' THEN 'scheduled' WHEN 'PST' THEN 'postponed' WHEN 'CANC' THEN 'postponed'
  WHEN 'ABD' THEN 'postponed' WHEN 'SUSP' THEN 'postponed' ELSE 'unknown' END AS status
FROM (SELECT o_orderkey, ['FT', 'AET', 'PEN', 'NS', 'TBD', 'PST', 'CANC', 'ABD', 'SUSP', 'LIVE'][o_orderkey % 10 + 1] AS s FROM orders) x
""")
def map_fixture_status(md: MatchData) -> DataFrame:
    o = md.read("orders", "o_orderkey")
    codes = F.array(*[F.lit(x) for x in ("FT", "AET", "PEN", "NS", "TBD", "PST", "CANC", "ABD", "SUSP", "LIVE")])
    return o.select("o_orderkey", L.map_fixture_status(F.element_at(codes, (F.col("o_orderkey") % 10 + 1).cast("int")))
                    .alias("status"))


@register("map_feed_event_type", """
SELECT event_id, type FROM v_events WHERE source = 'api_football'
""", ("v_events",))
def map_feed_event_type(md: MatchData) -> DataFrame:
    e = md.events.where(F.col("source") == SOURCE_FEED)
    t = F.col("type")
    ptype = F.when(t == "Goal", " GOAL ").when(t == "Yellow Card", "Card").otherwise("subst")
    detail = F.when(t == "Goal", "Normal Goal").when(t == "Yellow Card", "Yellow Card").otherwise(F.lit(None))
    return e.select("event_id", L.map_feed_event_type(ptype, detail).alias("type"))


@register("infer_period", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN m > 105 THEN 4 WHEN m > 90 THEN 3 WHEN m > 45 THEN 2 ELSE 1 END AS period
FROM (SELECT l_orderkey, l_linenumber, l_partkey, (l_partkey * 7 + l_suppkey) % 121 AS m FROM lineitem) x
""")
def infer_period(md: MatchData) -> DataFrame:
    li = md.read("lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    m = (F.col("l_partkey") * 7 + F.col("l_suppkey")) % 121
    return li.select("l_orderkey", "l_linenumber", "l_partkey", L.infer_period(m).alias("period"))


# ------------------------------------------------------------- B11 / B12
@register("prefix_entity_ids", """
SELECT n_nationkey, CASE WHEN n_regionkey = 4 THEN 'af:' || cast(n_nationkey AS varchar)
                         WHEN n_regionkey = 3 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'cv:' || cast(n_nationkey AS varchar) END
                         ELSE cast(n_nationkey AS varchar) END AS entity_id
FROM nation
""")
def prefix_entity_ids(md: MatchData) -> DataFrame:
    n = md.read("nation", "n_nationkey", "n_regionkey")
    cv_id = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey"))  # null id stays null
    return n.select("n_nationkey", F.when(F.col("n_regionkey") == 4, L.prefix_entity_id(F.col("n_nationkey"), "af:"))
                    .when(F.col("n_regionkey") == 3, L.prefix_entity_id(cv_id, "cv:"))
                    .otherwise(L.prefix_entity_id(F.col("n_nationkey"), "")).alias("entity_id"))


@register("competition_key", """
SELECT k, try_cast(split_part(k, ':', 1) AS bigint) AS league, try_cast(split_part(k, ':', 2) AS bigint) AS season,
       try_cast(split_part(k, ':', 1) AS bigint) IS NULL OR try_cast(split_part(k, ':', 2) AS bigint) IS NULL AS invalid
FROM (SELECT DISTINCT competition_id AS k FROM v_matches UNION ALL SELECT DISTINCT home_team_id || ':x' FROM v_matches) s
""", ("v_matches",))
def competition_key(md: MatchData) -> DataFrame:
    keys = md.matches.select(F.col("competition_id").alias("k")).distinct().unionAll(
        md.matches.select(F.concat(F.col("home_team_id"), F.lit(":x")).alias("k")).distinct())
    p = L.parse_competition_key(F.col("k"))
    return keys.select("k", p["league"].alias("league"), p["season"].alias("season"),
                       (p["league"].isNull() | p["season"].isNull()).alias("invalid"))


# ------------------------------------------------------------- B13 / B14
@register("first_event_detail", """
SELECT event_id, CASE WHEN type = 'Pass' THEN 'pass' WHEN type = 'Shot' THEN 'shot' WHEN type = 'Carry' THEN 'carry'
                      WHEN type = 'Dribble' THEN 'dribble' WHEN type = 'Duel' THEN 'duel' WHEN type = 'Goal Keeper' THEN 'goalkeeper' END AS detail
FROM v_events WHERE source = 'statsbomb'
""", ("v_events",))
def first_event_detail(md: MatchData) -> DataFrame:
    e = md.events.where(F.col("source") != SOURCE_FEED)
    kinds = [("pass", "Pass"), ("shot", "Shot"), ("carry", "Carry"), ("dribble", "Dribble"), ("duel", "Duel"),
             ("goalkeeper", "Goal Keeper")]
    structs = [F.when(F.col("type") == t, F.struct(F.lit(k).alias("kind"))) for k, t in kinds]
    return e.select("event_id", F.coalesce(*structs)["kind"].alias("detail"))


@register("split_location", """
SELECT event_id, CASE WHEN len(loc) >= 2 THEN loc[1] END AS x, CASE WHEN len(loc) >= 2 THEN loc[2] END AS y
FROM (SELECT event_id, CASE WHEN location_x IS NULL THEN [] WHEN sequence % 2 = 0 THEN [location_x, location_y]
                            ELSE [location_x, location_y, 0.0] END AS loc FROM v_events) s
""", ("v_events",))
def split_location(md: MatchData) -> DataFrame:
    e = md.events
    loc = (F.when(F.col("location_x").isNull(), F.array().cast("array<double>"))
           .when(F.col("sequence") % 2 == 0, F.array("location_x", "location_y"))
           .otherwise(F.array("location_x", "location_y", F.lit(0.0))))
    x, y = L.split_location(loc)
    return e.select("event_id", x.alias("x"), y.alias("y"))


# ---------------------------------------------------------- B15 B18 B19 B20
@register("author_label", """
SELECT DISTINCT user_id, 'Member ' || coalesce(nullif(substr(replace(CASE WHEN user_id % 7 = 0 THEN '--' ELSE
        'u-' || cast(user_id AS varchar) || '-aa-' || cast(user_id * 31 AS varchar) END, '-', ''), 1, 6), ''), 'member') AS author
FROM events
""")
def author_label(md: MatchData) -> DataFrame:
    e = md.read("events", "user_id").distinct()
    uid = F.when(F.col("user_id") % 7 == 0, F.lit("--")).otherwise(
        F.concat(F.lit("u-"), F.col("user_id").cast("string"), F.lit("-aa-"), (F.col("user_id") * 31).cast("string")))
    return e.select("user_id", L.author_label(uid).alias("author"))


@register("normalize_entity", """
SELECT c_custkey, lower(regexp_replace(trim('  ' || replace(c_name, '#', '   # ') || ' '), '\\s+', ' ', 'g')) AS entity
FROM customer
""")
def normalize_entity(md: MatchData) -> DataFrame:
    c = md.read("customer", "c_custkey", "c_name")
    raw = F.concat(F.lit("  "), F.regexp_replace("c_name", "#", "   # "), F.lit(" "))
    return c.select("c_custkey", L.normalize_entity(raw).alias("entity"))


@register("normalize_language", """
SELECT doc_id, CASE WHEN lower(trim(lang)) IN ('en', 'es', 'fr', 'pt', 'de') THEN lower(trim(lang)) ELSE 'en' END AS language
FROM documents
""")
def normalize_language(md: MatchData) -> DataFrame:
    d = md.read("documents", "doc_id", "lang")
    return d.select("doc_id", L.normalize_language(F.col("lang")).alias("language"))


@register("parse_bool", """
SELECT event_id, CASE WHEN flag IS NULL THEN NULL WHEN lower(trim(flag)) IN ('true', '1', 'yes') THEN true
                      WHEN lower(trim(flag)) IN ('false', '0', 'no') THEN false ELSE length(flag) > 0 END AS flag
FROM (SELECT event_id, CASE event_type WHEN 'signup' THEN ' TRUE ' WHEN 'purchase' THEN '0' WHEN 'click' THEN 'Yes'
                       WHEN 'view' THEN 'maybe' ELSE CASE WHEN event_id % 2 = 0 THEN '' END END AS flag FROM events) e
""")
def parse_bool(md: MatchData) -> DataFrame:
    e = md.read("events", "event_id", "event_type")
    t = F.col("event_type")
    flag = (F.when(t == "signup", " TRUE ").when(t == "purchase", "0").when(t == "click", "Yes")
            .when(t == "view", "maybe").otherwise(F.when(F.col("event_id") % 2 == 0, F.lit(""))))
    return e.select("event_id", L.parse_bool(flag).alias("flag"))


# ------------------------------------------------------------------- 2.C
@register("collect_teams", """
SELECT team_id, name FROM (
  SELECT team_id, name, row_number() OVER (PARTITION BY team_id ORDER BY match_date DESC, match_id DESC, side) AS rn FROM (
    SELECT home_team_id AS team_id, home_team_name AS name, match_date, match_id, 0 AS side FROM v_matches
    UNION ALL SELECT away_team_id, away_team_name, match_date, match_id, 1 FROM v_matches) s) r WHERE rn = 1
""", ("v_matches",))
def collect_teams(md: MatchData) -> DataFrame:
    """Teams of home and away sides, the last seen row wins."""
    m = md.matches
    s = (m.select(F.col("home_team_id").alias("team_id"), F.col("home_team_name").alias("name"), "match_date",
                  "match_id", F.lit(0).alias("side"))
         .unionAll(m.select("away_team_id", "away_team_name", "match_date", "match_id", F.lit(1))))
    w = Window.partitionBy("team_id").orderBy(F.desc("match_date"), F.desc("match_id"), "side")
    return s.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("team_id", "name")


@register("fallback_entities", """
SELECT DISTINCT kind, id, coalesce(name, id) AS name FROM (
  SELECT 'team' AS kind, team_id AS id, team_name AS name FROM v_events WHERE team_id IS NOT NULL
  UNION ALL SELECT 'team', possession_team_id, possession_team_name FROM v_events WHERE possession_team_id IS NOT NULL
  UNION ALL SELECT 'player', player_id, NULL FROM v_events WHERE player_id IS NOT NULL) s
WHERE (kind = 'team' AND id NOT IN (SELECT team_id FROM v_teams WHERE rk <> 2))
   OR (kind = 'player' AND id NOT IN (SELECT player_id FROM v_players WHERE team_id NOT IN (SELECT team_id FROM v_teams WHERE rk = 2)))
""", ("v_events", "v_teams", "v_players"))
def fallback_entities(md: MatchData) -> DataFrame:
    """Teams (acting and possession) and players seen only in events get a
    row; the name falls back to the id. The stored tables here lack region 2."""
    e = md.events
    seen = (e.where(F.col("team_id").isNotNull()).select(F.lit("team").alias("kind"), F.col("team_id").alias("id"),
                                                         F.col("team_name").alias("name"))
            .unionAll(e.where(F.col("possession_team_id").isNotNull()).select(
                F.lit("team"), "possession_team_id", "possession_team_name"))
            .unionAll(e.where(F.col("player_id").isNotNull()).select(F.lit("player"), "player_id",
                                                                     F.lit(None).cast("string"))))
    stored_teams = md.teams.where(F.col("rk") != 2).select(F.col("team_id").alias("id"))
    stored_players = md.players.join(md.teams.where(F.col("rk") == 2).select("team_id"), "team_id", "left_anti").select(
        F.col("player_id").alias("id"))
    new_t = seen.where(F.col("kind") == "team").join(stored_teams, "id", "left_anti")
    new_p = seen.where(F.col("kind") == "player").join(stored_players, "id", "left_anti")
    return new_t.unionByName(new_p).select("kind", "id", F.coalesce("name", "id").alias("name")).distinct()


def _player_loads(md: MatchData) -> DataFrame:
    p = md.players
    n = F.regexp_extract("player_id", r"-P(\d+)$", 1).cast("int")
    first = p.select("player_id", "team_id", "name", "display_name", "country", "jersey_number", "positions", F.lit(1).alias("load"))
    # in the second load the eleventh player of each team has moved to another one
    second = p.select("player_id", F.when(n == 10, "moved").otherwise(F.col("team_id")).alias("team_id"), F.upper("name").alias("name"),
                      F.when(n % 3 != 0, F.col("display_name")).alias("display_name"),
                      F.when(n % 4 != 0, F.col("country")).alias("country"),
                      F.when(n % 5 != 0, F.col("jersey_number") + 20).alias("jersey_number"),
                      F.array(F.lit("Substitute"), F.col("positions")[0]).alias("positions"), F.lit(2).alias("load"))
    return first.unionByName(second)


@register("merge_players", """
SELECT player_id, upper(name) AS name,
       CASE WHEN cast(split_part(player_id, '-P', 2) AS int) % 3 <> 0 THEN display_name ELSE display_name END AS display_name,
       country
FROM v_players
""", ("v_players",))
def merge_players(md: MatchData) -> DataFrame:
    """The later load wins, but a null display name / country keeps the old one."""
    w = Window.partitionBy("player_id").orderBy("load").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    loads = _player_loads(md)
    merged = loads.select("player_id", F.last("name").over(w).alias("name"),
                          F.last("display_name", ignorenulls=True).over(w).alias("display_name"),
                          F.last("country", ignorenulls=True).over(w).alias("country"), "load")
    return merged.where("load = 2").drop("load")


def merge_team_rows(loads: DataFrame) -> DataFrame:
    """C4: one row per (player, team): the newest load that has a jersey number
    gives it, positions are the sorted distinct union over the loads. A player
    who moves keeps a row for either team."""
    return loads.groupBy("player_id", "team_id").agg(
        F.max_by("jersey_number", F.when(F.col("jersey_number").isNotNull(), F.col("load"))).alias("jersey_number"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("positions"))


@register("merge_player_teams", """
SELECT player_id, team_id, arg_max(jersey_number, load) FILTER (WHERE jersey_number IS NOT NULL) AS jersey_number,
       list_sort(list(DISTINCT position)) AS positions
FROM (SELECT player_id, team_id, load, jersey_number, unnest(positions) AS position FROM loads)
GROUP BY player_id, team_id
""", ("v_players",), {
    "numbered": "SELECT *, cast(split_part(player_id, '-P', 2) AS int) AS n FROM v_players",
    "loads": """
SELECT player_id, team_id, 1 AS load, jersey_number,
       [['Goalkeeper', 'Defender', 'Midfielder', 'Attacker'][n % 4 + 1], ['Goalkeeper', 'Defender', 'Midfielder', 'Attacker'][(n + 1) % 4 + 1]] AS positions FROM numbered
UNION ALL
SELECT player_id, CASE WHEN n = 10 THEN 'moved' ELSE team_id END, 2, CASE WHEN n % 5 <> 0 THEN jersey_number + 20 END,
       ['Substitute', ['Goalkeeper', 'Defender', 'Midfielder', 'Attacker'][n % 4 + 1]] FROM numbered"""})
def merge_player_teams(md: MatchData) -> DataFrame:
    return merge_team_rows(_player_loads(md))


@register("resolve_entities", """
SELECT q.name, coalesce(p.kind, t.kind) AS kind, coalesce(p.id, t.id) AS id
FROM (SELECT DISTINCT trim(player_name) AS name FROM v_events WHERE player_name IS NOT NULL
      UNION SELECT DISTINCT trim(team_name) FROM v_events WHERE team_name IS NOT NULL) q
LEFT JOIN (SELECT name, 'player' AS kind, min(player_id) AS id FROM v_players GROUP BY name) p ON p.name = q.name
LEFT JOIN (SELECT name, 'team' AS kind, min(team_id) AS id FROM v_teams GROUP BY name) t ON t.name = q.name
WHERE coalesce(p.id, t.id) IS NOT NULL
""", ("v_events", "v_players", "v_teams"))
def resolve_entities(md: MatchData) -> DataFrame:
    """Distinct trimmed names -> players first, then teams; exact match,
    the first (smallest id) wins."""
    e = md.events
    names = (e.where(F.col("player_name").isNotNull()).select(F.trim("player_name").alias("name"))
             .unionAll(e.where(F.col("team_name").isNotNull()).select(F.trim("team_name").alias("name"))).distinct())
    cands = (md.players.select("name", F.lit("player").alias("kind"), F.col("player_id").alias("id"), F.lit(0).alias("pri"))
             .unionAll(md.teams.select("name", F.lit("team"), "team_id", F.lit(1))))
    j = names.join(cands, "name")
    w = Window.partitionBy("name").orderBy("pri", "id")
    return j.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("name", "kind", "id")
