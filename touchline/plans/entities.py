"""Entity queries over every competition: metrics, profiles, comparisons,
featured entities, follow cards, shot / pass maps, cited events, and posts
rendered from them.

Where these read stored model output (``shot_xg``, action values) the test
tables have none, so an integer rule stands in for the stored tables: it is
the input of these queries, and lets their SQL say what they must return. The
fitted values go through the same operators in ``player_metric_totals`` etc.

Limits are per entity, with a flag where rows were left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import spadl as S
from ..operators import totals as TT
from ..sources.projections import SOURCE_FEED, MatchData
from .catalog import register
from .valuation import xt_actions

METRICS = ("goals", "shots", "passes", "xt", "vaep", "xg")
FEATURED = 6
SHOT_LIMIT, PASS_LIMIT, EVIDENCE_LIMIT = 600, 1200, 400  # rows of one entity

# ------------------------------------------------- stored model output (stand-in)
RULE_SQL = """
SELECT a.action_id, a.match_id, a.team_id, a.player_id, m.competition_id, x.xt_value,
       a.spadl_type IN ('shot', 'shot_penalty', 'shot_freekick') AS is_shot,
       CASE WHEN a.spadl_type IN ('shot', 'shot_penalty', 'shot_freekick') THEN ((a.match_id * 13 + a.action_order * 7) % 50 + 1) / 100.0 END AS xg,
       ((a.action_order * 3 + a.match_id) % 41 - 20) / 100.0 + ((a.action_order * 5 + a.match_id) % 21 - 10) / 100.0 AS vaep
FROM v_spadl a JOIN v_matches m ON m.match_id = a.match_id JOIN v_xt_values x ON x.action_id = a.action_id"""
STACKED_SQL = """
SELECT kind, CASE kind WHEN 'player' THEN player_id ELSE team_id END AS id, competition_id, xt_value, vaep, xg, is_shot
FROM valued, (VALUES ('player'), ('team')) k(kind)"""
TOTALS_SQL = """
SELECT kind, id, competition_id, coalesce(sum(xt_value), 0) AS xt, coalesce(sum(vaep), 0) AS vaep, coalesce(sum(xg), 0) AS xg,
       count(*) FILTER (WHERE is_shot) AS shots
FROM stacked WHERE id IS NOT NULL GROUP BY kind, id, competition_id"""
COUNTS_SQL = """
SELECT kind, id, competition_id, count(*) FILTER (WHERE type = 'Shot' AND outcome = 'Goal') AS goals,
       count(*) FILTER (WHERE type = 'Pass') AS passes
FROM (SELECT kind, CASE kind WHEN 'player' THEN player_id ELSE team_id END AS id, m.competition_id, e.type, e.outcome
      FROM v_events e JOIN v_matches m ON m.match_id = e.match_id, (VALUES ('player'), ('team')) k(kind))
WHERE id IS NOT NULL GROUP BY kind, id, competition_id"""
METRICS_SQL = """
SELECT t.kind, t.id, t.competition_id, coalesce(c.goals, 0) AS goals, t.shots, coalesce(c.passes, 0) AS passes,
       round(t.xt, 6) AS xt, round(t.vaep, 6) AS vaep, round(t.xg, 6) AS xg
FROM totals t LEFT JOIN counts c USING (kind, id, competition_id)
UNION ALL
SELECT 'team', team_id, competition_id, cast(sum(coalesce(goals, 0)) AS bigint), NULL, NULL, NULL, NULL, NULL
FROM (SELECT home_team_id AS team_id, competition_id, home_score AS goals FROM v_matches WHERE source = 'api_football'
      UNION ALL SELECT away_team_id, competition_id, away_score FROM v_matches WHERE source = 'api_football') GROUP BY 2, 3"""
VIEWS = ("v_spadl", "v_xt_values", "v_events", "v_matches", "v_teams", "v_players", "v_competitions")
CTES = {"valued": RULE_SQL, "stacked": STACKED_SQL, "totals": TOTALS_SQL, "counts": COUNTS_SQL, "metrics": METRICS_SQL}


def rule_actions(md: MatchData) -> DataFrame:
    """Actions with the stand-in values (shots also with ``xg``)."""
    order, match = F.col("action_order"), F.col("match_id")
    off = ((order * 3 + match) % 41 - 20) / 100.0
    deff = ((order * 5 + match) % 21 - 10) / 100.0
    shot = F.col("spadl_type").isin(*S.SHOT_TYPES)
    return xt_actions(md).withColumns({
        "vaep_offensive": off, "vaep_defensive": deff, "vaep_value": off + deff,
        "xg": F.when(shot, ((match * 13 + order * 7) % 50 + 1) / 100.0)})


def rule_totals(md: MatchData, kind: str) -> DataFrame:
    def build() -> DataFrame:
        acts = rule_actions(md)
        names = (md.players if kind == "player" else md.teams).select(f"{kind}_id", "name")
        return TT.metric_totals(acts, None, F.col("xg").isNotNull(), md.matches, names, f"{kind}_id", f"{kind}_name")

    return md.memo(f"rule_totals_{kind}", build)


def _sides(md: MatchData) -> DataFrame:
    m = md.matches
    return (m.select("match_id", "competition_id", "source", F.col("home_team_id").alias("team_id"), F.col("home_score").alias("goals"))
            .unionAll(m.select("match_id", "competition_id", "source", F.col("away_team_id"), F.col("away_score"))))


def entity_metrics(md: MatchData, kind: str) -> DataFrame:
    """The six metrics of every entity in every competition it plays
    in. The match feed knows a team's goals only: its other metrics are null
    (not available), never zero."""
    key = f"{kind}_id"
    m = md.matches.select("match_id", "competition_id")
    e = md.events.drop("competition_id").where(F.col(key).isNotNull()).join(m, "match_id")
    counts = e.groupBy(F.col(key).alias("id"), "competition_id").agg(
        F.count_if((F.col("type") == "Shot") & (F.col("outcome") == "Goal")).alias("goals"),
        F.count_if(F.col("type") == "Pass").alias("passes"))
    totals = rule_totals(md, kind).select(
        F.col(key).alias("id"), "competition_id", F.col("shot_count").alias("shots"), F.round("total_xt", 6).alias("xt"),
        F.round("total_vaep", 6).alias("vaep"), F.round("total_xg", 6).alias("xg"))
    out = totals.join(counts, ["id", "competition_id"], "left").select(
        "id", "competition_id", F.coalesce("goals", F.lit(0)).alias("goals"), "shots",
        F.coalesce("passes", F.lit(0)).alias("passes"), "xt", "vaep", "xg")
    if kind == "team":
        none = [F.lit(None).cast(t).alias(c) for c, t in (("shots", "long"), ("passes", "long"), ("xt", "double"), ("vaep", "double"), ("xg", "double"))]
        feed = (_sides(md).where(F.col("source") == SOURCE_FEED).groupBy(F.col("team_id").alias("id"), "competition_id")
                .agg(F.sum(F.coalesce("goals", F.lit(0))).cast("long").alias("goals")))
        out = out.unionByName(feed.select("id", "competition_id", "goals", *none))
    return out


def _metrics_query(kind: str):
    names = "v_players" if kind == "player" else "v_teams"
    sql = f"""
SELECT m.id AS {kind}_id, m.competition_id, n.name, m.goals, m.shots, m.passes, m.xt, m.vaep, m.xg
FROM metrics m LEFT JOIN {names} n ON n.{kind}_id = m.id WHERE m.kind = '{kind}'"""

    def query(md: MatchData) -> DataFrame:
        names_of = (md.players if kind == "player" else md.teams).select(F.col(f"{kind}_id").alias("id"), "name")
        return entity_metrics(md, kind).join(names_of, "id", "left").select(
            F.col("id").alias(f"{kind}_id"), "competition_id", "name", *METRICS)

    query.__name__ = f"{kind}_entity_metrics"
    register(f"{kind}_entity_metrics", sql, VIEWS, CTES)(query)


_metrics_query("player")
_metrics_query("team")


# ------------------------------------------------------------------- I10
def compare(metrics: DataFrame, pairs: DataFrame, *carry: str) -> DataFrame:
    """The six metrics of two entities side by side, for every row of ``pairs``
    (competition_id, left_id, right_id). ``higher`` is null where a side lacks
    the metric."""
    long = metrics.select("id", "competition_id", F.explode(F.array(*(
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in METRICS))).alias("x")).select(
        "id", "competition_id", "x.metric", "x.value")
    a = long.select(F.col("id").alias("left_id"), "competition_id", "metric", F.col("value").alias("left_value"))
    b = long.select(F.col("id").alias("right_id"), "competition_id", "metric", F.col("value").alias("right_value"))
    lv, rv = F.col("left_value"), F.col("right_value")
    return pairs.join(a, ["competition_id", "left_id"]).join(b, ["competition_id", "right_id", "metric"]).select(
        *carry, "competition_id", "left_id", "right_id", "metric", "left_value", "right_value",
        F.when(lv.isNull() | rv.isNull(), None).when(lv > rv, "left").when(rv > lv, "right").otherwise("equal").alias("higher"))


LONG_SQL = " UNION ALL ".join(f"SELECT kind, id, competition_id, '{n}' AS metric, cast({n} AS double) AS value FROM metrics" for n in METRICS)


@register("compare_entities", """
SELECT p.match_id, p.competition_id, p.home_team_id AS left_id, p.away_team_id AS right_id, a.metric,
       a.value AS left_value, b.value AS right_value,
       CASE WHEN a.value > b.value THEN 'left' WHEN b.value > a.value THEN 'right' WHEN a.value = b.value THEN 'equal' END AS higher
FROM v_matches p
JOIN long a ON a.kind = 'team' AND a.id = p.home_team_id AND a.competition_id = p.competition_id
JOIN long b ON b.kind = 'team' AND b.id = p.away_team_id AND b.competition_id = p.competition_id AND b.metric = a.metric
""", VIEWS, {**CTES, "long": LONG_SQL})
def compare_entities(md: MatchData) -> DataFrame:
    """I10 in bulk: both teams of every match, within the match's competition."""
    pairs = md.matches.select("match_id", "competition_id", F.col("home_team_id").alias("left_id"), F.col("away_team_id").alias("right_id"))
    return compare(entity_metrics(md, "team"), pairs, "match_id")


# ------------------------------------------------------------- J1 - J4
def _featured(kind: str):
    names = "v_players" if kind == "player" else "v_teams"

    def query(md: MatchData) -> DataFrame:
        return (rule_totals(md, kind).orderBy(F.desc("total_xg"), f"{kind}_name", f"{kind}_id", "competition_id").limit(FEATURED)
                .select(f"{kind}_id", f"{kind}_name", "competition_id", F.round("total_xg", 6).alias("total_xg")))

    query.__name__ = f"featured_{kind}s"
    query.__doc__ = f"J1: the {kind}s with the most xG in any competition."
    register(f"featured_{kind}s", f"""
SELECT t.id AS {kind}_id, n.name AS {kind}_name, t.competition_id, round(t.xg, 6) AS total_xg
FROM totals t LEFT JOIN {names} n ON n.{kind}_id = t.id WHERE t.kind = '{kind}'
ORDER BY t.xg DESC, n.name, t.id, t.competition_id LIMIT {FEATURED}""", VIEWS, CTES)(query)


_featured("player")
_featured("team")


def _profile(kind: str):
    extra = ("p.country, p.team_id, w.name AS team_name," if kind == "player" else "p.country,")
    source = "v_players p LEFT JOIN v_teams w ON w.team_id = p.team_id" if kind == "player" else "v_teams p"
    sql = f"""
SELECT m.id AS {kind}_id, p.name AS {kind}_name, {extra} m.competition_id, c.name AS competition_name,
       m.shots AS shot_count, m.goals, m.passes, m.xt, m.vaep, m.xg
FROM metrics m JOIN v_competitions c ON c.competition_id = m.competition_id
LEFT JOIN ({'SELECT p.*, w.name AS wname FROM ' + source if kind == 'player' else 'SELECT * FROM v_teams'}) p ON p.{kind}_id = m.id
WHERE m.kind = '{kind}'""".replace("w.name AS team_name", "p.wname AS team_name")

    def query(md: MatchData) -> DataFrame:
        c = md.competitions.select("competition_id", F.col("name").alias("competition_name"))
        if kind == "player":
            w = md.teams.select("team_id", F.col("name").alias("team_name"))
            p = md.players.select(F.col("player_id").alias("id"), F.col("name").alias("player_name"), "country", "team_id").join(w, "team_id", "left")
            own = ["player_name", "country", "team_id", "team_name"]
        else:
            p = md.teams.select(F.col("team_id").alias("id"), F.col("name").alias("team_name"), "country")
            own = ["team_name", "country"]
        return entity_metrics(md, kind).join(c, "competition_id").join(p, "id", "left").select(
            F.col("id").alias(f"{kind}_id"), *own, "competition_id", "competition_name", F.col("shots").alias("shot_count"),
            "goals", "passes", "xt", "vaep", "xg")

    query.__name__ = f"{kind}_profile"
    query.__doc__ = f"The profile of every {kind} in every competition."
    register(f"{kind}_profile", sql, VIEWS, CTES)(query)


_profile("player")
_profile("team")


def cards(follows: DataFrame, totals: dict[str, DataFrame], names: dict[str, DataFrame]) -> DataFrame:
    """Each user's followed players, then teams, in follow order, with the
    xG of the entity's last competition by id (null without totals)."""
    parts = []
    for order, kind, other in ((0, "player", "team"), (1, "team", "player")):
        key = f"{kind}_id"
        xg = totals[kind].groupBy(key).agg(F.max_by("total_xg", "competition_id").alias("xg"))
        own = follows.where(F.col(key).isNotNull() & F.col(f"{other}_id").isNull()).join(xg, key, "left").join(names[kind], key, "left")
        parts.append(own.select("user_id", "event_id", F.lit(order).alias("kind_order"), F.lit(kind).alias("kind"),
                                F.col(key).alias("entity_id"), F.coalesce("name", key).alias("name"), "xg"))
    w = Window.partitionBy("user_id").orderBy("kind_order", "event_id")
    return parts[0].unionByName(parts[1]).select(
        "user_id", "kind", "entity_id", "name", F.lit("Expected goals").alias("metric_label"), F.round("xg", 6).alias("xg"),
        F.row_number().over(w).alias("position"))


def _follow_cards() -> None:
    from .accounts import FOLLOWS_SQL, follows

    def follow_cards(md: MatchData) -> DataFrame:
        return cards(follows(md), {k: rule_totals(md, k) for k in ("player", "team")},
                     {"player": md.players.select("player_id", "name"), "team": md.teams.select("team_id", "name")})

    register("follow_cards", """
SELECT user_id, kind, entity_id, coalesce(name, entity_id) AS name, 'Expected goals' AS metric_label, round(xg, 6) AS xg,
       cast(row_number() OVER (PARTITION BY user_id ORDER BY kind, event_id) AS integer) AS position
FROM (SELECT f.user_id, f.event_id, f.kind, f.entity_id, coalesce(p.name, t.name) AS name, x.xg
      FROM (SELECT user_id, event_id, CASE WHEN team_id IS NULL THEN 'player' ELSE 'team' END AS kind, coalesce(team_id, player_id) AS entity_id
            FROM follow_rows WHERE (team_id IS NULL) <> (player_id IS NULL)) f
      LEFT JOIN (SELECT kind, id, arg_max(xg, competition_id) AS xg FROM totals GROUP BY 1, 2) x ON x.kind = f.kind AND x.id = f.entity_id
      LEFT JOIN v_players p ON f.kind = 'player' AND p.player_id = f.entity_id
      LEFT JOIN v_teams t ON f.kind = 'team' AND t.team_id = f.entity_id)
""", VIEWS, {**CTES, "follow_rows": FOLLOWS_SQL})(follow_cards)


_follow_cards()


# ------------------------------------------------------------- J6 - J8
def per_entity(events: DataFrame, kinds: tuple[str, ...], limit: int, *order: Column) -> DataFrame:
    """The first ``limit`` events of every entity of the given kinds, with
    ``truncated`` where the entity has more."""
    rows = _first(_by_entity(events, kinds), limit + 1, *order)
    own = Window.partitionBy("kind", "entity_id")
    return rows.withColumn("truncated", F.count(F.lit(1)).over(own) > limit).where(F.col("__n") <= limit).drop("__n")


def _by_entity(events: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """A row for each entity of an event, in one pass over the events."""
    of = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"{k}_id").alias("entity_id")) for k in kinds)))
    return events.select(of.alias("__of"), "*").where(F.col("__of.entity_id").isNotNull()).select(
        "__of.kind", "__of.entity_id", *events.columns)


def _first(rows: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first rows of every entity, numbered from 1 in ``__n``; Spark also
    cuts them before the shuffle, so it does not grow with an entity's events."""
    own = Window.partitionBy("kind", "entity_id").orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(own)).where(F.col("__n") <= limit)


def with_xg(md: MatchData, events: DataFrame, kinds: tuple[str, ...], limit: int, *order: Column) -> DataFrame:
    """:func:`per_entity` of the events with their xG. An event keeps its place
    when it gets its xG, so one row more than the limit of each entity decides
    everything and no other row has to be joined."""
    rows = _first(_by_entity(events, kinds), limit + 1, *order).drop("__n").join(_shot_xg(md), "event_id", "left")
    own = Window.partitionBy("kind", "entity_id")
    return (_first(rows, limit + 1, *order).withColumn("truncated", F.count(F.lit(1)).over(own) > limit)
            .where(F.col("__n") <= limit).drop("__n"))


def _located(md: MatchData, kind: str) -> DataFrame:
    return md.events.where((F.col("type") == kind) & F.col("location_x").isNotNull() & F.col("location_y").isNotNull())


def _shot_xg(md: MatchData) -> DataFrame:
    return rule_actions(md).where(F.col("xg").isNotNull()).select(F.col("action_id").alias("event_id"), F.round("xg", 6).alias("xg"))


_ENTITY_EVENTS = """
SELECT kind, CASE kind WHEN 'player' THEN player_id ELSE team_id END AS entity_id, e.*
FROM v_events e, (VALUES ('player'), ('team')) k(kind) WHERE location_x IS NOT NULL AND location_y IS NOT NULL"""


def by_minute() -> tuple[Column, ...]:
    return F.asc_nulls_last("minute"), F.col("sequence"), F.col("event_id")


def _ranked(body: str, where: str, limit: int) -> str:
    return f"""
SELECT {body}, n > {limit} AS truncated
FROM (SELECT *, row_number() OVER (PARTITION BY kind, entity_id ORDER BY minute NULLS LAST, sequence, event_id) AS rn,
             count(*) OVER (PARTITION BY kind, entity_id) AS n
      FROM own WHERE entity_id IS NOT NULL AND {where}) x
LEFT JOIN valued v ON v.action_id = x.event_id WHERE rn <= {limit}"""


@register("shot_map", _ranked("kind, entity_id, event_id, minute, location_x, location_y, outcome, coalesce(outcome = 'Goal', false) AS goal, round(v.xg, 6) AS xg, player_name, team_name",
                              "type = 'Shot'", SHOT_LIMIT), VIEWS, {"valued": RULE_SQL, "own": _ENTITY_EVENTS})
def shot_map(md: MatchData) -> DataFrame:
    """The shots of every player and team, by minute."""
    return with_xg(md, _located(md, "Shot"), ("player", "team"), SHOT_LIMIT, *by_minute()).select(
        "kind", "entity_id", "event_id", "minute", "location_x", "location_y", "outcome",
        F.coalesce(F.col("outcome") == "Goal", F.lit(False)).alias("goal"), "xg", "player_name", "team_name", "truncated")


@register("pass_map", _ranked("kind, entity_id, event_id, minute, location_x, location_y, end_location_x, end_location_y, outcome IS NULL AS completed, player_name, team_name",
                              "type = 'Pass' AND end_location_x IS NOT NULL AND end_location_y IS NOT NULL", PASS_LIMIT),
          VIEWS, {"valued": RULE_SQL, "own": _ENTITY_EVENTS})
def pass_map(md: MatchData) -> DataFrame:
    """The passes with both ends of every player and team, by minute."""
    ev = _located(md, "Pass").where(F.col("end_location_x").isNotNull() & F.col("end_location_y").isNotNull())
    return per_entity(ev, ("player", "team"), PASS_LIMIT, *by_minute()).select(
        "kind", "entity_id", "event_id", "minute", "location_x", "location_y", "end_location_x", "end_location_y",
        F.col("outcome").isNull().alias("completed"), "player_name", "team_name", "truncated")


def _cited(event_type: str, label: str):
    name = "cited_events" if event_type == "Shot" else "cited_passes"

    def query(md: MatchData) -> DataFrame:
        return with_xg(md, _located(md, event_type), ("player", "team"), EVIDENCE_LIMIT, *by_minute()).select(
            "kind", "entity_id", "event_id", "player_name", "team_name", "minute", F.coalesce("outcome", F.lit(label)).alias("outcome_label"),
            "location_x", "location_y", "end_location_x", "end_location_y",
            F.coalesce(F.col("outcome") == "Goal", F.lit(False)).alias("goal"), "xg", "truncated")

    query.__name__ = name
    query.__doc__ = f"J8: the {event_type.lower()} events behind an answer about any player or team."
    register(name, _ranked(f"kind, entity_id, event_id, player_name, team_name, minute, coalesce(outcome, '{label}') AS outcome_label, location_x, location_y, "
                           "end_location_x, end_location_y, coalesce(outcome = 'Goal', false) AS goal, round(v.xg, 6) AS xg",
                           f"type = '{event_type}'", EVIDENCE_LIMIT), VIEWS, {"valued": RULE_SQL, "own": _ENTITY_EVENTS})(query)


_cited("Shot", "Shot")
_cited("Pass", "Complete")



# ------------------------------------------------------------------- Q11
BOARD = 10  # rows of a rendered leaderboard


def board(metrics: DataFrame, names: DataFrame, limit: int = BOARD) -> DataFrame:
    """The first ``limit`` entities of every competition and metric it has, by
    value, then name and id."""
    long = metrics.select("id", "competition_id", F.explode(F.array(*(
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in METRICS))).alias("x"))
    named = long.select("id", "competition_id", "x.metric", "x.value").where(F.col("value").isNotNull()).join(names, "id")
    w = Window.partitionBy("competition_id", "metric").orderBy(F.desc("value"), "name", "id")
    return named.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


def _render_posts() -> None:
    from .accounts import _CLIPS_SQL, _IN_SQL, POSTS_SQL, posts, validate_posts
    from .replay import track_metrics

    def render_posts(md: MatchData) -> DataFrame:
        """Q11: accepted posts re-run in bulk: a comparison gives the six metrics
        of both teams, a leaderboard its ten leading teams by its metric, a
        replay its clip's player and ball track counts."""
        ok = validate_posts(md).where(F.col("rejection").isNull()).select("post_id")
        p = posts(md).join(ok, "post_id", "left_semi")
        metrics = entity_metrics(md, "team")
        pairs = p.where(F.col("kind") == "comparison").select("post_id", "competition_id", F.col("team_a").alias("left_id"), F.col("team_b").alias("right_id"))
        c = compare(metrics, pairs, "post_id").select(
            "post_id", F.lit("comparison").alias("kind"), "metric", F.lit(None).cast("int").alias("position"),
            F.concat_ws(" v ", "left_id", "right_id").alias("label"), F.col("left_value").alias("value"), F.col("right_value").alias("other_value"))
        top = board(metrics, md.teams.select(F.col("team_id").alias("id"), "name"))
        b = (p.where(F.col("kind") == "leaderboard").select("post_id", "competition_id", "metric").join(top, ["competition_id", "metric"])
             .select("post_id", F.lit("leaderboard").alias("kind"), "metric", "position", F.col("name").alias("label"), "value",
                     F.lit(None).cast("double").alias("other_value")))
        tracks = track_metrics(md).groupBy("clip_id").agg(F.count_if(F.col("class") == "player").cast("double").alias("value"),
                                                          F.count_if(F.col("class") == "ball").cast("double").alias("other_value"))
        r = (p.where(F.col("kind") == "replay").select("post_id", "clip_id").join(tracks, "clip_id")
             .select("post_id", F.lit("replay").alias("kind"), F.lit("tracks").alias("metric"), F.lit(None).cast("int").alias("position"),
                     F.col("clip_id").alias("label"), "value", "other_value"))
        return c.unionByName(b).unionByName(r)

    register("render_posts", """
SELECT p.post_id, 'comparison' AS kind, a.metric, NULL::integer AS position, p.team_a || ' v ' || p.team_b AS label,
       a.value AS value, b.value AS other_value
FROM accepted p JOIN long a ON p.kind = 'comparison' AND a.kind = 'team' AND a.id = p.team_a AND a.competition_id = p.competition_id
JOIN long b ON b.kind = 'team' AND b.id = p.team_b AND b.competition_id = p.competition_id AND b.metric = a.metric
UNION ALL
SELECT p.post_id, 'leaderboard', p.metric, cast(t.position AS integer), t.name, t.value, NULL
FROM accepted p JOIN (SELECT l.*, n.name, row_number() OVER (PARTITION BY competition_id, metric ORDER BY value DESC, n.name, l.id) AS position
                      FROM long l JOIN v_teams n ON n.team_id = l.id WHERE l.kind = 'team' AND l.value IS NOT NULL) t
  ON p.kind = 'leaderboard' AND t.competition_id = p.competition_id AND t.metric = p.metric AND t.position <= 10
UNION ALL
SELECT p.post_id, 'replay', 'tracks', NULL, p.clip_id, k.players, k.balls
FROM accepted p JOIN (SELECT 'cv:' || clip_name AS clip_id, cast(count(*) FILTER (WHERE class = 'player') AS double) AS players,
                             cast(count(*) FILTER (WHERE class = 'ball') AS double) AS balls
                      FROM (SELECT clip_name, track_id, arg_min(class, ord) AS class
                            FROM (SELECT clip_name, track_id, class, row_number() OVER (ORDER BY count(*) DESC, min(frame_index)) AS ord
                                  FROM v_track_points GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1) k
  ON p.kind = 'replay' AND k.clip_id = p.clip_id
""", VIEWS + ("v_track_points",), {**CTES, "long": LONG_SQL, "p": POSTS_SQL, "inside": _IN_SQL, "clips": _CLIPS_SQL, "accepted": """
SELECT p.* FROM p LEFT JOIN v_competitions c ON c.competition_id = p.competition_id
WHERE caption_len <= 280 AND CASE p.kind
  WHEN 'comparison' THEN team_a <> team_b AND EXISTS (SELECT 1 FROM inside i WHERE i.competition_id = p.competition_id AND i.team_id = p.team_a)
                         AND EXISTS (SELECT 1 FROM inside i WHERE i.competition_id = p.competition_id AND i.team_id = p.team_b)
  WHEN 'leaderboard' THEN c.source = 'statsbomb' OR (c.source = 'api_football' AND metric = 'goals')
  ELSE clip_id IN (SELECT clip_id FROM clips) END"""})(render_posts)


_render_posts()


# ------------------------------------------------------------- H1 - H3, I6
def _boards(kind: str) -> None:
    names = "v_players" if kind == "player" else "v_teams"

    def metric_leaderboards(md: MatchData) -> DataFrame:
        names_of = (md.players if kind == "player" else md.teams).select(F.col(f"{kind}_id").alias("id"), "name")
        return board(entity_metrics(md, kind), names_of).select("competition_id", "metric", "position", "id", "name", "value")

    metric_leaderboards.__doc__ = f"I6 in bulk: the ten leading {kind}s of every competition by every metric it has."
    register(f"{kind}_metric_leaderboards", f"""
SELECT competition_id, metric, cast(position AS integer) AS position, id, name, value
FROM (SELECT l.competition_id, l.metric, l.id, n.name, l.value,
             row_number() OVER (PARTITION BY l.competition_id, l.metric ORDER BY l.value DESC, n.name, l.id) AS position
      FROM long l JOIN {names} n ON n.{kind}_id = l.id WHERE l.kind = '{kind}' AND l.value IS NOT NULL)
WHERE position <= {BOARD}""", VIEWS, {**CTES, "long": LONG_SQL})(metric_leaderboards)

    def totals_rule(md: MatchData) -> DataFrame:
        return rule_totals(md, kind).select(
            f"{kind}_id", "competition_id", *(F.round(c, 6).alias(c) for c in ("total_xt", "total_vaep", "total_xg")), "shot_count")

    totals_rule.__doc__ = f"H1 / H2 over stored value tables given by a rule ({kind}s)."
    register(f"{kind}_metric_totals_rule", f"""
SELECT id AS {kind}_id, competition_id, round(xt, 6) AS total_xt, round(vaep, 6) AS total_vaep, round(xg, 6) AS total_xg, shots AS shot_count
FROM totals WHERE kind = '{kind}'""", VIEWS, CTES)(totals_rule)


_boards("player")
_boards("team")


@register("metric_totals_replaced", """
SELECT id AS player_id, competition_id, round(xg, 6) AS total_xg FROM totals WHERE kind = 'player'
UNION ALL SELECT 'gone', 'c', -1.0""", VIEWS, CTES)
def metric_totals_replaced(md: MatchData) -> DataFrame:
    """H3: fresh totals over a stored table: stale values are replaced, a row
    that has no fresh value stays, and a second run changes nothing."""
    fresh = rule_totals(md, "player").select("player_id", "competition_id", F.round("total_xg", 6).alias("total_xg"))
    stale = fresh.withColumn("total_xg", F.lit(-5.0)).where(F.length("player_id") % 2 == 0).unionByName(
        md.spark.createDataFrame([("gone", "c", -1.0)], fresh.schema))
    keys = ["player_id", "competition_id"]
    return TT.upsert(TT.upsert(stale, fresh, keys), fresh, keys)
