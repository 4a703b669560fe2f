"""SPADL conversion and action valuation (xT, xG, VAEP) as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import spadl as S
from ..sources.projections import MatchData
from .catalog import register
from .golden import _first_by, WC_VIEWS, wc_matches


def spadl(md: MatchData) -> DataFrame:
    return md.memo("spadl", lambda: S.spadl_actions(md.events, md.matches))


def known_actions(md: MatchData) -> DataFrame:
    """The SPADL actions; where they were scored, the rows written then."""
    return md.built("scored") or spadl(md)


SPADL_COLS = ("action_id, match_id, action_order, source_event_id, period, time_seconds, team_id, player_id, "
              "round(start_x, 6) AS start_x, round(start_y, 6) AS start_y, round(end_x, 6) AS end_x, "
              "round(end_y, 6) AS end_y, spadl_type, spadl_result, spadl_bodypart")


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@register("spadl_actions", f"SELECT {SPADL_COLS} FROM v_spadl", ("v_spadl",))
def spadl_actions(md: MatchData) -> DataFrame:
    return _rounded(spadl(md), "start_x", "start_y", "end_x", "end_y")


@register("spadl_normalize_label", """
SELECT DISTINCT e.type AS label, coalesce(lower(trim(replace(replace(e.type, '*', ''), '-', ' '))), '') AS normalized
FROM v_events e
""", ("v_events",))
def spadl_normalize_label(md: MatchData) -> DataFrame:
    from ..functions.labels import spadl_label
    return md.events.select(F.col("type").alias("label")).distinct().select("label", spadl_label(F.col("label")).alias("normalized"))


@register("spadl_action_type", "SELECT action_id, spadl_type FROM v_spadl", ("v_spadl",))
def spadl_action_type(md: MatchData) -> DataFrame:
    return spadl(md).select("action_id", "spadl_type")


@register("spadl_bodypart", "SELECT action_id, spadl_bodypart FROM v_spadl", ("v_spadl",))
def spadl_bodypart(md: MatchData) -> DataFrame:
    return spadl(md).select("action_id", "spadl_bodypart")


@register("spadl_result", "SELECT action_id, spadl_type, spadl_result FROM v_spadl", ("v_spadl",))
def spadl_result(md: MatchData) -> DataFrame:
    return spadl(md).select("action_id", "spadl_type", "spadl_result")


@register("spadl_coordinates", """
SELECT action_id, round(start_x, 6) AS start_x, round(start_y, 6) AS start_y,
       round(end_x, 6) AS end_x, round(end_y, 6) AS end_y FROM v_spadl
""", ("v_spadl",))
def spadl_coordinates(md: MatchData) -> DataFrame:
    return _rounded(spadl(md).select("action_id", "start_x", "start_y", "end_x", "end_y"),
                    "start_x", "start_y", "end_x", "end_y")


@register("basic_006", "SELECT count(*) AS action_count FROM v_spadl WHERE match_id IN (SELECT match_id FROM wc)",
          ("v_spadl",) + WC_VIEWS)
def basic_006(md: MatchData) -> DataFrame:
    return (spadl(md).join(wc_matches(md).select("match_id"), "match_id", "left_semi")
            .agg(F.count(F.lit(1)).alias("action_count")))


# ----------------------------------------------------------------------- xT
from ..operators import xt as XT  # noqa: E402


def xt_grid(md: MatchData) -> DataFrame:
    return md.memo("xt_grid", lambda: XT.fit_xt(known_actions(md))[0])


def xt_values(md: MatchData) -> DataFrame:
    return md.memo("xt_values", lambda: XT.xt_values(spadl(md), xt_grid(md)))


def xt_actions(md: MatchData) -> DataFrame:
    """SPADL actions carrying their xT value (no join back on action id)."""
    return md.memo("xt_actions", lambda: XT.with_xt_value(spadl(md), xt_grid(md)))


@register("xt_cell", f"SELECT action_id, {'{'}c{'}'} AS start_cell FROM v_spadl".replace(
    "{c}", "(cast(least(greatest(floor(start_y / 68.0 * 8), 0), 7) AS integer) * 12 + "
           "cast(least(greatest(floor(start_x / 105.0 * 12), 0), 11) AS integer))"), ("v_spadl",))
def xt_cell(md: MatchData) -> DataFrame:
    return spadl(md).select("action_id", XT.cell(F.col("start_x"), F.col("start_y")).alias("start_cell"))


@register("xt_cell_counts", """
SELECT cell, cast(shots AS bigint) AS shots, cast(goals AS bigint) AS goals, cast(moves AS bigint) AS moves,
       round(p_shot, 6) AS p_shot, round(p_goal, 6) AS p_goal, round(p_move, 6) AS p_move FROM v_xt_counts
""", ("v_xt_counts",))
def xt_cell_counts(md: MatchData) -> DataFrame:
    return _rounded(XT.xt_cell_counts(spadl(md)), "p_shot", "p_goal", "p_move")


@register("xt_transitions", """
SELECT start_cell, end_cell, cast(n_ok AS bigint) AS n_ok, cast(n_start AS bigint) AS n_start, round(p, 6) AS p
FROM v_xt_trans
""", ("v_xt_trans",))
def xt_transitions(md: MatchData) -> DataFrame:
    return _rounded(XT.xt_transitions(spadl(md)), "p")


@register("xt_grid", "SELECT cell, round(xt, 6) AS xt FROM v_xt_grid", ("v_xt_grid",))
def xt_grid_query(md: MatchData) -> DataFrame:
    return _rounded(xt_grid(md), "xt")


@register("xt_values", "SELECT action_id, round(xt_value, 6) AS xt_value FROM v_xt_values", ("v_xt_values",))
def xt_values_query(md: MatchData) -> DataFrame:
    return _rounded(xt_values(md), "xt_value")


# ----------------------------------------------------------------------- xG
from ..operators import vaep as VA  # noqa: E402
from ..operators import xg as XG  # noqa: E402


def shot_xg(md: MatchData) -> DataFrame:
    return md.memo("shot_xg", lambda: XG.shot_xg(known_actions(md)))


@register("shot_geometry", """
SELECT action_id, round(sqrt((105.0 - start_x) * (105.0 - start_x) + (34.0 - start_y) * (34.0 - start_y)), 6) AS distance,
       round(acos(greatest(-1.0, least(1.0, CASE WHEN den <> 0 THEN (dl * dl + dr * dr - 7.32 * 7.32) / den ELSE 1.0 END))), 6) AS angle
FROM (SELECT *, 2.0 * dl * dr AS den FROM (
  SELECT action_id, start_x, start_y,
         sqrt((105.0 - start_x) * (105.0 - start_x) + (34.0 - 3.66 - start_y) * (34.0 - 3.66 - start_y)) AS dl,
         sqrt((105.0 - start_x) * (105.0 - start_x) + (34.0 + 3.66 - start_y) * (34.0 + 3.66 - start_y)) AS dr
  FROM v_spadl WHERE spadl_type IN ('shot', 'shot_penalty', 'shot_freekick')) g) h
""", ("v_spadl",))
def shot_geometry(md: MatchData) -> DataFrame:
    f = XG.xg_features(spadl(md))
    return _rounded(f.select("action_id", "distance", "angle"), "distance", "angle")


@register("xg_features", """
SELECT action_id,
       CASE WHEN spadl_bodypart = 'head' THEN 1 ELSE 0 END AS is_head,
       CASE WHEN spadl_bodypart = 'foot_left' THEN 1 ELSE 0 END AS is_left_foot,
       CASE WHEN spadl_bodypart = 'foot_right' THEN 1 ELSE 0 END AS is_right_foot,
       CASE WHEN spadl_bodypart = 'other' THEN 1 ELSE 0 END AS is_other_body_part,
       CASE WHEN spadl_type = 'shot_penalty' THEN 1 ELSE 0 END AS is_penalty,
       CASE WHEN spadl_type = 'shot_freekick' THEN 1 ELSE 0 END AS is_free_kick,
       CASE WHEN spadl_result = 'success' THEN 1 ELSE 0 END AS label
FROM v_spadl WHERE spadl_type IN ('shot', 'shot_penalty', 'shot_freekick')
""", ("v_spadl",))
def xg_features(md: MatchData) -> DataFrame:
    return XG.xg_features(spadl(md)).select("action_id", "is_head", "is_left_foot", "is_right_foot",
                                            "is_other_body_part", "is_penalty", "is_free_kick", "label")


@register("xg_model")
def xg_model(md: MatchData) -> DataFrame:
    return _rounded(shot_xg(md), "xg")


@register("single_class_fallback", """
SELECT CASE WHEN count(DISTINCT label) = 1 THEN 'constant' ELSE 'fitted' END AS mode,
       CASE WHEN count(DISTINCT label) = 1 THEN cast(min(label) AS double) END AS constant_value
FROM (SELECT CASE WHEN spadl_result = 'success' THEN 1 ELSE 0 END AS label
      FROM v_spadl WHERE spadl_type IN ('shot', 'shot_penalty', 'shot_freekick')) s
""", ("v_spadl",))
def single_class_fallback(md: MatchData) -> DataFrame:
    f = XG.xg_features(spadl(md))
    one = F.countDistinct("label") == 1
    return f.agg(F.when(one, "constant").otherwise("fitted").alias("mode"),
                 F.when(one, F.min("label").cast("double")).alias("constant_value"))


# --------------------------------------------------------------------- VAEP
def scored(md: MatchData) -> DataFrame:
    return md.memo("scored", lambda: VA.scored(spadl(md)))


def vaep_probs(md: MatchData) -> DataFrame:
    return md.memo("vaep_probs", lambda: VA.probabilities_of(scored(md)))


def vaep(md: MatchData) -> DataFrame:
    return md.memo("vaep", lambda: VA.formula(VA.with_probabilities(scored(md))))


@register("game_states", """
SELECT action_id, spadl_type AS spadl_type_a0,
       coalesce(lag(spadl_type, 1) OVER w, first_value(spadl_type) OVER w) AS spadl_type_a1,
       coalesce(lag(spadl_type, 2) OVER w, first_value(spadl_type) OVER w) AS spadl_type_a2,
       round(coalesce(lag(time_seconds, 1) OVER w, first_value(time_seconds) OVER w), 6) AS time_seconds_a1,
       round(coalesce(lag(end_x, 2) OVER w, first_value(end_x) OVER w), 6) AS end_x_a2
FROM v_spadl WINDOW w AS (PARTITION BY match_id, period ORDER BY action_order)
""", ("v_spadl",))
def game_states(md: MatchData) -> DataFrame:
    g = VA.game_states(spadl(md))
    return _rounded(g.select("action_id", "spadl_type_a0", "spadl_type_a1", "spadl_type_a2", "time_seconds_a1",
                             "end_x_a2"), "time_seconds_a1", "end_x_a2")


@register("vaep_features", """
SELECT action_id,
       round(sqrt((105.0 - start_x) * (105.0 - start_x) + (34.0 - start_y) * (34.0 - start_y)), 6) AS start_dist_to_goal_a0,
       round(end_x - start_x, 6) AS dx_a0,
       round(time_seconds - coalesce(lag(time_seconds, 1) OVER w, first_value(time_seconds) OVER w), 6) AS time_delta_1,
       round(coalesce(lag(end_x, 2) OVER w, first_value(end_x) OVER w) - start_x, 6) AS dx_a02
FROM v_spadl WINDOW w AS (PARTITION BY match_id, period ORDER BY action_order)
""", ("v_spadl",))
def vaep_features(md: MatchData) -> DataFrame:
    f, _ = VA.features(spadl(md))
    return _rounded(f.select("action_id", "start_dist_to_goal_a0", "dx_a0", "time_delta_1", "dx_a02"),
                    "start_dist_to_goal_a0", "dx_a0", "time_delta_1", "dx_a02")


GOAL_FLAGS_SQL = """
SELECT *, coalesce(team_id = first_value(team_id) OVER wm, false) AS is_a,
       coalesce(spadl_type LIKE '%shot%' AND spadl_result = 'success', false) AS goal,
       coalesce(spadl_type LIKE '%shot%' AND spadl_result = 'owngoal', false) AS own
FROM v_spadl WINDOW wm AS (PARTITION BY match_id ORDER BY action_order)"""


@register("vaep_goal_score", """
SELECT action_id,
       cast(CASE WHEN is_a THEN sa ELSE sb END AS bigint) AS goalscore_team,
       cast(CASE WHEN is_a THEN sb ELSE sa END AS bigint) AS goalscore_opponent,
       cast(CASE WHEN is_a THEN sa - sb ELSE sb - sa END AS bigint) AS goalscore_diff
FROM (SELECT action_id, is_a,
             coalesce(sum(CASE WHEN (goal AND is_a) OR (own AND NOT is_a) THEN 1 ELSE 0 END)
                      OVER (PARTITION BY match_id ORDER BY action_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sa,
             coalesce(sum(CASE WHEN (goal AND NOT is_a) OR (own AND is_a) THEN 1 ELSE 0 END)
                      OVER (PARTITION BY match_id ORDER BY action_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sb
      FROM flags) s
""", ("v_spadl",), {"flags": GOAL_FLAGS_SQL})
def vaep_goal_score(md: MatchData) -> DataFrame:
    return VA.goal_score(spadl(md)).select("action_id", "goalscore_team", "goalscore_opponent", "goalscore_diff")


LABELS_SQL = """
SELECT a.action_id,
       cast(a.goal OR coalesce(bool_or((b.goal AND coalesce(b.team_id = a.team_id, false))
                                       OR (b.own AND NOT coalesce(b.team_id = a.team_id, false))), false) AS integer) AS scores,
       cast(a.own OR coalesce(bool_or((b.goal AND NOT coalesce(b.team_id = a.team_id, false))
                                      OR (b.own AND coalesce(b.team_id = a.team_id, false))), false) AS integer) AS concedes
FROM flags a LEFT JOIN flags b
  ON b.match_id = a.match_id AND b.action_order > a.action_order AND b.action_order <= a.action_order + 9
GROUP BY a.action_id, a.goal, a.own"""


@register("vaep_labels_scores", "SELECT action_id, scores FROM labels", ("v_spadl",),
          {"flags": GOAL_FLAGS_SQL, "labels": LABELS_SQL})
def vaep_labels_scores(md: MatchData) -> DataFrame:
    return VA.labels(spadl(md)).select("action_id", "scores")


@register("vaep_labels_concedes", "SELECT action_id, concedes FROM labels", ("v_spadl",),
          {"flags": GOAL_FLAGS_SQL, "labels": LABELS_SQL})
def vaep_labels_concedes(md: MatchData) -> DataFrame:
    return VA.labels(spadl(md)).select("action_id", "concedes")


@register("vaep_models")
def vaep_models(md: MatchData) -> DataFrame:
    return _rounded(vaep_probs(md), "p_scores", "p_concedes")


@register("vaep_formula")
def vaep_formula(md: MatchData) -> DataFrame:
    return _rounded(vaep(md), "vaep_offensive", "vaep_defensive", "vaep_value")


# ------------------------------------------------------------ value tables
from ..operators import totals as TT  # noqa: E402
from .golden import top1  # noqa: E402


def rated(md: MatchData) -> DataFrame:
    """Every scored action with its xT value."""
    return md.memo("rated", lambda: XT.with_xt_value(scored(md), _grid_of_scored(md)))


def _grid_of_scored(md: MatchData) -> DataFrame:
    scored(md)
    return xt_grid(md)


def valued(md: MatchData) -> DataFrame:
    """Actions with their xT and VAEP values, and whose they are. A row whose id is
    ``repeated`` stands for one pair of its id's probabilities."""
    return md.memo("valued", lambda: VA.formula(
        VA.with_probabilities(rated(md)), keep=("match_id", "team_id", "player_id", "xt_value", "repeated")))


def action_values(md: MatchData) -> DataFrame:
    """xT and VAEP values by action id; only ids that are null or repeated are joined."""
    def build():
        own = TT.clean_values(valued(md).where("NOT repeated"))
        again = TT.action_values(rated(md).where("repeated"), valued(md).where("repeated").drop("xt_value"))
        return own.unionByName(again)
    return md.memo("action_values", build)


def valued_actions(md: MatchData) -> DataFrame:
    """Actions joined with the values of their id: ``action_id, match_id, team_id,
    player_id`` and the values; only ids that are null or repeated are joined."""
    def build():
        whose = ("match_id", "team_id", "player_id")
        own = TT.clean_values(valued(md).where("NOT repeated"), *whose)
        again = rated(md).where("repeated")
        values = TT.action_values(again, valued(md).where("repeated").drop("xt_value"))
        return own.unionByName(again.select("action_id", *whose).join(values, "action_id", "left"))
    return md.memo("valued_actions", build)


@register("value_tables")
def value_tables(md: MatchData) -> DataFrame:
    return _rounded(action_values(md), "xt_value", "vaep_offensive", "vaep_defensive", "vaep_value")


@register("shot_xg_table")
def shot_xg_table(md: MatchData) -> DataFrame:
    return _rounded(shot_xg(md), "xg")


def player_totals(md: MatchData) -> DataFrame:
    return md.memo("player_totals", lambda: TT.metric_totals(
        valued_actions(md), None, shot_xg(md), md.matches, md.players.select("player_id", "name"),
        "player_id", "player_name"))


def team_totals(md: MatchData) -> DataFrame:
    return md.memo("team_totals", lambda: TT.metric_totals(
        valued_actions(md), None, shot_xg(md), md.matches, md.teams.select("team_id", "name"),
        "team_id", "team_name"))


TOTAL_ROUND = ("total_xt", "total_vaep", "total_vaep_offensive", "total_vaep_defensive", "total_xg")


@register("player_metric_totals")
def player_metric_totals(md: MatchData) -> DataFrame:
    return _rounded(player_totals(md), *TOTAL_ROUND)


@register("team_metric_totals")
def team_metric_totals(md: MatchData) -> DataFrame:
    return _rounded(team_totals(md), *TOTAL_ROUND)


@register("metric_totals_upsert")
def metric_totals_upsert(md: MatchData) -> DataFrame:
    """Replace on (player, competition): applying the same totals twice leaves
    the row count unchanged (the reference's idempotency check)."""
    base = player_totals(md)
    once = TT.upsert(base.limit(0), base, ["player_id", "competition_id"])
    twice = TT.upsert(once, base, ["player_id", "competition_id"])
    return twice.agg(F.count(F.lit(1)).alias("rows_after_second_run"))


XT_TOTALS_SQL = """
SELECT sa.player_id, m.competition_id, m.source, p.name AS player_name,
       round(coalesce(sum(av.xt_value), 0), 6) AS total_xt, count(av.xt_value) AS xt_action_count, count(*) AS action_count
FROM v_spadl sa JOIN v_matches m ON m.match_id = sa.match_id
LEFT JOIN v_xt_values av ON av.action_id = sa.action_id
LEFT JOIN v_players p ON p.player_id = sa.player_id
WHERE sa.player_id IS NOT NULL
GROUP BY sa.player_id, m.competition_id, m.source, p.name
"""


@register("player_xt_totals", XT_TOTALS_SQL, ("v_spadl", "v_matches", "v_xt_values", "v_players"))
def player_xt_totals(md: MatchData) -> DataFrame:
    """The deterministic (model-free) columns of the player totals."""
    t = TT.metric_totals(xt_actions(md), None, shot_xg_empty(md), md.matches,
                         md.players.select("player_id", "name"), "player_id", "player_name")
    return _rounded(t.select("player_id", "competition_id", "source", "player_name", "total_xt",
                             "xt_action_count", "action_count"), "total_xt")


def shot_xg_empty(md: MatchData) -> DataFrame:
    return spadl(md).select("action_id", "match_id", "team_id", "player_id", F.lit(0.0).alias("xg")).limit(0)


# ------------------------------------------------ golden: valued questions
def _wc_join(md: MatchData, df: DataFrame) -> DataFrame:
    return df.join(wc_matches(md).select("match_id"), "match_id", "left_semi")


def _team_names(md: MatchData) -> DataFrame:
    return md.teams.select("team_id", F.col("name").alias("team_name"))


def _player_names(md: MatchData) -> DataFrame:
    return md.players.select("player_id", F.col("name").alias("player_name"))


@register("team_015")
def team_015(md: MatchData) -> DataFrame:
    sx = _wc_join(md, shot_xg(md)).join(_team_names(md), "team_id")
    return top1(sx.groupBy("team_name").agg(F.round(F.sum("xg"), 6).alias("total_xg")), "team_name", "total_xg")


def _valued_actions(md: MatchData, with_vaep: bool) -> DataFrame:
    if not with_vaep:
        return _wc_join(md, xt_actions(md)).select("action_id", "team_id", "player_id", "xt_value")
    return _wc_join(md, valued_actions(md)).where(F.col("action_id").isNotNull()).drop("match_id")


@register("team_016", _first_by("name", "round(sum(xt_value), 6)", """
(SELECT n.name, x.xt_value FROM v_xt_values x JOIN (SELECT action_id, team_id FROM v_spadl SEMI JOIN wc USING (match_id)) a USING (action_id)
 JOIN v_teams n USING (team_id) WHERE x.xt_value IS NOT NULL)""", "team_name", "total_expected_threat"), WC_VIEWS + ("v_spadl", "v_xt_values"))
def team_016(md: MatchData) -> DataFrame:
    v = _valued_actions(md, False).where(F.col("xt_value").isNotNull()).join(_team_names(md), "team_id")
    agg = v.groupBy("team_name").agg(F.round(F.sum("xt_value"), 6).alias("total_expected_threat"))
    return top1(agg, "team_name", "total_expected_threat")


@register("player_022")
def player_022(md: MatchData) -> DataFrame:
    sx = _wc_join(md, shot_xg(md)).join(_player_names(md), "player_id")
    return top1(sx.groupBy("player_name").agg(F.round(F.sum("xg"), 6).alias("total_xg")), "player_name", "total_xg")


@register("player_023", _first_by("name", "round(sum(xt_value), 6)", """
(SELECT n.name, x.xt_value FROM v_xt_values x JOIN (SELECT action_id, player_id FROM v_spadl SEMI JOIN wc USING (match_id)) a USING (action_id)
 JOIN v_players n USING (player_id) WHERE x.xt_value IS NOT NULL)""", "player_name", "total_expected_threat"), WC_VIEWS + ("v_spadl", "v_xt_values", "v_players"))
def player_023(md: MatchData) -> DataFrame:
    v = _valued_actions(md, False).where(F.col("xt_value").isNotNull()).join(_player_names(md), "player_id")
    agg = v.groupBy("player_name").agg(F.round(F.sum("xt_value"), 6).alias("total_expected_threat"))
    return top1(agg, "player_name", "total_expected_threat")


def _vaep_question(col: str, alias: str):
    def plan(md: MatchData) -> DataFrame:
        v = _valued_actions(md, True).where(F.col(col).isNotNull()).join(_player_names(md), "player_id")
        return top1(v.groupBy("player_name").agg(F.round(F.sum(col), 6).alias(alias)), "player_name", alias)
    return plan


register("player_024")(_vaep_question("vaep_value", "total_vaep"))
register("player_025")(_vaep_question("vaep_offensive", "total_offensive_vaep"))
register("player_026")(_vaep_question("vaep_defensive", "total_defensive_vaep"))


def _xg_by_event(md: MatchData, spec: dict, alias: str) -> DataFrame:
    from .golden import predicate
    sx = _wc_join(md, shot_xg(md))
    sa = spadl(md).select("action_id", "source_event_id")
    me = md.events.where(predicate(spec)).select(F.col("event_id").alias("source_event_id"))
    j = sx.join(sa, "action_id").join(me, "source_event_id").join(_player_names(md), "player_id")
    return top1(j.groupBy("player_name").agg(F.round(F.sum("xg"), 6).alias(alias)), "player_name", alias)


@register("shooting_031")
def shooting_031(md: MatchData) -> DataFrame:
    return _xg_by_event(md, {"shot_type": "penalty"}, "penalty_xg")


@register("set_piece_045")
def set_piece_045(md: MatchData) -> DataFrame:
    return _xg_by_event(md, {"play_pattern": "regular_play"}, "regular_play_xg")


@register("shooting_033")
def shooting_033(md: MatchData) -> DataFrame:
    sx = _wc_join(md, shot_xg(md)).join(_player_names(md), "player_id")
    agg = (sx.groupBy("player_name").agg(F.round(F.avg("xg"), 6).alias("average_xg_per_shot"),
                                         F.count(F.lit(1)).alias("n"))
           .where(F.col("n") >= 5).drop("n"))
    return top1(agg, "player_name", "average_xg_per_shot")


def light_totals(md: MatchData, kind: str) -> DataFrame:
    """Totals whose columns do not depend on fitted models: xT sums, shot and
    action counts (xg/VAEP columns are zero). Used by the fixed queries that
    rank on those columns, so their SQL twins can recompute them."""
    shots = F.col("spadl_type").isin(*S.SHOT_TYPES)
    names = md.players.select("player_id", "name") if kind == "player" else md.teams.select("team_id", "name")
    key = f"{kind}_id"
    return md.memo(f"light_totals_{kind}", lambda: TT.metric_totals(
        xt_actions(md), None, shots, md.matches, names, key, f"{kind}_name"))
