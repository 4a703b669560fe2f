"""VAEP: game states, features, labels, two models and the value formula.

Every window is keyed by match (and period for game states), so the whole
feature build is one shuffle of the actions by ``match_id``; the windows are
ordered by ``action_order`` and bounded (2 rows back, 9 rows ahead), so a
popular match costs a sort of that match only. Running goal scores use a
frame that ends one row before the current one.

Deliberate deviation (documented): the reference computes the running goal
score over all matches concatenated; here it restarts per match, as the
labels and formula already do.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .models import fit_predict_all
from .spadl import ACTION_TYPES, FIELD_LENGTH, FIELD_WIDTH, RESULTS, SHOT_TYPES

NB_PREV_ACTIONS = 3
LOOK_AHEAD = 10
SAME_PHASE_SECONDS = 10
# fixed values of the formula's set-piece priors
PENALTY_PRIOR = 0.792453
CORNER_PRIOR = 0.0465
PERIOD_START_MINUTE = {1: 0, 2: 45, 3: 90, 4: 105, 5: 120}
# columns that stay with an action through the fit
CARRIED = ("team_id", "player_id", "spadl_type", "spadl_result", "spadl_bodypart", "time_seconds",
           "start_x", "start_y", "end_x", "end_y")
STATE_COLS = ("spadl_type", "spadl_result", "spadl_bodypart", "period", "time_seconds",
              "start_x", "start_y", "end_x", "end_y", "team_id")


def _by_match():
    return Window.partitionBy("match_id").orderBy("action_order")


def _by_period():
    return Window.partitionBy("match_id", "period").orderBy("action_order")


def game_states(actions: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """G1: columns ``<c>_a0`` (current) and ``<c>_a1``, ``<c>_a2`` (earlier
    actions of the same match and period; a missing one is the period's first).
    The columns ``keep`` of ``actions`` stay as they are."""
    w = _by_period()
    cols = [F.col(c).alias(f"{c}_a0") for c in STATE_COLS]
    for i in range(1, NB_PREV_ACTIONS):
        cols += [F.coalesce(F.lag(c, i).over(w), F.first(c).over(w)).alias(f"{c}_a{i}") for c in STATE_COLS]
    return actions.select("action_id", "match_id", "action_order", *keep, *cols)


def _is_goal(t: Column, r: Column) -> Column:
    return F.coalesce(t.contains("shot") & (r == "success"), F.lit(False))


def _is_own_goal(t: Column, r: Column) -> Column:
    return F.coalesce(t.contains("shot") & (r == "owngoal"), F.lit(False))


def with_goal_score(df: DataFrame, type_col: str = "spadl_type", result_col: str = "spadl_result",
                    team_col: str = "team_id") -> DataFrame:
    """Add goalscore_team / _opponent / _diff (goals before this action, same
    match) to ``df`` with windows over the match: no join, no extra shuffle
    when ``df`` is already partitioned by match."""
    w = _by_match()
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    t, r, team = F.col(type_col), F.col(result_col), F.col(team_col)
    goal, own = _is_goal(t, r), _is_own_goal(t, r)
    df = df.withColumn("__is_a", F.coalesce(team == F.first(team_col).over(w), F.lit(False)))
    is_a = F.col("__is_a")
    df = (df.withColumn("__ga", ((goal & is_a) | (own & ~is_a)).cast("int"))
          .withColumn("__gb", ((goal & ~is_a) | (own & is_a)).cast("int")))
    score_a = F.coalesce(F.sum("__ga").over(before), F.lit(0))
    score_b = F.coalesce(F.sum("__gb").over(before), F.lit(0))
    df = (df.withColumn("goalscore_team", F.when(is_a, score_a).otherwise(score_b))
          .withColumn("goalscore_opponent", F.when(is_a, score_b).otherwise(score_a)))
    return df.withColumn("goalscore_diff", F.col("goalscore_team") - F.col("goalscore_opponent")).drop(
        "__is_a", "__ga", "__gb")


def goal_score(actions: DataFrame) -> DataFrame:
    """Goals of the acting team / opponent before this action (same match)."""
    return with_goal_score(actions).select("action_id", "match_id", "action_order", "goalscore_team",
                                           "goalscore_opponent", "goalscore_diff")


def with_labels(df: DataFrame, type_col: str = "spadl_type", result_col: str = "spadl_result",
                team_col: str = "team_id") -> DataFrame:
    """Add scores / concedes: does the acting team score / concede within this
    and the next nine actions of the match (an opponent own goal counts as
    scoring). The look-ahead is a bounded frame of nine rows, of which only the
    goals are collected: a null is left out, so most rows collect nothing."""
    w = _by_match().rowsBetween(1, LOOK_AHEAD - 1)
    t, r, team = F.col(type_col), F.col(result_col), F.col(team_col)
    goal, own = _is_goal(t, r), _is_own_goal(t, r)
    ahead = F.collect_list(F.when(goal | own, F.struct(team.alias("team"), goal.alias("goal"), own.alias("own")))).over(w)

    def same(x):
        return F.coalesce(x["team"] == team, F.lit(False))

    scores = _is_goal(t, r) | F.exists(ahead, lambda x: (x["goal"] & same(x)) | (x["own"] & ~same(x)))
    concedes = _is_own_goal(t, r) | F.exists(ahead, lambda x: (x["goal"] & ~same(x)) | (x["own"] & same(x)))
    return df.withColumn("scores", scores.cast("int")).withColumn("concedes", concedes.cast("int"))


def labels(actions: DataFrame) -> DataFrame:
    """G4 + G5 (see ``with_labels``)."""
    return with_labels(actions).select("action_id", "match_id", "action_order", "scores", "concedes")


def _index_of(values: tuple[str, ...], c: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(v) for v in values]), c) - 1).cast("double")


def _polar(x: Column, y: Column, prefix: str) -> list[Column]:
    dx = F.abs(F.lit(FIELD_LENGTH) - x)
    dy = F.abs(F.lit(FIELD_WIDTH / 2.0) - y)
    angle = F.when(dx != 0, F.atan(dy / dx)).when(dy != 0, F.lit(3.141592653589793 / 2)).otherwise(0.0)
    return [F.sqrt(dx * dx + dy * dy).alias(f"{prefix}_dist_to_goal"), angle.alias(f"{prefix}_angle_to_goal")]


def states(actions: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Game states with the running goal score and the labels: all a feature
    row is made of, in one shuffle by match (the (match, period) game-state
    windows, the goal score and the look-ahead labels are satisfied by it)."""
    gs = game_states(actions.repartition("match_id"), keep)
    return with_labels(with_goal_score(gs, "spadl_type_a0", "spadl_result_a0", "team_id_a0"),
                       "spadl_type_a0", "spadl_result_a0", "team_id_a0")


def feature_table(gs: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, list[str], list[str]]:
    """Feature table of game states, its numeric inputs and its index columns.
    The columns ``keep`` of ``gs`` stay as they are and are no inputs."""
    cols: list[Column] = [F.col("action_id"), F.col("match_id"), F.col("action_order"), *map(F.col, keep)]
    numeric: list[str] = []
    index_cols: list[str] = []
    period_start = F.create_map(*[x for k, v in PERIOD_START_MINUTE.items() for x in (F.lit(k), F.lit(v))])
    for i in range(NB_PREV_ACTIONS):
        s = lambda c: F.col(f"{c}_a{i}")
        t, r, b = s("spadl_type"), s("spadl_result"), s("spadl_bodypart")
        type_ix, res_ix = _index_of(ACTION_TYPES, t), _index_of(RESULTS, r)
        cols += [type_ix.alias(f"type_ix_a{i}"), res_ix.alias(f"result_ix_a{i}"),
                 (type_ix * len(RESULTS) + res_ix).alias(f"type_result_ix_a{i}")]
        index_cols += [f"type_ix_a{i}", f"result_ix_a{i}", f"type_result_ix_a{i}"]
        named = [
            (b.isin("foot", "foot_left", "foot_right")).cast("int").alias(f"bodypart_foot_a{i}"),
            (b == "head").cast("int").alias(f"bodypart_head_a{i}"),
            (b == "other").cast("int").alias(f"bodypart_other_a{i}"),
            (b.isin("head", "other", "head/other")).cast("int").alias(f"bodypart_head_other_a{i}"),
            s("period").alias(f"period_id_a{i}"),
            s("time_seconds").alias(f"time_seconds_a{i}"),
            (F.element_at(period_start, s("period")) * 60 + s("time_seconds")).alias(f"time_seconds_overall_a{i}"),
            s("start_x").alias(f"start_x_a{i}"), s("start_y").alias(f"start_y_a{i}"),
            s("end_x").alias(f"end_x_a{i}"), s("end_y").alias(f"end_y_a{i}"),
        ]
        sp = _polar(s("start_x"), s("start_y"), "start")
        ep = _polar(s("end_x"), s("end_y"), "end")
        named += [c.alias(n + f"_a{i}") for c, n in zip(sp, ("start_dist_to_goal", "start_angle_to_goal"))]
        named += [c.alias(n + f"_a{i}") for c, n in zip(ep, ("end_dist_to_goal", "end_angle_to_goal"))]
        mdx, mdy = s("end_x") - s("start_x"), s("end_y") - s("start_y")
        named += [mdx.alias(f"dx_a{i}"), mdy.alias(f"dy_a{i}"), F.sqrt(mdx * mdx + mdy * mdy).alias(f"movement_a{i}")]
        cols += named
    for i in range(1, NB_PREV_ACTIONS):
        cols.append((F.col("time_seconds_a0") - F.col(f"time_seconds_a{i}")).alias(f"time_delta_{i}"))
        dx = F.col(f"end_x_a{i}") - F.col("start_x_a0")
        dy = F.col(f"end_y_a{i}") - F.col("start_y_a0")
        cols += [dx.alias(f"dx_a0{i}"), dy.alias(f"dy_a0{i}"), F.sqrt(dx * dx + dy * dy).alias(f"mov_a0{i}")]
    extra = ["goalscore_team", "goalscore_opponent", "goalscore_diff", "scores", "concedes"]
    table = gs.select(*cols, *extra)
    not_inputs = {"action_id", "match_id", "action_order", "scores", "concedes", *keep, *index_cols}
    numeric = [c for c in table.columns if c not in not_inputs]
    return table, numeric, index_cols


def features(actions: DataFrame) -> tuple[DataFrame, list[str]]:
    """Feature table and the list of model input columns."""
    table, numeric, index_cols = feature_table(states(actions))
    encoder = OneHotEncoder(inputCols=index_cols, outputCols=[c + "_vec" for c in index_cols], dropLast=False,
                            handleInvalid="keep")
    encoded = encoder.fit(table).transform(table)
    return encoded, numeric + [c + "_vec" for c in index_cols]


def one_hot_inputs() -> np.ndarray:
    """0/1 inputs of every (type, result) index: its type, its result and the pair."""
    n, m = len(ACTION_TYPES), len(RESULTS)
    return np.concatenate([np.repeat(np.eye(n), m, 0), np.tile(np.eye(m), (n, 1)), np.eye(n * m)], 1)


def scored(actions: DataFrame) -> DataFrame:
    """Every action (the columns in CARRIED) with its own P(scores) and
    P(concedes) from the two fitted models, written once.

    Both fits share their passes. The one-hot inputs stay indexes: the pair's
    index names its type and its result. ``repeated`` says that the action's id
    is null or may be another row's too: such rows meet by their id
    (:func:`with_probabilities`), all others have what belongs to them."""
    spark = actions.sparkSession
    carried = tuple(c for c in CARRIED if c in actions.columns)
    table, numeric, _ = feature_table(states(actions, carried), carried)
    codes = {f"type_result_ix_a{i}": one_hot_inputs() for i in range(NB_PREV_ACTIONS)}
    probs = fit_predict_all(table, numeric, {"scores": "p_scores", "concedes": "p_concedes"},
                            ["action_id", "match_id", "action_order", *carried], codes)
    path = scratch_path(spark, f"scored-{uuid.uuid4().hex}")
    probs.write.parquet(f"{path}/actions")
    rows = spark.read.schema(probs.schema).parquet(f"{path}/actions")
    # ids by their hash: one that two ids share only sends these rows the longer way
    found = rows.groupBy(F.xxhash64("action_id").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.count("action_id").alias("known"))
    found.where("n > 1 OR known < n").select("h").write.parquet(f"{path}/repeated")
    repeated = spark.read.schema("h long").parquet(f"{path}/repeated")
    if repeated.isEmpty():
        return rows.withColumn("repeated", F.lit(False))
    marked = rows.withColumn("h", F.xxhash64("action_id")).join(repeated.withColumn("repeated", F.lit(True)), "h", "left")
    return marked.withColumn("repeated", F.coalesce("repeated", F.lit(False))).drop("h")


def probabilities(actions: DataFrame) -> DataFrame:
    """P(scores), P(concedes) per action from the two fitted models."""
    return probabilities_of(scored(actions))


def probabilities_of(rows: DataFrame) -> DataFrame:
    """``action_id, p_scores, p_concedes`` of :func:`scored` rows: the two models'
    columns joined on the id, for ids of one row without a join."""
    columns = ["action_id", "p_scores", "p_concedes"]
    again = rows.where("repeated")
    both = again.select("action_id", "p_scores").join(again.select("action_id", "p_concedes"), "action_id")
    return rows.where("NOT repeated").select(*columns).unionByName(both)


def with_probabilities(rows: DataFrame) -> DataFrame:
    """:func:`scored` rows joined with the probabilities of their id (see
    :func:`probabilities_of`): what :func:`formula` takes."""
    again = rows.where("repeated")
    both = again.drop("p_scores", "p_concedes").join(probabilities_of(again), "action_id")
    return rows.where("NOT repeated").unionByName(both)


def formula(actions: DataFrame, probs: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Offensive / defensive / total value from P(scores), P(concedes).

    With ``probs`` None the probabilities are on ``actions`` already, which saves
    the join on action id. The columns ``keep`` of ``actions`` stay."""
    w = _by_match()
    own = ("action_id", "match_id", "action_order", "team_id", "spadl_type", "spadl_result", "time_seconds")
    held = [*own, *(c for c in keep if c not in own)]
    a = (actions.select(*held, "p_scores", "p_concedes") if probs is None
         else actions.select(*held).join(probs, "action_id"))

    def prev(c):
        """Previous action of the match; the first action is its own previous."""
        return F.when(F.row_number().over(w) == 1, F.col(c)).otherwise(F.lag(c, 1).over(w))

    same_team = F.coalesce(prev("team_id") == F.col("team_id"), F.lit(False))
    too_long = F.abs(F.col("time_seconds") - prev("time_seconds")) > SAME_PHASE_SECONDS
    prev_goal = prev("spadl_type").isin(*SHOT_TYPES) & (prev("spadl_result") == "success")
    reset = F.coalesce(too_long, F.lit(False)) | F.coalesce(prev_goal, F.lit(False))
    prev_scores = F.when(same_team, prev("p_scores")).otherwise(prev("p_concedes"))
    prev_scores = F.when(reset, 0.0).otherwise(prev_scores)
    prev_scores = (F.when(F.col("spadl_type") == "shot_penalty", PENALTY_PRIOR)
                   .when(F.col("spadl_type").isin("corner_crossed", "corner_short"), CORNER_PRIOR)
                   .otherwise(prev_scores))
    prev_concedes = F.when(same_team, prev("p_concedes")).otherwise(prev("p_scores"))
    prev_concedes = F.when(reset, 0.0).otherwise(prev_concedes)
    out = a.select(
        "action_id", *keep,
        (F.col("p_scores") - prev_scores).alias("vaep_offensive"),
        (-(F.col("p_concedes") - prev_concedes)).alias("vaep_defensive"),
    )
    return out.withColumn("vaep_value", F.col("vaep_offensive") + F.col("vaep_defensive"))


def vaep_values(actions: DataFrame) -> DataFrame:
    return formula(with_probabilities(scored(actions)))
