"""Neutral events -> SPADL actions (one action per located event).

Plan shape: events are joined to their match (for the home team) and then
numbered per match with one window; join and window share the ``match_id``
hash partitioning, so the conversion costs one shuffle of the events.
All label rules are literal-map lookups and CASE chains (codegen, no UDF).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import lookup, spadl_label

# ------------------------------------------------------------ fixed values
# SPADL vocabularies (published definition), in their id order.
ACTION_TYPES = (
    "pass", "cross", "throw_in", "freekick_crossed", "freekick_short", "corner_crossed",
    "corner_short", "take_on", "foul", "tackle", "interception", "shot", "shot_penalty",
    "shot_freekick", "keeper_save", "keeper_claim", "keeper_punch", "keeper_pick_up",
    "clearance", "bad_touch", "non_action", "dribble", "goalkick",
)
RESULTS = ("fail", "success", "offside", "owngoal", "yellow_card", "red_card")
BODYPARTS = ("foot", "head", "other", "head/other", "foot_left", "foot_right")

# Neutral event label (normalised) -> SPADL type; anything else is non_action.
TYPE_MAPPING = {
    "pass": "pass",
    "cross": "cross",
    "carry": "dribble",
    "shot": "shot",
    "dribble": "take_on",
    "duel": "tackle",
    "interception": "interception",
    "clearance": "clearance",
    "goal keeper": "keeper_save",
    "miscontrol": "bad_touch",
    "dispossessed": "bad_touch",
    "foul committed": "foul",
    "foul won": "non_action",
    "ball receipt": "non_action",
    "pressure": "non_action",
    "block": "non_action",
    "50/50": "non_action",
    "starting xi": "non_action",
    "half start": "non_action",
    "half end": "non_action",
    "substitution": "non_action",
    "tactical shift": "non_action",
    "injury stoppage": "non_action",
    "bad behaviour": "non_action",
    "player on": "non_action",
    "player off": "non_action",
    "shield": "non_action",
    "error": "non_action",
}
MOVE_TYPES = ("pass", "cross", "dribble")
SUCCESS_DEFAULT_TYPES = MOVE_TYPES + (
    "throw_in", "freekick_crossed", "freekick_short", "corner_crossed", "corner_short",
    "goalkick", "interception", "clearance",
)
SHOT_TYPES = ("shot", "shot_penalty", "shot_freekick")
FAIL_OUTCOMES = ("blocked", "claim", "fail", "incomplete", "lost", "no touch", "out",
                 "pass offside", "saved", "saved to post", "wayward")
SUCCESS_OUTCOMES = ("complete", "goal", "success", "success in play", "success out", "won")
OFFSIDE_OUTCOMES = ("offside", "pass offside")
OWN_GOAL_OUTCOMES = ("own goal",)
YELLOW_CARD_OUTCOMES = ("yellow card", "second yellow")
RED_CARD_OUTCOMES = ("red card",)
SOURCE_LENGTH, SOURCE_WIDTH = 120.0, 80.0
FIELD_LENGTH, FIELD_WIDTH = 105.0, 68.0


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


# D2
def action_type(t: Column, pt: Column, st: Column, is_cross: Column) -> Column:
    """From the normalised labels of the type, the pass type and the shot type."""
    crossed = F.coalesce(is_cross, F.lit(False))
    pass_kind = (F.when(pt == "corner", F.when(crossed, "corner_crossed").otherwise("corner_short"))
                 .when(pt == "free_kick", F.when(crossed, "freekick_crossed").otherwise("freekick_short"))
                 .when(pt == "throw_in", "throw_in")
                 .when(pt == "goal_kick", "goalkick")
                 .when(crossed, "cross")
                 .otherwise("pass"))
    shot_kind = F.when(st == "penalty", "shot_penalty").when(st == "free_kick", "shot_freekick").otherwise("shot")
    return (F.when(t == "pass", pass_kind).when(t == "shot", shot_kind)
            .otherwise(F.coalesce(lookup(TYPE_MAPPING, t), F.lit("non_action"))))


# D3
def bodypart(b: Column) -> Column:
    """From the normalised label of the body part."""
    return (F.when(b == "left_foot", "foot_left").when(b == "right_foot", "foot_right")
            .when(b == "head", "head").when(b.isin("other", "keeper_hands"), "other").otherwise("foot"))


# D4
def result(o: Column, spadl_type: Column) -> Column:
    """From the normalised label of the outcome."""
    return (F.when(o.isin(*OFFSIDE_OUTCOMES), "offside")
            .when(o.isin(*OWN_GOAL_OUTCOMES), "owngoal")
            .when(o.isin(*YELLOW_CARD_OUTCOMES), "yellow_card")
            .when(o.isin(*RED_CARD_OUTCOMES), "red_card")
            .when(o.isin(*FAIL_OUTCOMES), "fail")
            .when(o.isin(*SUCCESS_OUTCOMES), "success")
            .when(spadl_type.isin(*SUCCESS_DEFAULT_TYPES), "success")
            .when(spadl_type.isin(*SHOT_TYPES), "fail")
            .otherwise("success"))


# D5
def to_spadl_x(x: Column) -> Column:
    return clamp(clamp(x, 0.0, SOURCE_LENGTH) / SOURCE_LENGTH * FIELD_LENGTH, 0.0, FIELD_LENGTH)


def to_spadl_y(y: Column) -> Column:
    return clamp((SOURCE_WIDTH - clamp(y, 0.0, SOURCE_WIDTH)) / SOURCE_WIDTH * FIELD_WIDTH, 0.0, FIELD_WIDTH)


def spadl_actions(events: DataFrame, matches: DataFrame, mirror_away: bool = True) -> DataFrame:
    """Neutral events (+ their match's home team) -> SPADL action rows.

    Output columns follow the stored table: action_id (= source event id),
    match_id, action_order, source_event_id, period, time_seconds, team_id,
    player_id, start/end x,y, spadl_type, spadl_result, spadl_bodypart.
    """
    ev = events.where(F.col("location_x").isNotNull() & F.col("location_y").isNotNull())
    home = matches.select("match_id", "home_team_id")
    ev = ev.join(home, "match_id")
    sx, sy = to_spadl_x(F.col("location_x")), to_spadl_y(F.col("location_y"))
    has_end = F.col("end_location_x").isNotNull() & F.col("end_location_y").isNotNull()
    ex = F.when(has_end, to_spadl_x(F.col("end_location_x"))).otherwise(sx)
    ey = F.when(has_end, to_spadl_y(F.col("end_location_y"))).otherwise(sy)
    # a label is normalised once a row: its column is read by many branches
    labelled = ("type", "pass_type", "shot_type", "outcome", "body_part")
    ev = ev.select(*[spadl_label(F.col(c)).alias(c) if c in labelled else F.col(c) for c in ev.columns])
    stype = action_type(F.col("type"), F.col("pass_type"), F.col("shot_type"), F.col("is_cross"))
    staged = ev.select(
        "match_id", "event_id", "period", "sequence", "team_id", "player_id", "home_team_id",
        (F.col("minute").cast("double") * 60.0 + F.col("second").cast("double")).alias("time_seconds"),
        sx.alias("sx"), sy.alias("sy"), ex.alias("ex"), ey.alias("ey"),
        stype.alias("spadl_type"),
        F.col("outcome"), F.col("body_part"),
    ).select("*", result(F.col("outcome"), F.col("spadl_type")).alias("spadl_result"),
             bodypart(F.col("body_part")).alias("spadl_bodypart"))
    # play_left_to_right: rows not of the home team are mirrored (null team too)
    away = ~F.col("team_id").eqNullSafe(F.col("home_team_id")) if mirror_away else F.lit(False)
    order = Window.partitionBy("match_id").orderBy("period", "sequence")
    return staged.select(
        F.col("event_id").alias("action_id"),
        "match_id",
        (F.row_number().over(order) - 1).cast("int").alias("action_order"),
        F.col("event_id").alias("source_event_id"),
        F.col("period").cast("int").alias("period"),
        "time_seconds", "team_id", "player_id",
        F.when(away, FIELD_LENGTH - F.col("sx")).otherwise(F.col("sx")).alias("start_x"),
        F.when(away, FIELD_WIDTH - F.col("sy")).otherwise(F.col("sy")).alias("start_y"),
        F.when(away, FIELD_LENGTH - F.col("ex")).otherwise(F.col("ex")).alias("end_x"),
        F.when(away, FIELD_WIDTH - F.col("ey")).otherwise(F.col("ey")).alias("end_y"),
        "spadl_type", "spadl_result", "spadl_bodypart",
    )


def type_id(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in ACTION_TYPES]), c).cast("int") - 1


def result_id(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in RESULTS]), c).cast("int") - 1
