"""Expected goals: shot geometry, features and the logistic model."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .models import fit_predict
from .spadl import FIELD_LENGTH, FIELD_WIDTH, SHOT_TYPES

GOAL_WIDTH = 7.32  # metres between the posts
FEATURES = ["distance", "angle", "is_head", "is_left_foot", "is_right_foot",
            "is_other_body_part", "is_penalty", "is_free_kick"]


def shot_distance(x: Column, y: Column) -> Column:
    """distance to the goal centre (105, 34)."""
    dx = F.lit(FIELD_LENGTH) - x
    dy = F.lit(FIELD_WIDTH / 2.0) - y
    return F.sqrt(dx * dx + dy * dy)


def shot_angle(x: Column, y: Column) -> Column:
    """angle subtended by the posts (law of cosines); a zero denominator
    gives cosine 1; the cosine is clipped to [-1, 1]."""
    dx = F.lit(FIELD_LENGTH) - x
    left = F.lit(FIELD_WIDTH / 2.0 - GOAL_WIDTH / 2.0) - y
    right = F.lit(FIELD_WIDTH / 2.0 + GOAL_WIDTH / 2.0) - y
    dl = F.sqrt(dx * dx + left * left)
    dr = F.sqrt(dx * dx + right * right)
    den = 2.0 * dl * dr
    cosine = F.when(den != 0.0, (dl * dl + dr * dr - GOAL_WIDTH ** 2) / den).otherwise(1.0)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def xg_features(actions: DataFrame) -> DataFrame:
    """the eight model inputs for shot actions (+ ids and label)."""
    shots = actions.where(F.col("spadl_type").isin(*SHOT_TYPES))
    b, t = F.col("spadl_bodypart"), F.col("spadl_type")
    flag = lambda c: F.when(c, 1).otherwise(0)
    return shots.select(
        "action_id", "match_id", "team_id", "player_id",
        shot_distance(F.col("start_x"), F.col("start_y")).alias("distance"),
        shot_angle(F.col("start_x"), F.col("start_y")).alias("angle"),
        flag(b == "head").alias("is_head"),
        flag(b == "foot_left").alias("is_left_foot"),
        flag(b == "foot_right").alias("is_right_foot"),
        flag(b == "other").alias("is_other_body_part"),
        flag(t == "shot_penalty").alias("is_penalty"),
        flag(t == "shot_freekick").alias("is_free_kick"),
        flag(F.col("spadl_result") == "success").alias("label"),
    )


def shot_xg(actions: DataFrame) -> DataFrame:
    """F3 + F4: P(goal) per shot, fitted on the shots themselves."""
    return fit_predict(xg_features(actions), FEATURES, "label", "xg", ["action_id", "match_id", "team_id", "player_id"])


__all__ = ["shot_distance", "shot_angle", "xg_features", "shot_xg", "FEATURES", "math"]
