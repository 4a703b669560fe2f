"""Goals, possession chains and goal build-ups, for all goals at once.

The reference scans, per goal, every earlier event of the match with a running
"possession changed" counter. The same chain is the run of consecutive events
(in sequence order) whose possession team is not distinct from the goal's, so
here a window over the match numbers possession runs once, and each goal is
joined to the events of its own run (equi join on match and run id plus
``sequence <=``). Work is bounded by run length, not by match length times
goal count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GOAL_LIMIT = 120
CHAIN_LIMIT = 300
FREEZE_LIMIT = 60
TIMELINE_STEPS = 18


def goal_shots(events: DataFrame) -> DataFrame:
    return events.where((F.col("type") == "Shot") & (F.col("outcome") == "Goal")
                        & F.col("location_x").isNotNull() & F.col("location_y").isNotNull())


def list_goals(events: DataFrame, matches: DataFrame, teams: DataFrame, players: DataFrame,
               final_stage: str, limit: int = GOAL_LIMIT, group: str | None = None) -> DataFrame:
    """K1: goal list with CASE ordering (final open-play goals first). With
    ``group`` set (a column of ``matches``), the first ``limit`` of each group."""
    g = goal_shots(events).where(F.col("period") <= 4)
    ht = teams.select(F.col("team_id").alias("home_team_id"), F.col("name").alias("home_team_name"))
    at = teams.select(F.col("team_id").alias("away_team_id"), F.col("name").alias("away_team_name"))
    own = [group] if group else []
    m = matches.select("match_id", "home_team_id", "away_team_id", "stage", "match_date", *own)
    p = players.select("player_id", "display_name")
    j = g.drop(*own).join(m, "match_id").join(ht, "home_team_id").join(at, "away_team_id").join(p, "player_id", "left")
    final = F.col("stage") == final_stage
    found = j.select(*own, "event_id", "match_id", "period", "minute", "second",
                     F.coalesce("display_name", "player_name").alias("scorer"), "team_name",
                     "home_team_name", "away_team_name", "stage", "shot_type", "play_pattern", "match_date")
    order = (F.when(final & (F.col("shot_type") == "open_play"), 0).otherwise(1),
             F.when(final, 0).otherwise(1), F.desc("match_date"), "minute", "second", "event_id")
    if group:
        w = Window.partitionBy(group).orderBy(*order)
        return found.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= limit).drop("match_date", "__rn")
    return found.orderBy(*order).limit(limit).drop("match_date")


def possession_runs(events: DataFrame) -> DataFrame:
    """Number runs of equal (null-safe) possession team within each match."""
    w = Window.partitionBy("match_id").orderBy("sequence")
    changed = ~F.col("possession_team_id").eqNullSafe(F.lag("possession_team_id").over(w))
    first = F.row_number().over(w) == 1
    flagged = events.withColumn("__chg", F.when(first | changed, 1).otherwise(0))
    return flagged.withColumn("run_id", F.sum("__chg").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__chg")


def possession_break(events: DataFrame, goals: DataFrame) -> DataFrame:
    """K2: for every goal, each event of its match up to the goal with the
    running count (from the goal backwards) of events whose possession team
    is distinct from the goal's. Equi join on match + ``sequence <=``."""
    g = goals.select(F.col("event_id").alias("goal_id"), "match_id", F.col("sequence").alias("goal_sequence"),
                     F.col("possession_team_id").alias("goal_possession"))
    j = events.join(g, "match_id").where(F.col("sequence") <= F.col("goal_sequence"))
    w = (Window.partitionBy("goal_id").orderBy(F.desc("sequence"))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    brk = F.sum(F.when(~F.col("possession_team_id").eqNullSafe(F.col("goal_possession")), 1).otherwise(0)).over(w)
    return j.select("goal_id", "event_id", "sequence", brk.alias("possession_break"))


def goal_chain(events: DataFrame, goals: DataFrame) -> DataFrame:
    """The break-0 events of each goal: equi join on (match, run)."""
    runs = possession_runs(events)
    g = runs.join(goals.select("event_id"), "event_id", "left_semi").select(
        F.col("event_id").alias("goal_id"), "match_id", "run_id",
        F.col("sequence").alias("goal_sequence"), F.col("team_id").alias("goal_team_id"))
    return runs.join(g, ["match_id", "run_id"]).where(F.col("sequence") <= F.col("goal_sequence"))


def goal_buildup(events: DataFrame, goals: DataFrame, limit: int = CHAIN_LIMIT) -> DataFrame:
    """K3: own-team located events of the chain, earliest ``limit`` by sequence,
    the goal flagged, path count per goal."""
    c = goal_chain(events, goals).where(
        F.col("team_id").eqNullSafe(F.col("goal_team_id")) & F.col("location_x").isNotNull() & F.col("location_y").isNotNull())
    w = Window.partitionBy("goal_id").orderBy("sequence")
    kept = c.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= limit).drop("__rn")
    return kept.select("goal_id", "event_id", "sequence", "period", "minute", "second", "type", "player_name",
                       "team_name", "location_x", "location_y", "end_location_x", "end_location_y",
                       (F.col("event_id") == F.col("goal_id")).alias("is_goal"),
                       F.count(F.lit(1)).over(Window.partitionBy("goal_id")).alias("path_event_count"))


def buildup_xt(buildup: DataFrame, xt_values: DataFrame) -> DataFrame:
    """K4: xT gained along each chain (null when every value is null)."""
    v = xt_values.select(F.col("action_id").alias("event_id"), "xt_value")
    return buildup.join(v, "event_id", "left").groupBy("goal_id").agg(F.sum("xt_value").alias("xt_gained"))


def goal_freeze_frame(goals: DataFrame, frames: DataFrame, limit: int = FREEZE_LIMIT) -> DataFrame:
    """K5: players at the shot, by frame index, capped per goal."""
    f = frames.join(goals.select("event_id"), "event_id", "left_semi")
    w = Window.partitionBy("event_id").orderBy("frame_index")
    return f.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= limit).drop("__rn")


def goal_timeline(buildup: DataFrame, goals: DataFrame) -> DataFrame:
    """K6: ``TIMELINE_STEPS`` frames from each chain point towards the next (at
    t = step / steps), then the last point itself. The chain ends at the
    shot's end when that is known; a single point is one frame. ``frame`` runs
    through the goal."""
    w = Window.partitionBy("goal_id").orderBy("sequence")
    end = goals.select(F.col("event_id").alias("goal_id"), F.col("end_location_x").alias("gx"),
                       F.col("end_location_y").alias("gy"))
    pts = buildup.select("goal_id", "sequence", "location_x", "location_y").join(end, "goal_id", "left")
    pts = pts.select(
        "goal_id", "sequence", F.col("location_x").alias("x0"), F.col("location_y").alias("y0"),
        F.lead("location_x").over(w).alias("nx"), F.lead("location_y").over(w).alias("ny"),
        (F.row_number().over(w) - 1).alias("segment"), "gx", "gy")
    is_last = F.col("nx").isNull()
    x1 = F.when(is_last, F.coalesce("gx", "x0")).otherwise(F.col("nx"))
    y1 = F.when(is_last, F.coalesce("gy", "y0")).otherwise(F.col("ny"))
    # the last row closes the timeline: at its own point, or at the shot's end
    final_step = F.when(~is_last, TIMELINE_STEPS - 1).when(F.col("gx").isNull(), 0).otherwise(TIMELINE_STEPS)
    steps = pts.select("goal_id", "sequence", "segment", "x0", "y0", x1.alias("x1"), y1.alias("y1"),
                       F.explode(F.sequence(F.lit(0), final_step)).alias("step"))
    t = F.col("step") / float(TIMELINE_STEPS)
    return steps.select("goal_id", "sequence", "step", (F.col("segment") * TIMELINE_STEPS + F.col("step")).alias("frame"),
                        (F.col("x0") + (F.col("x1") - F.col("x0")) * t).alias("x"),
                        (F.col("y0") + (F.col("y1") - F.col("y0")) * t).alias("y"))
