"""Expected threat (xT) on a 12 x 8 grid, fitted on SPADL actions.

Counting is a distributed aggregation over all actions (partial aggregation
map-side, one small shuffle keyed by cell). What reaches the driver is the
count table, whose size is set by the grid (at most 96 cell rows and
96 x 96 transition rows), never by the data; the value iteration runs on that
bounded table and the 96-value grid is broadcast back for rating.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .spadl import FIELD_LENGTH, FIELD_WIDTH, MOVE_TYPES

# published grid shape and stopping rule
L_CELLS, W_CELLS = 12, 8
EPS = 1e-5
N_CELLS = L_CELLS * W_CELLS


def cell_index(v: Column, size: float, cells: int) -> Column:
    """floor(v / size * cells) clipped into [0, cells - 1]."""
    return F.least(F.greatest(F.floor(v / size * cells), F.lit(0)), F.lit(cells - 1)).cast("int")


def cell(x: Column, y: Column) -> Column:
    return cell_index(y, FIELD_WIDTH, W_CELLS) * L_CELLS + cell_index(x, FIELD_LENGTH, L_CELLS)


def cell_pairs(actions: DataFrame) -> DataFrame:
    """Shots and moves counted by (kind, start cell, end cell, success): one
    pass, at most 96 x 96 x 2 + 96 x 2 rows. A shot's end cell is its start.
    Other actions count as 0 and go after the sums: a filter before them would
    be moved to the events and normalise their labels a second time."""
    t = F.col("spadl_type")
    start, end = cell(F.col("start_x"), F.col("start_y")), cell(F.col("end_x"), F.col("end_y"))
    shot = t == "shot"
    return (actions.groupBy(shot.alias("is_shot"), start.alias("start_cell"), F.when(shot, start).otherwise(end).alias("end_cell"),
                            F.coalesce(F.col("spadl_result") == "success", F.lit(False)).alias("ok"))
            .agg(F.count_if(shot | t.isin(*MOVE_TYPES)).alias("n")).where(F.col("n") > 0))


def _sum_if(cond: Column) -> Column:
    return F.sum(F.when(cond, F.col("n")).otherwise(0))


def xt_cell_counts(actions: DataFrame) -> DataFrame:
    """Per start cell: shots, goals, moves and the three probabilities."""
    shot = F.col("is_shot")
    counted = cell_pairs(actions).groupBy(F.col("start_cell").alias("cell")).agg(
        _sum_if(shot).alias("shots"), _sum_if(shot & F.col("ok")).alias("goals"), _sum_if(~shot).alias("moves"))
    total = F.col("shots") + F.col("moves")
    return counted.select(
        "cell", "shots", "goals", "moves",
        F.when(total > 0, F.col("shots") / total).otherwise(0.0).alias("p_shot"),
        F.when(F.col("shots") > 0, F.col("goals") / F.col("shots")).otherwise(0.0).alias("p_goal"),
        F.when(total > 0, F.col("moves") / total).otherwise(0.0).alias("p_move"),
    )


def xt_transitions(actions: DataFrame) -> DataFrame:
    """P(end cell | start cell) over all moves; successful ones counted."""
    moves = cell_pairs(actions).where(~F.col("is_shot"))
    w = Window.partitionBy("start_cell")  # bounded by the grid
    rows = moves.withColumn("n_start", F.sum("n").over(w)).where("ok")
    return rows.select("start_cell", "end_cell", F.col("n").alias("n_ok"), "n_start", (F.col("n") / F.col("n_start")).alias("p"))


def solve_grid(pairs: DataFrame, eps: float = EPS) -> tuple[np.ndarray, int]:
    """Value iteration xT = Ps*Pg + Pm * T xT from zero until no cell moves by
    more than eps, from the counts of :func:`cell_pairs` (bounded by the grid
    size, which is asserted before anything is collected)."""
    most = 2 * N_CELLS * N_CELLS + 2 * N_CELLS
    rows = pairs.limit(most + 1).collect()
    assert len(rows) <= most
    shots, goals, moves = np.zeros(N_CELLS), np.zeros(N_CELLS), np.zeros(N_CELLS)
    tm = np.zeros((N_CELLS, N_CELLS))
    for r in rows:
        if r["is_shot"]:
            shots[r["start_cell"]] += r["n"]
            goals[r["start_cell"]] += r["n"] * r["ok"]
        else:
            moves[r["start_cell"]] += r["n"]
            tm[r["start_cell"], r["end_cell"]] += r["n"] * r["ok"]
    total = np.maximum(shots + moves, 1)
    gs, pm = shots / total * goals / np.maximum(shots, 1), moves / total
    tm /= np.maximum(moves, 1)[:, None]
    xt = np.zeros(N_CELLS)
    iterations = 0
    diff = np.ones(N_CELLS)
    while np.any(diff > eps):
        new = gs + pm * (tm @ xt)
        diff = new - xt
        xt = new
        iterations += 1
    return xt, iterations


def grid_frame(spark: SparkSession, xt: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(int(i), float(v)) for i, v in enumerate(xt)], "cell int, xt double")


def load_grid(spark: SparkSession, path: str) -> DataFrame:
    """A published grid given as a JSON file (a list of 8 rows of 12, top
    row first, as published). The file is read through Spark, so any file
    system the cluster mounts works; it holds 96 numbers."""
    text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    rows = json.loads(text)
    arr = np.asarray(rows, dtype=float)
    assert arr.shape == (W_CELLS, L_CELLS)
    # published layout: row 0 is the top of the pitch (largest y)
    flat = np.zeros(N_CELLS)
    for r in range(W_CELLS):
        for c in range(L_CELLS):
            flat[(W_CELLS - 1 - r) * L_CELLS + c] = arr[r, c]
    return grid_frame(spark, flat)


def with_xt_value(actions: DataFrame, grid: DataFrame) -> DataFrame:
    """E5 as a column: every action keeps its columns and gains ``xt_value``
    (successful pass/cross/dribble -> xT(end) - xT(start); else null).

    ``grid`` has N_CELLS rows (bounded), so both lookups are broadcast joins
    and the actions keep their partitioning (no shuffle)."""
    g = F.broadcast(grid)
    rated = (actions
             .withColumn("__rated", F.col("spadl_type").isin(*MOVE_TYPES) & (F.col("spadl_result") == "success"))
             .withColumn("__sc", cell(F.col("start_x"), F.col("start_y")))
             .withColumn("__ec", cell(F.col("end_x"), F.col("end_y"))))
    gs_ = g.select(F.col("cell").alias("__sc"), F.col("xt").alias("__xs"))
    ge_ = g.select(F.col("cell").alias("__ec"), F.col("xt").alias("__xe"))
    out = rated.join(gs_, "__sc", "left").join(ge_, "__ec", "left")
    return out.withColumn("xt_value", F.when(F.col("__rated"), F.col("__xe") - F.col("__xs"))).drop(
        "__rated", "__sc", "__ec", "__xs", "__xe")


def xt_values(actions: DataFrame, grid: DataFrame) -> DataFrame:
    """E5: (action_id, xt_value) for every action."""
    return with_xt_value(actions.select("action_id", "spadl_type", "spadl_result", "start_x", "start_y",
                                        "end_x", "end_y"), grid).select("action_id", "xt_value")


def fit_xt(actions: DataFrame) -> tuple[DataFrame, int]:
    spark = actions.sparkSession
    xt, iterations = solve_grid(cell_pairs(actions))
    return grid_frame(spark, xt), iterations
