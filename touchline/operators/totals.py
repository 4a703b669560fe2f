"""Materialised metric totals per (entity, competition) and the value tables.

Both totals are grouped aggregations (partial aggregation map-side, one shuffle
each by entity key): one pass where the shots are rows of the actions, else two
combined with a full outer join on the grouping key. The names come from a left
join with the (bounded) entity table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOTAL_COLS = ("total_xt", "total_vaep", "total_vaep_offensive", "total_vaep_defensive", "total_xg",
              "xt_action_count", "shot_count", "action_count")


VALUE_COLS = ("xt_value", "vaep_offensive", "vaep_defensive", "vaep_value")


def clean_values(rows: DataFrame, *keep: str) -> DataFrame:
    """G8 of rows that carry their four values: NaN -> null; ``keep`` are columns that stay."""
    return rows.select("action_id", *keep, *[F.when(~F.isnan(F.col(c)), F.col(c)).alias(c) for c in VALUE_COLS])


def action_values(xt: DataFrame, vaep: DataFrame | None) -> DataFrame:
    """One row per action: xt_value and the three VAEP numbers, NaN -> null."""
    if vaep is None:
        return clean_values(xt.select("action_id", "xt_value", *[F.lit(None).cast("double").alias(c) for c in VALUE_COLS[1:]]))
    return clean_values(xt.select("action_id", "xt_value").join(vaep.select("action_id", *VALUE_COLS[1:]), "action_id", "left"))


def _apart(both: DataFrame, key: str) -> DataFrame:
    """Sums of one pass as the full outer join of actions and shots gives them:
    null keys do not meet, so such a group has a row of each."""
    of_shots, other = ("s_xg", "s_n"), [c for c in both.columns if c.startswith("a_")]

    def row(own: tuple | list) -> Column:
        return F.struct(*[(F.col(c) if c in own else F.lit(None).cast(both.schema[c].dataType)).alias(c) for c in (*other, *of_shots)])

    apart = (F.col("competition_id").isNull() | F.col("source").isNull()) & (F.col("s_n") > 0)
    rows = F.when(apart, F.array(row(other), row(of_shots))).otherwise(F.array(row([*other, *of_shots])))
    return both.select(key, "competition_id", "source", F.explode(rows).alias("x")).select(key, "competition_id", "source", "x.*")


def metric_totals(actions: DataFrame, values: DataFrame | None, shots: DataFrame | Column, matches: DataFrame,
                  names: DataFrame, key: str, name_col: str) -> DataFrame:
    """H1 / H2: totals by (key, competition_id, source).

    ``names`` is (key, name) of the entity table; ``key`` is player_id or team_id.
    With ``values`` None the value columns are already on ``actions`` (missing
    ones count as null), which saves the join on action id. ``shots`` is a table
    or, where they are rows of ``actions`` with their ``xg``, the condition that
    says which: actions and shots are then summed in one pass.
    """
    m = matches.select("match_id", "competition_id", "source")
    value_cols = ("xt_value", "vaep_value", "vaep_offensive", "vaep_defensive")
    one_pass = isinstance(shots, Column)
    if values is None:
        have = set(actions.columns)
        known = lambda c: F.col(c) if c in have else F.lit(None).cast("double").alias(c)
        own = [known("xg"), shots.alias("is_shot")] if one_pass else []
        acts = actions.where(F.col(key).isNotNull()).select("match_id", key, *map(known, value_cols), *own)
    else:
        acts = (actions.where(F.col(key).isNotNull()).select("action_id", "match_id", key)
                .join(values, "action_id", "left"))
    of_actions = (F.sum("xt_value").alias("a_xt"), F.sum("vaep_value").alias("a_vaep"),
                  F.sum("vaep_offensive").alias("a_off"), F.sum("vaep_defensive").alias("a_def"),
                  F.count("xt_value").alias("a_xt_n"), F.count(F.lit(1)).alias("a_n"))
    grouped = acts.join(m, "match_id").groupBy(key, "competition_id", "source")
    if one_pass:
        both = _apart(grouped.agg(*of_actions, F.sum(F.when(F.col("is_shot"), F.col("xg"))).alias("s_xg"),
                                  F.count_if("is_shot").alias("s_n")), key)
    else:
        s = (shots.where(F.col(key).isNotNull()).select("match_id", key, "xg")
             .join(m, "match_id")
             .groupBy(key, "competition_id", "source")
             .agg(F.sum("xg").alias("s_xg"), F.count(F.lit(1)).alias("s_n")))
        both = grouped.agg(*of_actions).join(s, [key, "competition_id", "source"], "full_outer")
    z = lambda c, t="double": F.coalesce(F.col(c), F.lit(0).cast(t))
    return both.join(names.select(F.col(names.columns[0]).alias(key), F.col(names.columns[1]).alias(name_col)),
                     key, "left").select(
        key, "competition_id", "source", name_col,
        z("a_xt").alias("total_xt"), z("a_vaep").alias("total_vaep"),
        z("a_off").alias("total_vaep_offensive"), z("a_def").alias("total_vaep_defensive"),
        z("s_xg").alias("total_xg"),
        z("a_xt_n", "bigint").alias("xt_action_count"), z("s_n", "bigint").alias("shot_count"),
        z("a_n", "bigint").alias("action_count"),
    )


def upsert(existing: DataFrame, updates: DataFrame, keys: list[str], order_col: str | None = None) -> DataFrame:
    """Insert-or-replace on ``keys``; duplicates inside ``updates`` keep the
    last by ``order_col`` (when given). Returns the new table version."""
    if order_col is not None:
        from pyspark.sql import Window
        w = Window.partitionBy(*keys).orderBy(F.col(order_col).desc())
        updates = updates.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
    kept = existing.join(updates.select(*keys), keys, "left_anti")
    return kept.unionByName(updates.select(*existing.columns))


def insert_ignore(existing: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Insert rows whose key is new; existing rows win (on conflict do nothing)."""
    new = updates.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(new.select(*existing.columns))
