"""Value queries: rows keep what belongs to them; only null or repeated ids are joined."""

import re

from pyspark.sql import functions as F

from touchline.operators import models
from touchline.operators import totals as TT
from touchline.operators import vaep as VA
from touchline.operators import xt as XT
from touchline.plans import valuation as V
from touchline.sources.projections import MatchData


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def own(md, **memo):
    """Projections with some derived tables given."""
    out = MatchData(md.spark, md.sf_dir)
    out.__dict__["_memo"] = memo
    return out


def rows(spark):
    """Scored rows: id c is on three rows of two matches, one id is null."""
    ids = ["a", "b", "c", "c", None, "d", "c"]
    data = [(x, 1 if i < 5 else 2, i, f"t{i % 2}", None if i == 5 else f"p{i % 3}", "pass", "success", "foot", float(i * 4), 5.0 * i, 30.0, 90.0 - i, 30.0,
             0.01 * (2 if x == "c" else i + 3), 0.02 * (1 if x == "c" else i + 1)) for i, x in enumerate(ids)]
    df = spark.createDataFrame(data, "action_id string, match_id long, action_order int, team_id string, player_id string, spadl_type string, spadl_result string, "
                               "spadl_bodypart string, time_seconds double, start_x double, start_y double, end_x double, end_y double, p_scores double, p_concedes double")
    return df.withColumn("repeated", F.col("action_id").isNull() | (F.col("action_id") == "c"))


def listed(df, *columns):
    return sorted(map(repr, df.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in df.dtypes if not columns or c in columns]).collect()))


def test_repeated_and_null_ids_meet_as_by_joins(spark, md):
    s = rows(spark)
    grid = XT.grid_frame(spark, [i / 100 for i in range(XT.N_CELLS)])
    m = own(md, scored=s, xt_grid=grid)
    probs = s.select("action_id", "p_scores").join(s.select("action_id", "p_concedes"), "action_id")
    assert listed(V.vaep_probs(m)) == listed(probs) and probs.count() == 3 + 9
    a = s.drop("p_scores", "p_concedes", "repeated")
    vaep = VA.formula(a, probs)
    assert listed(V.vaep(m)) == listed(vaep) and vaep.count() == 3 + 27
    values = TT.action_values(XT.xt_values(a, grid), vaep)
    assert listed(V.action_values(m)) == listed(values) and values.count() == 3 + 81 + 1
    joined = a.select("action_id", "match_id", "team_id", "player_id").join(values, "action_id", "left")
    assert listed(V.valued_actions(m)) == listed(joined) and joined.count() == 3 + 243 + 1


def test_ids_of_one_row_are_not_joined(md):
    for df in (V.vaep_probs(md), V.vaep(md)):
        assert "Join" not in plan(df)
    for df in (V.action_values(md), V.valued_actions(md)):
        assert plan(df).count("Join") == 2 and plan(df).count("LocalRelation") + plan(df).count("LogicalRDD") == 2  # the grid, for start and end
        assert plan(df).count("Window") == plan(V.vaep(md)).count("Window")
    actions = V.spadl(md)
    assert V.action_values(md).count() == V.vaep_probs(md).count() == V.valued_actions(md).count() == actions.count()


def test_scored_rows_mark_null_and_repeated_ids(spark, md):
    a = V.spadl(md).where("match_id % 10 = 0").withColumn("action_id", F.when(F.col("action_order") == 3, F.lit(None)).when(F.col("action_order") == 5, F.lit("x")).otherwise(F.col("action_id")))
    got = VA.scored(a)
    assert got.count() == a.count()
    assert {r.action_id for r in got.where("repeated").select("action_id").distinct().collect()} == {None, "x"}
    assert got.where("repeated").count() == a.where("action_order IN (3, 5)").count()


def test_a_pass_of_a_fit_reads_blocks(spark, monkeypatch):
    df = spark.range(3000).select("id", (F.rand(3) * 5).alias("a"), F.rand(4).alias("b")).withColumn("y", (F.col("a") + 3 * F.col("b") + F.rand(5) > 4).cast("int"))
    read, reduced = [], models._reduced
    monkeypatch.setattr(models, "_reduced", lambda rows, *args: read.append(rows.count()) or reduced(rows, *args))
    assert models.fit_predict(df.coalesce(2), ["a", "b"], "y", "p", ["id"]).count() == 3000
    assert max(read) <= 10


def test_a_look_ahead_collects_goals_only(spark):
    a = spark.createDataFrame([(f"{i}", 1, i, "t" if i % 2 else None, "shot" if i in (4, 20) else "pass", "success" if i == 4 else "owngoal" if i == 20 else None) for i in range(30)],
                              "action_id string, match_id long, action_order int, team_id string, spadl_type string, spadl_result string")
    got = {r.action_order: (r.scores, r.concedes) for r in VA.labels(a).collect()}
    # the goal's team is null: it is nobody's own, so it counts against all others; the own goal scores for all but its team
    assert [i for i in got if got[i][0]] == [4, *range(11, 20)] and [i for i in got if got[i][1]] == [*range(0, 4), 20]
    assert re.search(r"CASE WHEN [^\n]*struct\([^\n]* END AS _w0", plan(VA.labels(a)))
