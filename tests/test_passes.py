"""Work per row and per pass of the shared steps of the valuation queries."""

import re

from pyspark.sql import functions as F

from touchline.operators import totals as TT
from touchline.operators import xt as XT
from touchline.plans import entities as E
from touchline.plans import valuation as V
from touchline.sources.projections import MatchData

JIT_LIMIT = 8000  # bytes of a method that the JVM compiles


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_label_is_normalised_once_a_row(md):
    text = plan(V.spadl(md))
    assert text.count("translate(") == 5 and "regexp_replace" not in text


def test_events_are_put_in_folder_order_while_narrow(spark, md):
    """No shuffle of the wide rows before the write, and no sort of them."""
    text = plan(MatchData(spark, md.sf_dir, store=False).events)
    assert "Sort [mcomp" in text.split("Window")[0] and text.index("Project") < text.index("Sort [mcomp")


def longest_method(df, capsys):
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        capsys.readouterr()
        df.select("*").explain("codegen")  # planned anew, also where another test has run it
        return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_the_steps_over_all_events_are_compiled(spark, md, capsys):
    for df in (MatchData(spark, md.sf_dir, store=False).events, V.spadl(md), XT.cell_pairs(V.spadl(md))):
        assert longest_method(df, capsys) < JIT_LIMIT


def test_actions_and_their_shots_are_summed_in_one_pass(spark, md):
    for df in (E.rule_totals(md, "team"), V.light_totals(md, "player")):
        assert plan(df).count("translate(") <= 5 and "FullOuter" not in plan(df)


def test_one_pass_totals_equal_the_join_of_both(spark):
    """Also for a match without competition, whose actions and shots do not meet."""
    acts = spark.createDataFrame(
        [(1, "a", 0.5, None), (1, "a", None, 0.25), (1, "b", 0.25, None), (2, "a", 0.5, 0.5), (2, "b", 1.0, None), (3, None, 1.0, 1.0)],
        "match_id long, team_id string, xt_value double, xg double")
    matches = spark.createDataFrame([(1, "c", "s"), (2, None, "s"), (3, "c", "s")], "match_id long, competition_id string, source string")
    names = spark.createDataFrame([("a", "A")], "team_id string, name string")
    shots = F.col("xg").isNotNull()
    two = TT.metric_totals(acts, None, acts.where(shots), matches, names, "team_id", "team_name")
    one = TT.metric_totals(acts, None, shots, matches, names, "team_id", "team_name")
    assert one.columns == two.columns and sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))
    assert one.count() == 5


def test_events_of_an_entity_are_cut_before_the_shuffle(spark, md):
    """One scan of the events, and no row above the limit is shuffled or joined."""
    rows = spark.createDataFrame([(f"{i:02d}", "p", "t" if i < 9 else None, i % 7, i) for i in range(12)],
                                 "event_id string, player_id string, team_id string, minute int, sequence int")
    df = E.per_entity(rows, ("player", "team"), 4, *E.by_minute())
    assert "WindowGroupLimit" in plan(df)
    got = {}
    for r in df.collect():
        got.setdefault((r.kind, r.entity_id, r.truncated), []).append(r.event_id)
    assert {k: sorted(v) for k, v in got.items()} == {
        ("player", "p", True): ["00", "01", "07", "08"], ("team", "t", True): ["00", "01", "07", "08"]}
    whole = E.per_entity(rows, ("team",), 9, *E.by_minute()).collect()
    assert len(whole) == 9 and not any(r.truncated for r in whole)
