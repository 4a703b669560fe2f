"""Expected rows, the report, and subscriptions with deletions, by hand."""

import random

from pyspark.sql import functions as F

from touchline.operators import evaluation as EV
from touchline.operators import usage as U


def test_expected_rows(spark):
    rows = spark.createDataFrame([
        (1, "7", "  Real   MADRID ", "1,234", 3.0, ["x", "Red Card"], {"k": "Cup"}, 5), (1, "8", "Ajax", "9", 4.0, None, None, 6),
        (2, "3", "Ajax", "", None, [], {}, None), (3, "99", "99 goals", None, 2.0, None, None, 1), (4, "1", "a", "x", float("nan"), None, None, 0)],
        "question_id long, team_id string, team string, note string, value double, tags array<string>, extra map<string,string>, goals int")
    cases = {
        1: (["real madrid", "RED card", "cup"], [1234.0, 3.002, 5.0], True),
        11: (["real madrid"], [9.0], False), 12: (["ajax"], [4.0], True)}  # 11: entity and value in different rows
    expected = [(1, *cases[1][:2]), (2, ["ajax"], [0.0]), (3, [], [99.0]), (4, ["a"], [0.0]), (5, [], []), (6, ["a"], [])]
    got = {r.question_id: (r.n_rows, r.matched) for r in EV.match_expected(rows, spark.createDataFrame(expected, "question_id long, entities array<string>, values array<double>")).collect()}
    # 2: blank text is the number 0; 3: ids do not count, nor numbers inside texts; 5, 6: no rows
    assert got == {1: (2, True), 2: (1, True), 3: (1, False), 4: (1, True), 5: (0, False), 6: (0, False)}
    for n in (11, 12):
        e = spark.createDataFrame([(1, *cases[n][:2])], "question_id long, entities array<string>, values array<double>")
        assert EV.match_expected(rows, e).first().matched is cases[n][2]
    bad = spark.createDataFrame([(1, ["ajax", " "], []), (2, None, [float("nan")]), (4, None, None)], "question_id long, entities array<string>, values array<double>")
    assert {r.question_id: r.matched for r in EV.match_expected(rows, bad).collect()} == {1: False, 2: False, 4: True}


RESULTS = ("question_id long, category string, passed boolean, grounded boolean, latency_ms double, cost_usd double, "
           "input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long")


def test_report(spark, tmp_path):
    rows = [(i, "ab"[i % 2], i != 7, True, float(i), 0.01, i, None, 1, None) for i in range(20)]
    df = spark.createDataFrame(rows, RESULTS)
    EV.write_report(df, str(tmp_path))
    doc, bad = EV.read_report(spark, str(tmp_path), df.schema)
    r = doc.first()
    assert (r.gate.passed, r.totals.passed, r.totals.failed, r.totals.ungrounded) == (True, 19, 1, 0)
    assert [(c.category, c.questions, c.failed) for c in r.categories] == [("a", 10, 0), ("b", 10, 1)]
    assert (r.latency.p95_ms, r.latency.average_ms, r.usage.average_tokens, r.usage.cost_within_gate) == (18.0, 9.5, 10.5, True)
    assert [tuple(x) for x in bad.collect()] == [rows[7]]
    for change in (F.lit(False), F.lit(None).cast("boolean")):
        assert not EV.summary(df.withColumn("grounded", F.when(F.col("question_id") == 3, change).otherwise(F.col("grounded")))).first().gate.passed
    assert not EV.summary(df.withColumn("cost_usd", F.when(F.col("question_id") > 17, 0.06).otherwise(0.001))).first().gate.passed  # the 95th percentile
    none = EV.summary(df.limit(0)).first()
    assert (none.totals.questions, none.totals.accuracy, none.gate.passed, none.categories) == (0, 0.0, False, [])


def test_subscription_fold(spark):
    kind = "customer_id string, arrival long, kind string, subscription_id string, status string, current_period_end long"
    events = [("a", 1, "updated", "s1", "active", 10), ("a", 2, "deleted", "s1", "active", 11), ("b", 1, "deleted", "s2", "canceled", 5), ("b", 2, "updated", "s3", "trialing", 20),
              ("c", 1, "updated", "s4", "past_due", 7), ("d", 5, "updated", "s5", "active", 9), ("d", 5, "deleted", "s5", "active", 9), ("d", 6, "invoice", "s9", "active", 1),
              ("e", None, "updated", "s6", "active", 1), ("x", 1, "updated", "s7", "active", 1)]
    customers = spark.createDataFrame([(i, c) for i, c in enumerate("abcdef")], "user_id long, customer_id string")
    want = {"a": ("s1", "active", 11, True, "free", 2), "b": ("s3", "trialing", 20, False, "premium", 2), "c": ("s4", "past_due", 7, False, "free", 1),
            "d": ("s5", "active", 9, True, "free", 2), "e": (None, None, None, False, "free", 0), "f": (None, None, None, False, "free", 0)}
    rng = random.Random(1)
    for _ in range(3):  # in whatever order rows arrive
        rng.shuffle(events)
        got = U.subscription_fold(spark.createDataFrame(events, kind), customers)
        assert {r.customer_id: tuple(r)[2:] for r in got.collect()} == want
    early = {r.customer_id: (r.tier, r.deleted) for r in U.subscription_fold(spark.createDataFrame(events, kind), customers, F.lit(1)).collect()}
    assert early == {"a": ("premium", False), "b": ("free", True), "c": ("free", False), "d": ("free", False), "e": ("free", False), "f": ("free", False)}
