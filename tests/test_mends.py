"""Cases worked by hand from the rules of the feeds, replays and limits."""
import json

import pytest
from pyspark.sql import functions as F

from touchline.operators import checks, possession, ratings, tracking, usage, vectors
from touchline.plans import entities, normalize
from touchline.sources import feeds
from touchline.streaming import jobs


def test_goal_timeline_steps(spark):
    """Two points and a shot end: 18 steps each, then the end; one point alone is one frame."""
    chain = spark.createDataFrame([("g", 1, 0.0, 0.0), ("g", 2, 18.0, 36.0), ("h", 1, 5.0, 6.0), ("k", 1, 1.0, 1.0), ("k", 2, 2.0, 2.0)],
                                  "goal_id string, sequence int, location_x double, location_y double")
    goals = spark.createDataFrame([("g", 36.0, 36.0), ("h", None, None), ("k", None, None)],
                                  "event_id string, end_location_x double, end_location_y double")
    rows = {(r.goal_id, r.frame): (r.x, r.y) for r in possession.goal_timeline(chain, goals).collect()}
    assert [rows[("g", f)] for f in (0, 1, 9, 17, 18, 19, 35, 36)] == [
        (0, 0), (1, 2), (9, 18), (17, 34), (18, 36), (19, 36), (35, 36), (36, 36)]
    assert sorted(f for g, f in rows if g == "g") == list(range(37))
    assert [v for (g, _), v in rows.items() if g == "h"] == [(5, 6)]
    assert sorted(f for g, f in rows if g == "k") == list(range(19)) and rows[("k", 18)] == (2, 2)


def test_player_keeps_a_row_for_either_team(spark):
    loads = spark.createDataFrame([("p", "a", 7, ["Defender"], 1), ("p", "b", None, ["Midfielder"], 2), ("p", "b", 9, ["Attacker", "Midfielder"], 1)],
                                  "player_id string, team_id string, jersey_number int, positions array<string>, load int")
    got = {r.team_id: (r.jersey_number, r.positions) for r in normalize.merge_team_rows(loads).collect()}
    assert got == {"a": (7, ["Defender"]), "b": (9, ["Attacker", "Midfielder"])}


def test_track_points_carry_the_clip_in_their_track_id(spark):
    pts = spark.createDataFrame([("clip1", 4, 10, 0.4, 60.0, 40.0)],
                                "clip_name string, track_id int, frame_index int, time_seconds double, cx double, cy double")
    r = tracking.load_track_points(pts, 120, 80).first()
    assert (r.clip_id, r.track_id, r.x, r.y) == ("cv:clip1", "cv:clip1:4", 0.5, 0.5)
    with pytest.raises(ValueError):
        tracking.load_track_points(pts, 0, 80)


def test_envelopes_with_object_errors_are_rejected(spark, tmp_path):
    event = {"time": {"elapsed": None, "extra": None}, "team": {"id": 3, "name": "T"}, "player": {"id": 5, "name": "P"},
             "type": "Card", "detail": "Yellow Card"}
    pages = [{"fixture_id": 1, "errors": [], "response": [event]}, {"fixture_id": 2, "errors": {"token": "Missing key."}, "response": []},
             {"fixture_id": 3, "errors": ["limit"], "response": []}, {"fixture_id": 4, "errors": {}, "response": []}, {"fixture_id": 5, "response": []}]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, pages)))
    ok, bad = feeds.envelope_errors(spark, str(tmp_path))
    assert sorted(r.fixture_id for r in ok.collect()) == [1, 4, 5]
    assert sorted(r.fixture_id for r in bad.collect()) == [2, 3]
    row = feeds.fixture_events_to_events(ok).first()
    assert (row.minute, row.period, row.outcome) == (0, 1, "Yellow Card")


def test_events_of_pretty_printed_arrays(spark, tmp_path):
    """The provider's layout: one array per match in <match id>.json."""
    event = {"id": "e1", "index": 1, "period": 1, "minute": 2, "second": 3, "type": {"id": 30, "name": "Pass"}, "team": {"id": 7, "name": "T"},
             "location": [1.0, 2.0], "pass": {"end_location": [3.0, 4.0], "type": {"id": 1, "name": "Corner"}}}
    (tmp_path / "15946.json").write_text(json.dumps([event, event | {"id": "e2", "index": 2}], indent=2))
    (tmp_path / "readme-events.json").write_text(json.dumps([event], indent=2))
    got = sorted((r.event_id, r.match_id, r.sequence, r.end_location_x) for r in feeds.read_events(spark, str(tmp_path), multiline=True).collect())
    assert got == [("e1", 15946, 1, 3.0), ("e2", 15946, 2, 3.0)]
    rejects = feeds.unnamed_event_files(spark, str(tmp_path), multiline=True).collect()
    assert [r.events for r in rejects] == [1] and rejects[0].path.endswith("readme-events.json")


def test_long_chains_are_one_component(spark):
    """Sixty-six teams in a row: more rounds than the sixty-four once allowed."""
    rows = [(f"t{i:03d}", f"t{i + 1:03d}") for i in range(65)]
    comp = ratings.team_components(spark.createDataFrame(rows, "home_team_id string, away_team_id string").coalesce(1))
    assert {r.component for r in comp.collect()} == {"t000"}


def test_bracket_sizes(spark):
    def even(m):
        return m.select("*", F.lit(0.5).alias("p_win"), F.lit(0.0).alias("p_draw"))

    def bracket(n):
        return spark.createDataFrame([(i, f"t{i}", 1500.0) for i in range(n)], "slot int, team string, rating double")

    assert {round(r.title_probability, 9) for r in ratings.knockout_title_odds(bracket(8), even).collect()} == {0.125}
    with pytest.raises(ValueError):
        ratings.knockout_title_odds(bracket(6), even)


def test_fit_reaches_a_stationary_point():
    """Gradient of the fitted parameters against differences of the likelihood."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(2)
    rows = []
    for h in range(6):
        for a in range(6):
            if h != a:
                n = 4
                hg, ag = rng.poisson(1.2 + 0.2 * h, n), rng.poisson(1.0 + 0.1 * a, n)
                rows.append((f"t{h}", f"t{a}", n, hg.sum(), ag.sum(), *(((hg == i) & (ag == j)).sum() for i, j in ((0, 0), (0, 1), (1, 0), (1, 1)))))
    pdf = pd.DataFrame(rows, columns=["home_team_id", "away_team_id", "n", "shg", "sag", "n00", "n01", "n10", "n11"])
    teams, theta, n = ratings.fit_pairs(pdf)
    assert n == 120 and len(teams) == 6
    idx = {t: i for i, t in enumerate(teams)}
    args = (pdf["home_team_id"].map(idx).to_numpy(), pdf["away_team_id"].map(idx).to_numpy(),
            *(pdf[c].to_numpy(float) for c in ("n", "shg", "sag", "n00", "n01", "n10", "n11")), 6)
    _, grad = ratings._nll_grad(theta, *args)
    for i in range(len(theta)):
        step = np.zeros_like(theta)
        step[i] = 1e-6
        slope = (ratings._nll_grad(theta + step, *args)[0] - ratings._nll_grad(theta - step, *args)[0]) / 2e-6
        assert abs(slope - grad[i]) < 1e-4
        assert abs(grad[i]) < 1e-3 or abs(abs(theta[2]) - ratings.RHO_BOUND) < 1e-9
    with pytest.raises(RuntimeError):
        ratings.fit_pairs(pdf, max_iter=1)


def test_nearest_over_many_blocks(spark):
    """Blocks of questions give what one block gives, ties by entry id."""
    import numpy as np

    rng = np.random.default_rng(0)
    e = spark.createDataFrame([(i, rng.standard_normal(4).tolist()) for i in range(300)] + [(900, [1.0, 0.0, 0.0, 0.0]), (901, [2.0, 0.0, 0.0, 0.0])],
                              "entry_id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(i, rng.standard_normal(4).tolist()) for i in range(50)] + [(99, [1.0, 0.0, 0.0, 0.0])], "query_id long, embedding array<double>")
    one, many = ({(r.query_id, r["rank"]): (r.entry_id, round(r.distance, 9)) for r in vectors.nearest(e, q, 3, block_size=b).collect()} for b in (1000, 7))
    assert one == many and len(one) == 153
    assert [one[(99, k)][0] for k in (1, 2)] == [900, 901]


def test_token_counts_are_rounded(spark):
    df = spark.createDataFrame([(1.4, 2.5, -3.0, None), (float("nan"), float("inf"), 10.0, 0.0)], "a double, b double, c double, d double")
    cost = [r[0] for r in df.select(checks.token_cost(*(F.col(c) for c in "abcd"))).collect()]
    assert cost == pytest.approx([(1 * 1.0 + 3 * 5.0) / 1e6, (10 * 0.1) / 1e6])


def test_maps_are_cut_per_entity(spark):
    ev = spark.createDataFrame([(f"e{i}", "p1" if i < 5 else "p2", "t", i, i) for i in range(7)],
                               "event_id string, player_id string, team_id string, minute int, sequence int")
    got = entities.per_entity(ev, ("player", "team"), 3, *entities.by_minute()).collect()
    assert {(r.entity_id, r.truncated) for r in got} == {("p1", True), ("p2", False), ("t", True)}
    assert sorted(r.event_id for r in got if r.entity_id == "p1") == ["e0", "e1", "e2"]
    assert sum(r.entity_id == "p2" for r in got) == 2


def test_comparison_without_a_metric_is_null(spark):
    m = spark.createDataFrame([("a", "c", 3, 5, 9, 0.5, 0.1, 1.0), ("b", "c", 3, None, None, None, None, None)],
                              "id string, competition_id string, goals long, shots long, passes long, xt double, vaep double, xg double")
    pairs = spark.createDataFrame([("c", "a", "b")], "competition_id string, left_id string, right_id string")
    got = {r.metric: (r.left_value, r.right_value, r.higher) for r in entities.compare(m, pairs).collect()}
    assert got["goals"] == (3.0, 3.0, "equal") and got["xg"] == (1.0, None, None) and len(got) == 6


REQUESTS = "request_id long, subject_kind string, subject string, ts timestamp"


@pytest.mark.parametrize("shuffled", [False, True])
def test_streamed_decisions_of_a_busy_subject(spark, tmp_path, shuffled):
    """25,000 requests of one subject in one file (more than an Arrow batch), then
    a second file for the same day, some of it late: counts go on where they stood."""
    import datetime as dt

    from pyspark.sql import Window

    base = dt.datetime(2024, 5, 1)
    rows = spark.range(25_000).select(
        F.col("id").alias("request_id"), F.lit("user").alias("subject_kind"), F.lit("7").alias("subject"),
        (F.lit(base) + F.expr("make_dt_interval(0, 0, 0, id)")).cast("timestamp").alias("ts"))
    (rows.orderBy(F.xxhash64("request_id")) if shuffled else rows.orderBy("ts")).coalesce(1).write.parquet(str(tmp_path / "in/1"))
    late = spark.createDataFrame([(90_000, "user", "7", base + dt.timedelta(seconds=30)), (90_001, "user", "7", base + dt.timedelta(seconds=30)),
                                  (90_002, "user", "8", base)], REQUESTS)
    limits = spark.createDataFrame([("user", "7", 30, 1000), ("user", "8", 30, 1000)], "subject_kind string, subject string, minute_limit int, day_limit int")
    first = {r.request_id: r for r in jobs.rate_decisions_stream(
        spark.readStream.schema(REQUESTS).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")), limits).collect()}
    w = lambda unit: Window.partitionBy("subject", F.date_trunc(unit, "ts")).orderBy("ts", "request_id")
    want = rows.select("request_id", F.row_number().over(w("minute")).alias("m"), F.row_number().over(w("day")).alias("d")).collect()
    assert len(first) == 25_000
    assert all((first[r.request_id].minute_count, first[r.request_id].day_count, first[r.request_id].allowed) == (r.m, r.d, r.m <= 30 and r.d <= 1000) for r in want)
    late.coalesce(1).write.parquet(str(tmp_path / "in/2"))
    both = {r.request_id: r for r in jobs.rate_decisions_stream(
        spark.readStream.schema(REQUESTS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), limits).collect()}
    assert len(both) == 25_003
    assert sorted(both[i].minute_count for i in (90_000, 90_001)) == [61, 62]
    assert sorted(both[i].day_count for i in (90_000, 90_001)) == [25_001, 25_002]
    assert not both[90_000].allowed and both[90_002].allowed and both[90_002].day_count == 1


def test_streamed_decisions_keep_the_counts_of_old_days(spark, tmp_path):
    """Files that share days far apart, one of them with a row far in the future:
    every window counts on where earlier batches left it."""
    import datetime as dt

    base = dt.datetime(2024, 5, 1, 10)
    rows, n = [], 0
    for file, days in enumerate([(0, 9), (9, 0, 20_000), (5, 0), (0, 9)]):
        part = [(n + i, "user", str(i % 2), base + dt.timedelta(days=d, seconds=i)) for i, d in enumerate(days * 4)] + [(n + 50, "user", "0", None)]
        spark.createDataFrame(part, REQUESTS).coalesce(1).write.parquet(str(tmp_path / f"in/{file}"))
        rows, n = rows + part[:-1], n + 100
    limits = spark.createDataFrame([("user", s, 100, 5) for s in "01"], "subject_kind string, subject string, minute_limit int, day_limit int")
    got = {r.request_id: r for r in jobs.rate_decisions_stream(
        spark.readStream.schema(REQUESTS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), limits).collect()}
    assert len(got) == len(rows)
    windows = {}
    for i, _, subject, ts in rows:
        windows.setdefault((subject, ts.date()), []).append(got[i])
    for found in windows.values():
        assert sorted(r.day_count for r in found) == list(range(1, len(found) + 1))
        assert sorted(r.minute_count for r in found) == list(range(1, len(found) + 1))
        assert all(r.allowed == (r.day_count <= 5) for r in found)


def test_carried_counts_are_added(spark):
    import datetime as dt

    t = dt.datetime(2024, 5, 1, 10, 0, 5)
    r = spark.createDataFrame([(1, "user", "7", t)], REQUESTS)
    limits = spark.createDataFrame([("user", "7", 30, 1000)], "subject_kind string, subject string, minute_limit int, day_limit int")
    seen = spark.createDataFrame([("user", "7", "minute", t.replace(second=0), 30), ("user", "7", "day", t.replace(hour=0, second=0), 31)], jobs.WINDOW_SCHEMA)
    got = usage.rate_decisions(r, limits, seen).first()
    assert (got.minute_count, got.day_count, got.allowed, got.scope) == (31, 32, False, "minute")
