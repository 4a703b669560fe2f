"""Hand-worked cases restated from the reference's unit tests, plus the
label maps on literal rows."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F


def one(df):
    return [tuple(r) for r in df.collect()]


def test_grounding_found_and_not_found(spark):
    from touchline.operators import checks as C

    rows = spark.createDataFrame([(1, 7.0, "Spain")], "aid long, goals double, team string")
    g = C.grounded_numbers(rows, "aid", ["goals"], ["team"])
    answers = spark.createDataFrame([(1, "Spain scored 7 goals.")], "aid long, text string")
    assert one(C.verify_grounding(answers, "aid", "text", g)) == []
    answers = spark.createDataFrame([(1, "Spain scored 9 goals.")], "aid long, text string")
    assert one(C.verify_grounding(answers, "aid", "text", g)) == [(1, "9")]


def test_number_pattern_lookbehind(spark):
    from touchline.operators import checks as C

    df = spark.createDataFrame([("a12 and -3,400.5% x9",)], "t string")
    assert one(df.select(C.extract_numbers(F.col("t"))))[0][0] == ["2", "-3,400.5%"]


WRITES = ["insert into t values (1)", "update t set a = 1", "delete from t", "merge into t using s on true",
          "truncate t", "drop table t", "alter table t add c int", "create table t (a int)", "grant all on t to x",
          "revoke all on t from x", "copy t from 'f'", "call p()"]


def test_statement_screen(spark):
    from touchline.operators import checks as C

    rows = [(s,) for s in WRITES + ["select * from t for share", "select 1", "", "select 1; select 2",
                                    "select * from t for update"]]
    df = spark.createDataFrame(rows, "sql string").select(C.statement_screen(F.col("sql")).alias("v"))
    got = [r[0] for r in df.collect()]
    assert got[:12] == ["forbidden_keyword"] * 12
    assert got[12:16] == ["forbidden_select", "ok", "empty", "multiple_statements"]
    assert got[16] != "ok"  # a row lock is rejected (its keyword is caught first)


def test_row_cap(spark):
    from touchline.operators import checks as C

    df = spark.createDataFrame([(5000, 5000), (12, 12)], "req long, rows long")
    eff, trunc = C.row_cap(F.col("req"), F.col("rows"), cap=100)
    assert one(df.select(eff, trunc)) == [(100, True), (12, True)]


def test_homography_recovers_corners(spark):
    from touchline.operators import tracking as TR

    px = [(0, 0), (1280, 0), (1280, 600), (0, 600)]
    pitch = [(0, 0), (105, 0), (105, 68), (0, 68)]
    pairs = spark.createDataFrame([("c", float(a), float(b), float(x), float(y)) for (a, b), (x, y) in zip(px, pitch)],
                                  "clip_id string, px double, py double, X double, Y double")
    h = TR.calibrate_clips(pairs)
    pts = spark.createDataFrame([("c", 640.0, 300.0)], "clip_id string, x double, y double")
    out = TR.apply_calibration(pts, h).collect()[0]
    assert abs(out["pitch_x"] - 52.5) <= 0.5 and abs(out["pitch_y"] - 34) <= 0.5
    few = pairs.limit(3)
    with pytest.raises(Exception):
        TR.calibrate_clips(few).collect()


def test_label_maps(spark):
    from touchline.functions import labels as L

    df = spark.createDataFrame([("Left Foot", "From Throw In", "FT", "card", "Yellow Card", 91, " Yes ")],
                               "b string, p string, s string, t string, d string, m int, f string")
    r = df.select(L.map_body_part(F.lit(None).cast("string"), F.col("b")), L.map_play_pattern(F.col("p")),
                  L.map_fixture_status(F.col("s")), L.map_feed_event_type(F.col("t"), F.col("d")),
                  L.infer_period(F.col("m")), L.parse_bool(F.col("f"))).collect()[0]
    assert tuple(r) == ("left_foot", "from_throw_in", "complete", "Yellow Card", 3, True)


def test_league_with_two_seasons(spark, tmp_path):
    from touchline.sources import feeds as FD

    p = tmp_path / "leagues.json"
    p.write_text(json.dumps({"league": {"id": 39, "name": "Premier League", "type": "League"},
                             "country": {"name": "England", "code": "GB"}, "seasons": [{"year": 2022}, {"year": 2023}]}))
    got = sorted(one(FD.leagues_to_competitions(spark, str(p)).select("competition_id", "gender")))
    assert got == [("39:2022", "unknown"), ("39:2023", "unknown")]


def test_fixture_finished_and_upcoming(spark, tmp_path):
    from touchline.sources import feeds as FD

    fx = [{"fixture": {"id": 1, "date": "2023-08-11T19:00:00+00:00", "status": {"short": "FT"}},
           "league": {"id": 39, "season": 2023, "round": "R1"},
           "teams": {"home": {"id": 44, "name": "Burnley"}, "away": {"id": 50, "name": "Manchester City"}},
           "goals": {"home": 0, "away": 3}},
          {"fixture": {"id": 2, "date": "2023-08-12T14:00:00+00:00", "status": {"short": "NS"}},
           "league": {"id": 39, "season": 2023, "round": "R1"},
           "teams": {"home": {"id": 42, "name": "Arsenal"}, "away": {"id": 65, "name": "Nottingham Forest"}},
           "goals": {"home": None, "away": None}}]
    p = tmp_path / "fixtures.json"
    p.write_text("\n".join(json.dumps(x) for x in fx))
    rows = {r["match_id"]: r for r in FD.fixtures_to_matches(spark, str(p)).collect()}
    assert str(rows[1]["match_date"]) == "2023-08-11" and rows[1]["kickoff_time"] == "19:00:00"
    assert (rows[1]["home_score"], rows[1]["away_score"], rows[1]["status"]) == (0, 3, "complete")
    assert rows[2]["home_score"] is None and rows[2]["status"] == "scheduled" and rows[2]["referee"] is None


def test_error_envelope_is_rejected(spark, tmp_path):
    from touchline.sources import feeds as FD

    p = tmp_path / "env.json"
    p.write_text(json.dumps({"fixture_id": 7, "errors": ["token"], "response": []}))
    ok, bad = FD.envelope_errors(spark, str(p))
    assert ok.count() == 0 and bad.count() == 1
