"""The answer cache: appends that run again, freshness, the whole answer back."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from touchline.operators import answer_cache as AC

TYPES = ("question string, embedding array<float>, answer string, generated_sql string, executed_sql string, result_columns array<string>, "
         "result_rows array<map<string,string>>, row_count long, truncated boolean, grounded boolean, ungrounded_numbers array<string>, "
         "glossary array<map<string,string>>, model string, language string")
NOW = dt.datetime(2024, 6, 1)


def answer(question, vector, language="en", text="3 goals"):
    return (question, vector, text, "g", "x", ["name", "goals"], [{"name": "Ó \"x\"", "goals": "3"}, {"name": None}], 2, False, True, ["7"], [{"term": "xg"}], "m", language)


def ask(spark, rows):
    return spark.createDataFrame(rows, "query_id long, embedding array<float>, language string")


def test_append_and_lookup(spark, tmp_path):
    path = str(tmp_path / "cache")
    q = ask(spark, [(1, [1.0, 0.0], "en"), (2, [1.0, 0.0], "de"), (3, [0.0, 1.0], "en"), (4, [1.0, 0.1], "en"), (5, [1.0, 0.0], None), (6, [0.0, 0.0], "en")])
    assert AC.lookup(q, path).count() == 0
    rows = [answer("a", [2.0, 0.0]), answer("b", [0.0, 5.0], text="none"), answer("b", [0.0, 5.0], text="none"), answer("c", [1.0, 1.0], "de"), answer("z", None)]
    df = spark.createDataFrame(rows, TYPES)

    def put(name, at, **kw):
        return AC.append(df, path, name, F.lit(at), **kw)

    def stop():
        raise ValueError("stopped")

    with pytest.raises(ValueError):
        put("one", NOW - dt.timedelta(hours=2), before_note=stop)
    assert put("one", NOW - dt.timedelta(hours=2)) and not put("one", NOW)
    assert AC.entries(spark, path).count() == 5  # a row that a batch holds twice is two entries
    assert put("two", NOW - dt.timedelta(days=9)) and AC.entries(spark, path).count() == 10
    got = {r.query_id: r for r in AC.lookup(q, path).collect()}
    assert sorted(got) == [1, 3, 4] and got[3].answer == "none"
    r = got[1].asDict()
    want = dict(zip(AC.ANSWER, rows[0]))
    assert all(r[c] == want[c] for c in AC.ANSWER)
    # ten minutes: nothing is fresh; a day: the first batch only
    assert AC.lookup(q, path, F.lit(NOW), max_age_seconds=600).count() == 0
    day = AC.lookup(q, path, F.lit(NOW), max_age_seconds=86_400).collect()
    assert sorted(x.query_id for x in day) == [1, 3, 4] and {x.created_at for x in day} == {NOW - dt.timedelta(hours=2)}
    assert AC.lookup(q, path, threshold=0.9999).count() == 2
