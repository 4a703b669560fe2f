"""Streams that are stopped and started again, and merges that are run again."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.sources import stored
from touchline.streaming import jobs

REQUESTS = "request_id long, subject_kind string, subject string, ts timestamp"
BASE = dt.datetime(2024, 5, 1, 10)


def landed(spark, path, files):
    """One file a list of rows, in order."""
    for name, rows in files:
        spark.createDataFrame(rows, REQUESTS).coalesce(1).write.parquet(f"{path}/{name}")


def stream(spark, path):
    return spark.readStream.schema(REQUESTS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(path)


def made(file, n=120):
    """Requests of three subjects over two days; each file is later than the one before."""
    return [(file * 1000 + i, "user", str(i % 3 if i % 5 else 0), BASE + dt.timedelta(hours=8 * file, seconds=7 * i)) for i in range(n)]


def limits(spark):
    return spark.createDataFrame([("user", s, 5, 60) for s in "012"], "subject_kind string, subject string, minute_limit int, day_limit int")


def batch_twin(spark, rows):
    def w(unit):
        return Window.partitionBy("subject", F.date_trunc(unit, "ts")).orderBy("ts", "request_id")

    df = spark.createDataFrame(rows, REQUESTS).select("request_id", F.row_number().over(w("minute")).alias("m"), F.row_number().over(w("day")).alias("d"))
    return {r.request_id: (r.m, r.d, r.m <= 5 and r.d <= 60) for r in df.collect()}


def decided(df):
    rows = df.collect()
    assert len({r.request_id for r in rows}) == len(rows)
    return {r.request_id: (r.minute_count, r.day_count, r.allowed) for r in rows}


@pytest.mark.parametrize("job", [jobs.rate_limiter_stream, jobs.rate_decisions_stream])
def test_a_stopped_query_goes_on(spark, tmp_path, job):
    src, at = str(tmp_path / "in"), str(tmp_path / "query")
    files = [(str(i), made(i)) for i in range(4)]
    landed(spark, src, files[:2])
    first = decided(job(stream(spark, src), limits(spark), at=at))
    assert first == batch_twin(spark, files[0][1] + files[1][1])
    landed(spark, src, files[2:])
    every = decided(job(stream(spark, src), limits(spark), at=at))
    assert every == batch_twin(spark, [r for _, rows in files for r in rows])
    assert {k: every[k] for k in first} == first


def test_a_failed_batch_is_run_again(spark, tmp_path, monkeypatch):
    src, at = str(tmp_path / "in"), str(tmp_path / "query")
    files = [(str(i), made(i)) for i in range(3)]
    landed(spark, src, files)
    plain, calls = jobs.rate_windows, []

    def failing(rows):  # the output of the second batch is written, its counts are not
        calls.append(1)
        if len(calls) == 2:
            raise ValueError("killed")
        return plain(rows)

    monkeypatch.setattr(jobs, "rate_windows", failing)
    with pytest.raises(Exception, match="killed"):
        jobs.rate_decisions_stream(stream(spark, src), limits(spark), at=at)
    monkeypatch.setattr(jobs, "rate_windows", plain)
    assert decided(jobs.rate_decisions_stream(stream(spark, src), limits(spark), at=at)) == batch_twin(spark, [r for _, rows in files for r in rows])


def test_late_and_future_requests(spark, tmp_path):
    """Refused with a reason, and no other window is touched by them."""
    src, at = str(tmp_path / "in"), str(tmp_path / "query")
    far = dt.datetime.now() + dt.timedelta(days=4000)
    landed(spark, src, [("0", made(0) + [(90_000, "user", "1", far), (90_001, "user", "1", None)]), ("1", made(9)),
                        ("2", [(90_002, "user", "1", BASE), (90_003, "user", "1", BASE + dt.timedelta(days=2)), (90_004, "user", "9", BASE)])])
    got = {r.request_id: r for r in jobs.rate_limiter_stream(stream(spark, src), limits(spark), at=at).collect()}
    assert [got[i].reason for i in (90_000, 90_001, 90_002)] == ["future", "no time", "late"]
    assert not any(got[i].allowed or got[i].day_count for i in (90_000, 90_001, 90_002))
    assert got[90_003].allowed and got[90_003].day_count == 1 and 90_004 not in got  # a subject without limits
    plain = {i: (r.minute_count, r.day_count, r.allowed) for i, r in got.items() if i < 90_000}
    assert plain == batch_twin(spark, made(0) + made(9))


def test_idle_subjects_are_cleared(spark, tmp_path):
    src, at = str(tmp_path / "in"), str(tmp_path / "query")
    landed(spark, src, [("0", made(0)[:30])])
    once = jobs.rate_limiter_stream(stream(spark, src), limits(spark), at=at, idle=1).count()
    # no request of subject 2 comes before the timer, so its counts start again
    landed(spark, src, [("1", [(5000, "user", "1", BASE)]), ("2", [(5001, "user", "2", BASE)])])
    got = {r.request_id: r.day_count for r in jobs.rate_limiter_stream(stream(spark, src), limits(spark), at=at, idle=1).collect()}
    assert once == 30 and got[5001] == 1


# ------------------------------------------------------------ stored tables
ROW = "k string, part long, value long, at long"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("buckets", [1, 8])
def test_merge(spark, tmp_path, buckets):
    path = str(tmp_path / "t")
    one = [("a", 1, 10, 1), ("a", 2, 20, 1), (None, 1, 30, 1), ("b", None, 40, 1)] + [(f"x{i}", 0, i, 1) for i in range(50)]
    two = [("a", 1, 11, 2), ("c", 1, 50, 2), (None, 1, 31, 2), ("a", 2, 0, 0), ("c", 1, 49, 1), ("c", 1, 50, 2)]

    def put(data, name, **kw):
        return stored.merge(spark.createDataFrame(data, ROW), path, ["k", "part"], name, version="at", buckets=buckets, **kw)

    assert stored.read(spark, path, ROW).count() == 0
    assert put(one, "one") and rows(stored.read(spark, path, ROW)) == sorted(one, key=repr)
    want = sorted([("a", 1, 11, 2), ("a", 2, 20, 1), (None, 1, 31, 2), ("b", None, 40, 1), ("c", 1, 50, 2)] + one[4:], key=repr)

    def crash():
        raise ValueError("killed")

    with pytest.raises(ValueError):
        put(two, "two", before_note=crash)
    assert not stored.merged(spark, path, "two")
    assert put(two, "two") and rows(stored.read(spark, path, ROW)) == want
    state = stored.state(stored.read(spark, path, ROW)).first()
    assert not put(two, "two") and not put(one, "one")
    assert stored.state(stored.read(spark, path, ROW)).first() == state
    assert put(one, "one again")  # the same rows under another name: versions keep the newer ones
    assert stored.state(stored.read(spark, path, ROW)).first() == state
    assert put([], "none") and stored.state(stored.read(spark, path, ROW)).first() == state


def test_merge_keeps_stored_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    for name, data in (("1", [("a", 1, 1, 1)]), ("2", [("a", 1, 2, 9), ("b", 1, 3, 9)])):
        stored.merge(spark.createDataFrame(data, ROW), path, ["k"], name, keep=True)
    assert rows(stored.read(spark, path, ROW)) == [("a", 1, 1, 1), ("b", 1, 3, 9)]


def test_merge_rewrites_only_touched_buckets(spark, tmp_path):
    import glob
    import os

    path = str(tmp_path / "t")
    stored.merge(spark.createDataFrame([(f"x{i}", 0, i, 1) for i in range(200)], ROW), path, ["k"], "1", buckets=16)
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/rows/*/*.parquet")}
    stored.merge(spark.createDataFrame([("x7", 0, 700, 1)], ROW), path, ["k"], "2", buckets=16)
    after = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/rows/*/*.parquet")}
    assert len(before) == 16 and len(set(before.items()) & set(after.items())) == 15
    assert stored.read(spark, path, ROW).where("k = 'x7'").first().value == 700


def test_totals_in_update_mode_go_on(spark, tmp_path):
    event = "event_id string, match_id long, team_id string, type string, outcome string"
    matches = spark.createDataFrame([(i, f"c{i % 2}") for i in range(6)], "match_id long, competition_id string")
    src, at = str(tmp_path / "in"), str(tmp_path / "query")
    every = []
    for file in range(4):
        data = [(f"{file}-{i}", i % 6, f"t{(i + file) % 3}" if i % 4 else None, ["Shot", "Pass"][i % 2], "Goal" if i % 3 == 0 else None) for i in range(60 * (file < 3) + 2)]
        every += data
        spark.createDataFrame(data, event).coalesce(1).write.parquet(f"{src}/{file}")
        if file in (1, 3):
            s = spark.readStream.schema(event).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(src)
            got = jobs.stored_totals(s, matches, at=at)
            want = jobs.metric_totals_stream(spark.createDataFrame(every, event), matches)
            assert rows(got.select(*want.columns)) == rows(want)
    assert len(list((tmp_path / "query/out/batches").iterdir())) >= 4
