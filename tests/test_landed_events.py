"""The landed event files of the totals stream."""

from touchline.plans import streams
from touchline.sources.projections import MatchData
from touchline.streaming import jobs


def test_event_files_follow_the_scan_and_totals_are_whole(spark, md):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, str(16 << 10))
        own = MatchData(spark, md.sf_dir)
        path, files = streams.landed_events(own)
        assert files > streams.EVENT_BATCHES  # were 4 at any size
        assert spark.read.parquet(path).count() == own.events.count()
        got = streams.metric_totals_stream(own).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = jobs.metric_totals_stream(md.events, md.matches).select(*jobs.TOTAL_KEYS, "shots", "goals", "passes", "events").collect()
    assert sorted(got) == sorted(want) and len(got) > 1

