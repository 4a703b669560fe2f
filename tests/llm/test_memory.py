"""What a Python worker and a batch hold."""
import tracemalloc

import numpy as np
import pyarrow as pa

from touchline.llm import langid, packing, simhash
from touchline.llm.common import Recent


def a_model():
    size = len(langid.Lattice(langid.model_path()).pieces)
    return langid.Model(langid.model_path(), ["x"], np.full((size, 1), 1.0 / size))


def test_a_worker_holds_the_lookups_of_one_operator():
    words = packing.WordTokens.of(packing.tokenizer_path())
    assert packing.WordTokens.of(packing.tokenizer_path()) is words
    scorer = langid.Scorer.of(model := a_model())
    assert not packing.WordTokens._made and langid.Scorer.of(model) is scorer
    assert words([b"Some text"])  # who still works with it can
    packing.WordTokens.of(packing.tokenizer_path())
    assert not langid.Scorer._made and packing.WordTokens._made
    assert not list(simhash._link_rows(4)(iter(())))  # a stage without lookups
    assert not packing.WordTokens._made


def test_a_full_lookup_lets_old_entries_go_before_it_copies():
    found = Recent(int, 50_000)
    tracemalloc.start()
    try:
        found.keep_all(range(50_000), [None] * 50_000)
        found.keep_all(range(50_000, 100_000), [None] * 50_000)
        before = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        found.keep(-1, None)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found.old) == 50_000 and len(found) == 1 and found.old[99_999] is None
    assert peak < 1.1 * before


def test_batches_of_long_texts_are_bounded(spark):
    texts = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('abcdefgh', 1250) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": pa.array([batch.num_rows], pa.int64()), "size": pa.array([batch.nbytes], pa.int64())})

    found = texts.mapInArrow(sizes, "rows long, size long").collect()
    assert sum(r["rows"] for r in found) == 3000
    assert max(r["size"] for r in found) < 10 << 20
