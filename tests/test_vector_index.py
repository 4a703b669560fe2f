"""The vector index against the exact search, on even, clustered and copied vectors."""

import numpy as np
import pytest

from touchline.operators import vector_index as VI
from touchline.operators import vectors as V

SCHEMA = "entry_id long, embedding array<float>, language string, cell string"


def frame(spark, mat, ids=None):
    rows = [(int(i), None if v is None else [float(x) for x in v], "ab"[int(i) % 2] if int(i) % 7 else None, "clash")
            for i, v in zip(range(len(mat)) if ids is None else ids, mat)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def kinds():
    rng = np.random.default_rng(8)
    even = rng.normal(size=(1500, 16))
    centres = rng.normal(size=(30, 16))
    clustered = centres[rng.integers(0, 30, 1500)] + 0.2 * rng.normal(size=(1500, 16))
    copies = np.concatenate([np.repeat(even[:1], 500, axis=0), even[:1000]])  # a third are one vector
    return {"even": even, "clustered": clustered, "copies": copies}


@pytest.mark.parametrize("kind", ["even", "clustered", "copies"])
def test_recall_on_both_ways(spark, tmp_path, kind):
    e = frame(spark, kinds()[kind])
    VI.build(e, str(tmp_path / "i"), keep=("language",), k=5, part=20)
    index = VI.load(spark, str(tmp_path / "i"))
    assert index.entries.count() == e.count() and 1 < len(index.centres) <= VI.MOST_CELLS
    assert int(index.parts.max()) > 1 and index.probes < len(index.centres)
    q = e.where("entry_id % 5 = 0").withColumnRenamed("entry_id", "query_id")
    exact = V.nearest(e, q, 5)
    few = VI.search(index, q, 5).collect()
    many = VI.search(index, q, 5, few=0, block=7).collect()

    def near(rows):
        return {(r.query_id, r["rank"]): (r.entry_id, round(r.distance, 9)) for r in rows}

    assert near(few) == near(many) and len(few) == len(near(few))
    one = VI.recall(VI.search(index, q, 5), exact).first()
    assert one.wanted == 5 * one.questions == 5 * q.count() and one.recall >= 0.9, one
    # all cells give the exact answer
    assert near(VI.search(index, q, 5, probes=10**6).collect()) == near(exact.collect())


def test_groups(spark, tmp_path):
    e = frame(spark, kinds()["clustered"])
    VI.build(e, str(tmp_path / "i"), keep=("language",))
    index = VI.load(spark, str(tmp_path / "i"))
    q = e.where("entry_id % 5 = 0").withColumnRenamed("entry_id", "query_id")
    lang = {r.entry_id: r.language for r in e.collect()}
    for few in (VI.FEW, 0):
        got = VI.search(index, q, 3, group="language", few=few, probes=10**6).collect()
        assert {(r.query_id, r["rank"], r.entry_id) for r in got} == {(r.query_id, r["rank"], r.entry_id) for r in V.nearest(e, q, 3, group="language").collect()}
        assert all(lang[r.query_id] == lang[r.entry_id] is not None for r in got)


def test_vectors_without_direction(spark, tmp_path):
    mat = [[1.0, 0.0], [0.0, 0.0], None, [0.5, 0.5], [float("nan"), 1.0][1:] + [2.0], [3.0, 0.0]]
    e = frame(spark, mat)
    e = e.unionByName(spark.createDataFrame([(9, [1.0, None], "a", "x")], SCHEMA))
    q = e.withColumnRenamed("entry_id", "query_id")
    want = {0, 3, 4, 5}
    assert {r.query_id for r in V.nearest(e, q, 2).collect()} == want == {r.entry_id for r in V.nearest(e, q, 9).collect()}
    VI.build(e, str(tmp_path / "i"))
    index = VI.load(spark, str(tmp_path / "i"))
    got = VI.search(index, q, 9, probes=99).collect()
    assert {r.query_id for r in got} == want == {r.entry_id for r in got}
    from pyspark.sql import functions as F

    d = {r.entry_id: r.d for r in e.select("entry_id", V.cosine_distance(F.col("embedding"), F.array(F.lit(1.0), F.lit(0.0))).alias("d")).collect()}
    assert d[1] is None and d[2] is None and d[9] is None and d[0] == 0.0


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    VI.build(none, str(tmp_path / "none"))
    index = VI.load(spark, str(tmp_path / "none"))
    q = frame(spark, [[1.0, 0.0]]).withColumnRenamed("entry_id", "query_id")
    assert VI.search(index, q, 3).count() == 0 and V.nearest(none, q, 3).count() == 0
    VI.build(frame(spark, [[1.0, 0.0], [0.0, 1.0]]), str(tmp_path / "two"))
    two = VI.load(spark, str(tmp_path / "two"))
    assert VI.search(two, none.withColumnRenamed("entry_id", "query_id"), 3).count() == 0
    assert VI.recall(VI.search(two, q, 1), V.nearest(none, q, 1)).first().recall == 1.0


def test_many_questions_match_few(spark):
    e = frame(spark, kinds()["copies"])
    q = e.where("entry_id % 50 = 0").withColumnRenamed("entry_id", "query_id")

    def rows(**kw):
        return sorted((r.query_id, r["rank"], r.entry_id) for r in V.nearest(e, q, 4, **kw).collect())

    assert rows() == rows(block_size=3)


@pytest.mark.parametrize("name", ["semantic_cache_lookup_index", "vector_index_recall"])
def test_index_queries(spark, name):
    import os
    import sys

    from conftest import SMALL

    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
    from compare import duck, norm_rows

    import __spark_entry__ as entry

    df = entry.queries()[name](spark, SMALL)
    cur = duck(SMALL).execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert norm_rows(df.columns, [tuple(r) for r in df.collect()]) == norm_rows(cols, cur.fetchall())
