"""The pipeline, stage by stage, against brute force on the smallest table."""
import hashlib

import brute
import pytest

import corpus_pipeline
from touchline.llm import langid, packing

NAMES = [name for name, _ in corpus_pipeline.STAGES]


@pytest.fixture(scope="module", params=["small_docs", "odd_docs"])
def stages(request, spark, tmp_path_factory):
    docs = request.getfixturevalue(request.param)
    found = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, found[-1], conftest_dir()).write.parquet(path)
        found.append(spark.read.parquet(path))
    return found


def conftest_dir():
    return "/root/testdata/sf0.001"


def rows_sorted(found):
    return sorted(found, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def rows(df):
    return rows_sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_columns(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns
    for df in stages[3:5]:
        assert df.filter("n_chars <> length(text)").count() == 0


def test_language_stage(stages):
    got = rows(stages[1])
    judged = langid.predict(stages[0], langid.fit(stages[0])).select("doc_id", "text", "lang_pred", "score").collect()
    assert got == sorted(((r.doc_id, r.text) for r in judged if r.lang_pred != "und"),
                         key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    plain = [r for r in rows(stages[0]) if r[1] and len(r[1]) > 400 and sum(c.isalpha() for c in r[1]) > 300 and r[1][0] != "x"]
    assert len(plain) == len([r for r in plain if r in got])


def test_language_stage_without_labels(spark):
    df = spark.createDataFrame([(1, "a plain text", None), (2, None, None), (3, "7", None)], "doc_id long, text string, lang string")
    assert rows(corpus_pipeline.language(spark, df, "")) == [(1, "a plain text"), (3, "7")]


def test_near_duplicate_stage(stages):
    before = sorted({(d is None, d or 0, hashlib.md5(f"{chr(1) if d is None else d}\0{t}".encode()).hexdigest(), t) for d, t in rows(stages[1])})
    own = brute.components({i: brute.simhash(r[3]) for i, r in enumerate(before)})
    assert rows(stages[2]) == rows_sorted((None if r[0] else r[1], r[3]) for i, r in enumerate(before) if own[i] == i)


def test_near_duplicates_lose_no_text(spark):
    """Shared and null ids, copies under one id, under others and under none."""
    a, b, c = ("the quick brown fox jumps over a lazy dog " * 3, "all the world is a stage and all the men " * 3, "to be or not to be that is the question " * 3)
    data = [(1, a), (1, b), (3, c), (None, a), (None, "a text of its own without an id " * 4), (1, a), (2, b), (None, None), (9, "")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = rows(corpus_pipeline.near_duplicates(spark, df, ""))
    assert got == rows_sorted([(1, a), (1, b), (3, c), (None, "a text of its own without an id " * 4), (9, "")])


def test_near_equal_labels_lose_no_text(spark, small_docs):
    from pyspark.sql import functions as F

    split = small_docs.withColumn("lang", F.when(F.col("lang").isNotNull(), F.concat("lang", F.lit("-"), (F.col("doc_id") % 2).cast("string"))))
    kept = corpus_pipeline.language(spark, split, "").count()
    assert kept == corpus_pipeline.language(spark, small_docs, "").count() == small_docs.filter("text RLIKE '\\\\p{L}'").count()


def test_passage_stage(stages):
    before = rows(stages[2])
    want = []
    for (d, t), (n, gone, kept) in zip(before, brute.remove_repeats(before)):
        if not gone:
            want.append((d, t))
        elif gone < n:
            want.append((d, kept))
    assert rows(stages[3]) == want


def test_secret_stage(stages):
    before, after = dict(rows(stages[3])), dict(rows(stages[4]))
    assert before.keys() == after.keys()
    for d, t in before.items():
        spans = brute.base_spans(t)
        assert not brute.base_spans(after[d])
        assert (t == after[d]) or "[secret]" in after[d]
        assert not spans or t != after[d]


def test_packing_stage(stages):
    words = packing.WordTokens(packing.tokenizer_path())
    want = sum(len(i) // 4 + 1 for i in words([t.encode() for _, t in rows(stages[4])]))
    assert stages[5].groupBy().sum("length").first()[0] == want
    assert NAMES == ["language_id", "near_duplicates", "repeated_passages", "secret_scan", "packing"]


def test_empty(spark, no_docs, tmp_path):
    df = no_docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, df, "").write.parquet(str(tmp_path / str(i)))
        df = spark.read.schema(stage(spark, df, "").schema).parquet(str(tmp_path / str(i)))
        assert df.count() == 0


def test_run(spark):
    pieces = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert pieces.count() > 0
