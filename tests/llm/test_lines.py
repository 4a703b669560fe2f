"""Line dedup against a plain Python version."""
from collections import Counter, defaultdict

import brute
import pytest

from touchline.llm import lines

ENDS = " \t\n\x0b\x0c\r"


def plain(rows, least_docs=10, least_chars=1):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(ENDS))

    held = defaultdict(set)
    for r, (_, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            held[key(line)].add(r)
    shared = {k for k, d in held.items() if len(d) >= least_docs and len(k) >= least_chars}
    out = Counter()
    for d, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if key(x) not in shared]
        out[(d, len(own), len(own) - len(kept), brute.sha("\n".join(kept)))] += 1
    return out


@pytest.fixture(params=["small_docs", "odd_docs"])
def docs(request):
    return request.getfixturevalue(request.param)


def test_lines(docs, texts):
    assert Counter(tuple(r) for r in lines.op13_lines(docs).collect()) == plain(texts(docs))


ROWS = ([(i, f"Shared Line \n own {i}\n\n\x0bSHARED line\r\nonly nine" if i < 9 else f"  shared line\nown {i}\n") for i in range(12)]
        + [(None, "shared LINE\nnull id"), (None, None), (3, ""), (4, "É line\nend"), (5, "é line\x1c"), (5, "é line\x1c"), (6, "\n" * 20_000 + "shared line")]
        + [(50 + i, "é Line") for i in range(10)] + [(70 + i, " é line") for i in range(9)] + [(90, "shared line") for _ in range(300)])


@pytest.mark.parametrize("shares", [lines.SHARES, 2])
def test_lines_by_hand(spark, shares):
    """Ends, case, thresholds, repeated rows; few shares salt the common keys."""
    df = spark.createDataFrame(ROWS, "doc_id int, text string").repartition(4)
    got = lines.drop_lines(df, shares=shares)
    have = Counter((r.doc_id, r._n_lines, r._n_dropped, brute.sha(r.text or "")) for r in got.collect())
    assert have == plain(ROWS)
    assert sum(n for k, n in have.items() if k[2]) > 300


def test_lines_parameters(spark):
    df = spark.createDataFrame(ROWS, "doc_id int, text string")
    for docs, chars in ((2, 1), (10, 8), (10**6, 1), (1, 1)):
        got = lines.drop_lines(df, least_docs=docs, least_chars=chars).collect()
        assert Counter((r.doc_id, r._n_lines, r._n_dropped, brute.sha(r.text or "")) for r in got) == plain(ROWS, docs, chars)


def test_lines_columns(odd_docs, no_docs):
    out = lines.drop_lines(odd_docs)
    assert out.columns == [*odd_docs.columns, "_n_lines", "_n_dropped"] and out.count() == odd_docs.count()
    assert lines.op13_lines(no_docs).count() == 0 and lines.drop_lines(no_docs).count() == 0
    renamed = odd_docs.withColumnRenamed("text", "r1").withColumnRenamed("host", "at").withColumnRenamed("doc_id", "row")
    assert Counter(r.r1 for r in lines.drop_lines(renamed, "row", "r1").collect()) == Counter(r.text for r in out.collect())
    assert [r.text for r in out.filter("doc_id = 0").collect()] == [None]


def test_texts_are_not_sorted_to_lose_their_lines(spark):
    from touchline.llm.lines import drop_lines

    docs = spark.createDataFrame([(i, f"same\nown {i}") for i in range(12)], "doc_id long, text string")
    found = drop_lines(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin [r1" not in plan
    assert {r.text for r in found.collect()} == {f"own {i}" for i in range(12)}
