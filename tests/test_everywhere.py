"""Queries over all competitions: equal to their SQL twins, and each competition is there."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from compare import duck, norm_rows  # noqa: E402

from conftest import SMALL  # noqa: E402

NAMES = [
    "possession_break", "goal_buildup", "buildup_xt", "goal_freeze_frame", "goal_timeline", "list_goals", "totals_leaderboard",
    "totals_leaderboard_teams", "event_leaderboard", "event_leaderboard_team_passes", "team_score_goals", "score_goal_leaderboard",
    "list_entities_players", "list_entities_teams", "list_entities", "pitch_counts_to_minute", "pitch_density",
]


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_every_competition(spark, con, name):
    import __spark_entry__ as entry

    df = entry.queries()[f"{name}_all"](spark, SMALL)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(entry.oracle_sql()[f"{name}_all"])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert norm_rows(df.columns, rows) == norm_rows(cols, cur.fetchall())
    bound = con.execute(entry.oracle_sql()[name]).fetchall()
    if "competition_id" in df.columns:
        assert len({r[df.columns.index("competition_id")] for r in rows}) > 1
    assert len(rows) > len(bound)


@pytest.mark.parametrize("name", ["cosine_distance", "glossary_top_k", "semantic_cache_lookup", "semantic_cache_nearest"])
def test_every_vector(spark, con, name):
    import __spark_entry__ as entry

    df = entry.queries()[f"{name}_all"](spark, SMALL)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(entry.oracle_sql()[f"{name}_all"])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert norm_rows(df.columns, rows) == norm_rows(cols, cur.fetchall())
    ids = {r[0] for r in con.execute("SELECT vec_id FROM embeddings").fetchall()}
    if "query_id" in df.columns:
        assert {r[df.columns.index("query_id")] for r in rows} == {i for i in ids if i % 50 == 0}
    else:
        assert {r[df.columns.index("entry_id")] for r in rows} == ids


def test_blocks_and_parts_of_a_search(spark):
    """Many blocks and parts, tied distances and a question without a language."""
    from touchline.operators import vectors as V

    rows = [(i, [float(i % 7 + 1), float(i % 3), 1.0], None if i == 4 else "ab"[i % 2]) for i in range(2_500)]
    e = spark.createDataFrame(rows, "entry_id long, embedding array<double>, language string")
    q = spark.createDataFrame(rows[:9], "query_id long, embedding array<double>, language string")
    got = {}
    for r in V.nearest(e, q, 3, group="language", block_size=2).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.entry_id))
    # equal vectors of the same language repeat every 42 ids
    want = {i: [(n + 1, x) for n, x in enumerate([j for j in range(i % 42, 2_500, 42) if j != 4][:3])] for i in range(9) if i != 4}
    assert {k: sorted(v) for k, v in got.items()} == want
