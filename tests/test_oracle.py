"""Registered queries vs their SQL twins (DuckDB) on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from compare import duck, norm_rows  # noqa: E402

from conftest import SMALL  # noqa: E402

CHECKED = [
    "team_012", "basic_002", "team_009", "temporal_049", "api_football_062", "spadl_actions", "xt_grid",
    "xt_values", "team_016", "vaep_labels_scores", "vaep_goal_score", "shot_geometry", "player_xt_totals",
    "totals_leaderboard", "event_leaderboard", "compare_entities", "recent_matches", "pitch_counts_to_minute",
    "list_goals", "possession_break", "goal_buildup", "goal_timeline", "track_movement", "replay_tracks",
    "elo_walk_forward", "final_ratings", "match_probabilities", "dc_cutoff_stats", "glossary_top_k",
    "verify_grounding", "statement_screen", "rate_decisions", "subscription_state", "list_follows",
    "read_events", "fixture_events_to_events", "map_body_part", "parse_bool", "resolve_entities",
    "table_scan", "upsert", "apply_calibration", "read_lineups", "rate_windows_stream",
    "rate_decisions_stream", "metric_totals_stream", "vaep_labels_concedes", "xt_published_grid",
    "validate_posts", "dimension_reference", "glossary_load", "load_clip_metrics", "cosine_distance",
]


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql_twin(spark, con, name):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, SMALL)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(entry.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert norm_rows(df.columns, rows) == norm_rows(ocols, cur.fetchall())


def test_every_query_has_a_callable_and_oracles_are_known():
    import __spark_entry__ as entry

    qs, sql = entry.queries(), entry.oracle_sql()
    assert len(qs) >= 200
    assert set(sql) <= set(qs)


def test_entry_runs(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() >= 0 and df.columns == ["team_name", "shot_count"]
