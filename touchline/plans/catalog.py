"""Registry of named queries over the projected test tables.

Each registered query is a function ``MatchData -> DataFrame`` and, where the
computation has an SQL equal, its DuckDB-dialect twin (built on the CTEs of
``sql_views``). ``__spark_entry__`` exposes both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import snapshot_id
from ..sources.projections import MatchData
from .sql_views import with_views

QUERIES: dict[str, Callable[[MatchData], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_DATA: dict[tuple[int, str], MatchData] = {}


def register(name: str, sql: str | None = None, views: tuple[str, ...] = (),
             extra: dict[str, str] | None = None):
    """Decorator: register ``fn(md) -> DataFrame`` under ``name``.

    ``sql`` is the body of the SQL twin; ``views`` names the shared CTEs it
    reads and ``extra`` adds statement-local CTEs.
    """

    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql, *views, extra=extra)
        return fn

    return deco


def data_for(spark: SparkSession, sf_dir: str) -> MatchData:
    """One MatchData per (session, folder), so plans share projection objects;
    a new one when the folder's files have changed."""
    key = (id(spark), sf_dir)
    md = _DATA.get(key)
    if md is None or md.spark is not spark or md.token != f"md-{snapshot_id(spark, sf_dir)}":
        md = _DATA[key] = MatchData(spark, sf_dir)
    return md


def as_entry_callable(name: str) -> Callable[[SparkSession, str], DataFrame]:
    fn = QUERIES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(data_for(spark, sf_dir))

    run.__name__ = name
    return run


def load_all() -> None:
    """Import every plan module so its queries register."""
    from . import (accounts, assets, entities, everywhere, forecast, golden, insights, loading, normalize,  # noqa: F401
                   providers, replay, services, stored_tables, streams, tracking_files,  # noqa: F401
                   valuation)
