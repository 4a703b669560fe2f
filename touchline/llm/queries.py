"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import configure
from ..sources.tables import read_table
from . import licenses, lines, substrings, twins


def _over(table: str, module: str, function: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query that applies an operator's function to a whole table."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from importlib import import_module

        configure(spark)
        return getattr(import_module(f"touchline.llm.{module}"), function)(read_table(spark, sf_dir, table))

    run.__name__ = function
    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": _over("documents", "simhash", "op1_simhash"),
    "op2_fingerprints": _over("documents", "fingerprints", "op2_fingerprints"),
    "op3_secrets": _over("documents", "secrets", "op3_secrets"),
    "op4_substrings": _over("documents", "substrings", "op4_substrings"),
    "op5_packing": _over("documents", "packing", "op5_packing"),
    "op6_language": _over("documents", "langid", "op6_language"),
    "op7_urls": _over("pages", "urls", "op7_urls"),
    "op8_quality": _over("documents", "quality", "op8_quality"),
    "op9_pieces": _over("documents", "pieces", "op9_pieces"),
    "op10_licenses": _over("documents", "licenses", "op10_licenses"),
    "op11_spelling": _over("documents", "spelling", "op11_spelling"),
    "op12_alignment": _over("documents", "alignment", "op12_alignment"),
    "op13_lines": _over("documents", "lines", "op13_lines"),
}

ORACLE: dict[str, str] = {
    "op3_secrets": twins.op3_sql(),
    "op4_substrings": substrings.op4_sql(),
    "op8_quality": twins.op8_sql(),
    "op10_licenses": licenses.op10_sql(),
    "op13_lines": lines.op13_sql(),
}
