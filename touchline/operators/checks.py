"""Answer checking: numbers in answers vs numbers grounded in result rows,
golden-evaluation summaries, cost accounting and SQL-log screening.

All of it is column expressions, explodes, grouped aggregations and one
anti join keyed by answer id with a tolerance predicate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values
NUMBER_PATTERN = r"(?<![A-Za-z])-?\d[\d,]*(?:\.\d+)?%?"
EPSILON = 1e-6
FORBIDDEN_KEYWORDS = (
    "insert", "update", "delete", "merge", "truncate", "drop", "alter", "create", "grant", "revoke",
    "copy", "call", "execute", "vacuum", "analyze", "refresh", "comment", "listen", "notify",
)
FORBIDDEN_SELECT_PATTERNS = (
    r"(?i)\bfor\s+update\b",
    r"(?i)\bfor\s+share\b",
    r"(?i)\bselect\b[\s\S]*\binto\s+(?:temp|temporary|unlogged|table)?\s*[A-Za-z_]",
)
ROW_CAP = 1000
# USD per token (per-million prices / 1e6): input, output, cache read, cache write
PRICES = {"input": 1.0, "output": 5.0, "cache_read": 0.1, "cache_write": 1.25}


def extract_numbers(text: Column) -> Column:
    """Distinct number tokens in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(NUMBER_PATTERN), 0))


def parse_number(token: Column) -> Column:
    return F.regexp_replace(token, "[,%]", "").try_cast("double")


def grounded_numbers(rows: DataFrame, answer_id: str, numeric_cols: list[str], text_cols: list[str]) -> DataFrame:
    """Per answer: every numeric value in its rows, the non-percent numbers
    inside text values, and row count, value count, sum, min, max, average."""
    vals = None
    for c in numeric_cols:
        part = rows.select(answer_id, F.col(c).cast("double").alias("value"))
        vals = part if vals is None else vals.unionAll(part)
    for c in text_cols:
        toks = rows.select(answer_id, F.explode(extract_numbers(F.col(c))).alias("tok")).where(~F.col("tok").endswith("%"))
        part = toks.select(answer_id, parse_number(F.col("tok")).alias("value"))
        vals = part if vals is None else vals.unionAll(part)
    vals = vals.where(F.col("value").isNotNull() & ~F.isnan("value"))
    counts = rows.groupBy(answer_id).agg(F.count(F.lit(1)).cast("double").alias("row_count"))
    agg = vals.groupBy(answer_id).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("value").alias("s"),
                                      F.min("value").alias("mn"), F.max("value").alias("mx"))
    aggs = counts.join(agg, answer_id, "left").select(
        answer_id, F.explode(F.when(F.col("n").isNull(), F.array("row_count")).otherwise(
            F.array("row_count", "n", "s", "mn", "mx", F.col("s") / F.col("n")))).alias("value"))
    return vals.unionAll(aggs)


def verify_grounding(answers: DataFrame, answer_id: str, text: str, grounded: DataFrame,
                     question_numbers: DataFrame | None = None) -> DataFrame:
    """Answer numbers with no match (relative 1e-6, scale max(1, |a|, |b|))
    among the grounded numbers of the same answer (or the question's)."""
    nums = answers.select(answer_id, F.explode(extract_numbers(F.col(text))).alias("number_text"))
    nums = nums.withColumn("x", parse_number(F.col("number_text")))
    pool = grounded if question_numbers is None else grounded.unionAll(question_numbers)
    pool = pool.select(F.col(answer_id).alias("__aid"), F.col("value").alias("__v"))
    scale = F.greatest(F.lit(1.0), F.abs("x"), F.abs("__v"))
    match = (F.col(answer_id) == F.col("__aid")) & (F.abs(F.col("x") - F.col("__v")) <= EPSILON * scale)
    finite = F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") != float("inf"))
    return nums.where(finite).join(pool, match, "left_anti").select(answer_id, "number_text")


def statement_screen(sql_text: Column) -> Column:
    """Empty / multiple_statements / forbidden_keyword / forbidden_select /
    not_select / ok, by keyword tests only (no parse)."""
    t = F.trim(sql_text)
    body = F.regexp_replace(t, r";\s*$", "")
    kw = "(?i)\\b(" + "|".join(FORBIDDEN_KEYWORDS) + ")\\b"
    bad_select = F.lit(False)
    for p in FORBIDDEN_SELECT_PATTERNS:
        bad_select = bad_select | body.rlike(p)
    return (F.when(F.length(t) == 0, "empty")
            .when(body.contains(";"), "multiple_statements")
            .when(body.rlike(kw), "forbidden_keyword")
            .when(bad_select, "forbidden_select")
            .when(~F.lower(body).rlike(r"^(select|with)\b"), "not_select")
            .otherwise("ok"))


def row_cap(requested: Column, rows: Column, cap: int = ROW_CAP) -> tuple[Column, Column]:
    """Effective limit min(requested, cap) and the truncation flag."""
    effective = F.least(F.coalesce(F.floor(requested), F.lit(cap)), F.lit(cap))
    return effective, F.least(rows, effective) >= effective


def token_cost(inp: Column, out: Column, read: Column, write: Column) -> Column:
    """Tokens x unit prices; missing, negative or not finite counts are 0,
    others are rounded to whole tokens (halves up)."""
    def z(c):
        n = c.cast("double")
        return F.when((n >= 0) & (n < float("inf")), F.floor(n + 0.5).cast("double")).otherwise(F.lit(0.0))
    return (z(inp) * PRICES["input"] + z(out) * PRICES["output"] + z(read) * PRICES["cache_read"]
            + z(write) * PRICES["cache_write"]) / 1e6
