"""The answer cache (A27, O3): answered questions appended to a stored table
with JSON-encoded parts, and looked up by the nearest fresh entry of a language.

Appending always inserts: the same answer in another batch is another entry, and a
row that a batch holds twice is two. A batch that is run again changes
nothing. A lookup returns the whole stored answer, with its JSON parts decoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import stored
from . import vectors as V

#: What an answer brings, as an append takes it and a lookup returns it.
ANSWER = ("question", "embedding", "answer", "generated_sql", "executed_sql", "result_columns", "result_rows", "row_count",
          "truncated", "grounded", "ungrounded_numbers", "glossary", "model", "language")
#: Parts that are stored as JSON text, with the type they are read back as.
JSON_PARTS = {"result_columns": "array<string>", "result_rows": "array<map<string,string>>", "ungrounded_numbers": "array<string>",
              "glossary": "array<map<string,string>>"}
SCHEMA = ("entry_id long, question string, embedding array<float>, answer string, generated_sql string, executed_sql string, "
          "result_columns string, result_rows string, row_count long, truncated boolean, grounded boolean, ungrounded_numbers string, "
          "glossary string, model string, language string, created_at timestamp")


def append(answers: DataFrame, path: str, batch: str, created_at: Column | None = None, before_note=None) -> bool:
    """Store a batch of answers; False if the batch is stored already. An entry's
    id is a hash of the batch, the row and its number among equal rows."""
    made = F.current_timestamp() if created_at is None else created_at
    rows = answers.select(*(F.to_json(c).alias(c) if c in JSON_PARTS else F.col(c) for c in ANSWER), made.alias("created_at"))
    rows = rows.withColumn("row", F.xxhash64(F.lit(batch), *ANSWER))
    again = F.row_number().over(Window.partitionBy("row").orderBy(F.lit(1)))
    rows = rows.withColumn("entry_id", F.xxhash64("row", again)).drop("row")
    fields = [f.strip().split(" ", 1) for f in SCHEMA.split(", ")]
    return stored.merge(rows.select(*(F.col(n).cast(t).alias(n) for n, t in fields)), path, ["entry_id"], batch, keep=True, before_note=before_note)


def entries(spark: SparkSession, path: str) -> DataFrame:
    return stored.read(spark, path, SCHEMA)


def lookup(questions: DataFrame, path: str, now: Column | None = None, threshold: float = V.CACHE_SIMILARITY, max_age_seconds: int = 0) -> DataFrame:
    """The stored answer of the nearest entry of the question's language that is
    at most ``max_age_seconds`` old (0: any age) and at least ``threshold``
    similar: one row or none per question, ``query_id``, ``distance`` and the answer's columns."""
    found = entries(questions.sparkSession, path)
    if max_age_seconds > 0:
        clock = F.current_timestamp() if now is None else now
        found = found.where(F.col("created_at") >= clock - F.make_dt_interval(secs=F.lit(int(max_age_seconds))))
    best = V.cache_lookup(found, questions, threshold)
    answers = found.select("entry_id", "created_at", *(F.from_json(c, JSON_PARTS[c]).alias(c) if c in JSON_PARTS else F.col(c) for c in ANSWER))
    return best.select("query_id", "entry_id", "distance").join(answers, "entry_id")
