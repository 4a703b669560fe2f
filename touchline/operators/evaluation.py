"""Evaluation of answers: expected rows (P4), summary, gate and report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, NumericType, StringType

from ..functions.labels import normalize_entity

#: The relative tolerance, the accuracy to exceed, the cost a question may have.
TOLERANCE, GATE_ACCURACY, COST_GATE = 1e-3, 0.9, 0.05
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")


def _is_id(name: str) -> bool:
    return name.lower() == "id" or name.lower().endswith("_id")


def _number(text: Column) -> Column:
    """A text as a number: thousands signs are left out, blank text is 0, all else null."""
    t = F.trim(F.regexp_replace(text, ",", ""))
    return F.when(t == "", F.lit(0.0)).when(t.rlike(NUMBER), t.try_cast("double"))


def _leaves(name: str, kind: DataType) -> tuple[list[Column], list[Column]]:
    """Arrays of the texts and of the numbers that a column holds."""
    c = F.col(f"`{name}`")
    if isinstance(kind, MapType):
        c, kind = F.map_values(c), ArrayType(kind.valueType)
    values = c if isinstance(kind, ArrayType) else F.array(c)
    inner = kind.elementType if isinstance(kind, ArrayType) else kind
    if isinstance(inner, StringType):
        return [values], [F.transform(values, _number)]
    if isinstance(inner, NumericType):
        return [], [F.transform(values, lambda x: x.cast("double"))]
    return [], []


def row_values(rows: DataFrame, question_id: str = "question_id") -> DataFrame:
    """``question_id, entities, numbers``: the normalised texts and the finite numbers of each row's
    columns but ``id`` and ``*_id``. Texts count as numbers too where they are some."""
    texts, numbers = [], []
    for field in rows.schema.fields:
        if not _is_id(field.name):
            t, n = _leaves(field.name, field.dataType)
            texts, numbers = texts + t, numbers + n

    def joined(parts: list[Column], kind: str) -> Column:
        return F.flatten(F.array(*(F.coalesce(p, F.array().cast(kind)) for p in parts))) if parts else F.array().cast(kind)

    entities = F.array_distinct(F.array_compact(F.transform(joined(texts, "array<string>"), normalize_entity)))
    finite = F.filter(joined(numbers, "array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(question_id, F.filter(entities, lambda e: e != "").alias("entities"), finite.alias("numbers"))


def match_expected(rows: DataFrame, expected: DataFrame, question_id: str = "question_id") -> DataFrame:
    """``question_id, n_rows, matched`` of every question of ``expected``
    (``entities array<string>, values array<double>``): does one of its answer
    rows hold all of its entities and, within the tolerance, all of its values? A question without
    rows does not match, nor one whose expectation has a blank entity or a
    value that is no number."""
    want = expected.select(F.col(question_id).alias("_q"), F.transform(F.coalesce("entities", F.array().cast("array<string>")), lambda e: F.coalesce(
        normalize_entity(e), F.lit(""))).alias("_e"), F.coalesce("values", F.array().cast("array<double>")).alias("_v"))
    sound = ~F.array_contains("_e", "") & F.forall("_v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    joined = want.join(row_values(rows, question_id).withColumn("_row", F.lit(1)), F.col("_q") == F.col(question_id), "left")

    def near(v: Column) -> Column:
        return F.exists("numbers", lambda x: F.abs(x - v) <= TOLERANCE * F.greatest(F.lit(1.0), F.abs(x), F.abs(v)))

    holds = F.col("_row").isNotNull() & sound & F.forall("_e", lambda e: F.array_contains("entities", e)) & F.forall("_v", near)
    return joined.groupBy(F.col("_q").alias(question_id)).agg(F.count("_row").alias("n_rows"), F.coalesce(F.bool_or(holds), F.lit(False)).alias("matched"))


def _share(c: str) -> Column:
    return F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))


def summary(results: DataFrame) -> DataFrame:
    """One row: gate, totals, categories, latency and usage of ``question_id,
    category, passed, grounded, latency_ms, cost_usd`` and token counts (null
    usage counts as 0). Percentiles are exact, by nearest rank."""
    tokens = sum((F.coalesce(F.col(t), F.lit(0)) for t in TOKENS), F.lit(0))
    r = results.select("category", F.coalesce("passed", F.lit(False)).alias("passed"), F.coalesce("grounded", F.lit(False)).alias("grounded"),
                       F.col("latency_ms").cast("double").alias("latency_ms"), F.coalesce("cost_usd", F.lit(0.0)).cast("double").alias("cost"), tokens.cast("double").alias("tokens"))
    counts = [F.count(F.lit(1)).alias("questions"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), _share("passed").alias("accuracy")]
    category = r.groupBy("category").agg(*counts).agg(F.array_sort(F.collect_list(F.struct(  # as many rows as there are categories
        "category", "questions", "passed", "failed", "accuracy"))).alias("categories"))
    p95 = "percentile_disc(0.95) WITHIN GROUP (ORDER BY {})"
    total = r.agg(*counts, F.count_if("grounded").alias("grounded"), F.count_if(~F.col("grounded")).alias("ungrounded"), _share("grounded").alias("traceability"),
                  F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("average_ms"), F.coalesce(F.expr(p95.format("latency_ms")), F.lit(0.0)).alias("p95_ms"),
                  F.coalesce(F.avg("cost"), F.lit(0.0)).alias("average_cost"), F.coalesce(F.expr(p95.format("cost")), F.lit(0.0)).alias("p95_cost"),
                  F.coalesce(F.avg("tokens"), F.lit(0.0)).alias("average_tokens"))
    within = (F.col("average_cost") <= COST_GATE) & (F.col("p95_cost") <= COST_GATE)
    gate = (F.col("accuracy") > GATE_ACCURACY) & (F.col("ungrounded") == 0) & within
    return total.join(category).select(
        F.struct(F.lit(GATE_ACCURACY).alias("required_accuracy"), gate.alias("passed")).alias("gate"),
        F.struct("questions", "passed", "failed", "accuracy", "grounded", "ungrounded", "traceability").alias("totals"), "categories",
        F.struct("average_ms", "p95_ms").alias("latency"),
        F.struct("average_cost", "p95_cost", "average_tokens", F.lit(COST_GATE).alias("cost_gate"), within.alias("cost_within_gate")).alias("usage"))


def write_report(results: DataFrame, path: str) -> None:
    """The summary as one JSON document (``<path>/summary``) and the questions that
    failed or are ungrounded as JSON lines (``<path>/failures``), which may be many."""
    summary(results).coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    bad = ~F.coalesce("passed", F.lit(False)) | ~F.coalesce("grounded", F.lit(False))
    results.where(bad).write.mode("overwrite").json(f"{path}/failures")


def read_report(spark: SparkSession, path: str, results_schema) -> tuple[DataFrame, DataFrame]:
    kind = ("gate struct<required_accuracy:double,passed:boolean>, totals struct<questions:long,passed:long,failed:long,accuracy:double,grounded:long,"
            "ungrounded:long,traceability:double>, categories array<struct<category:string,questions:long,passed:long,failed:long,accuracy:double>>, "
            "latency struct<average_ms:double,p95_ms:double>, usage struct<average_cost:double,p95_cost:double,average_tokens:double,cost_gate:double,cost_within_gate:boolean>")
    return spark.read.schema(kind).json(f"{path}/summary"), spark.read.schema(results_schema).json(f"{path}/failures")
