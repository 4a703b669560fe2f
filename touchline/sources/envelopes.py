"""Landed JSON of any of the providers' shapes -> records and rejects.

A file is one of: one JSON value a line (records, arrays or envelopes), or one
value over many lines (pretty-printed). An envelope is an object with
``errors`` and ``response``; errors that are not empty refuse the page, whatever
the response holds. Lines are read in parallel; only files with a line that is no
JSON value on its own are put together again, by file, and only up to
:data:`MOST_BYTES`. If such a file is no JSON value as a whole, its lines stand for
themselves, so one broken line does not lose the others.

Nothing is guessed: text that is not JSON, an element that is no object, a value of
another type than the schema's, and a record without a required field are
rejects with their file, reason and the start of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: JSON as it is defined; unlike a parse to a variant, which ends at 128 MB, for texts of any size.
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
SHOWN = 200
CORRUPT = "_corrupt"


def _is_value(text: Column) -> Column:
    """A whole JSON object or array, and nothing after it: the parser stops at
    the end of a value, so the text must also be one value inside a list and an object."""
    inside = (F.concat(F.lit("["), text, F.lit("]")), F.concat(F.lit('{"v":'), text, F.lit("}")))
    return (F.ltrim(text).rlike(r"^[\[{]") & F.from_json(inside[0], "array<string>", STRICT).isNotNull()
            & F.from_json(inside[1], "v string", STRICT)["v"].isNotNull())


def values(spark: SparkSession, path: str, most_bytes: int | None = None) -> DataFrame:
    """``path, text``: the JSON values of all files at any depth, and the lines that are
    none. A caller may have files over ``most_bytes`` read line by line only."""
    meta = {"path": "file_path", "size": "file_size", "start": "file_block_start"}
    lines = (spark.read.option("recursiveFileLookup", "true").text(path)
             .select("value", *(F.col(f"_metadata.{m}").alias(c) for c, m in meta.items()))
             .withColumn("n", F.monotonically_increasing_id()).where(F.trim("value") != ""))
    small = F.lit(True) if most_bytes is None else F.col("size") <= most_bytes
    parted = lines.groupBy("path", "size").agg(F.bool_and(_is_value(F.col("value"))).alias("by_line")).where(
        ~F.col("by_line") & small).select("path")
    own = lines.join(parted, "path", "left_anti").select("path", F.col("value").alias("text"))
    # lines of a file come in order inside a block, and blocks by where they start
    blocks = _put(lines.join(parted, "path", "left_semi"), ("path", "start"), "n", "value")
    whole = _put(blocks, ("path",), "start", "text")
    joined = whole.select("path", F.explode(F.when(_is_value(F.col("text")), F.array("text")).otherwise(F.split("text", "\n"))).alias("text"))
    return own.unionByName(joined)


def _put(parts: DataFrame, by: tuple[str, ...], order: str, text: str) -> DataFrame:
    """``by`` and the ``text`` of all parts, in their order, a line end between them."""
    listed = parts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("parts"))
    return listed.select(*by, F.array_join("parts.t", "\n").alias("text"))


def _elements(spark_values: DataFrame) -> DataFrame:
    """``path, element, reason``: the records' texts, or why there are none."""
    text = F.ltrim("text")
    env = F.from_json("text", "errors string, response array<string>")
    v = spark_values.withColumn("kind", F.when(~_is_value(F.col("text")), "none").when(text.startswith("["), "list").when(
        F.array_contains(F.json_object_keys("text"), "response") | F.array_contains(F.json_object_keys("text"), "errors"), "envelope").otherwise("one"))
    v = v.withColumn("env", F.when(F.col("kind") == "envelope", env))
    errors = F.regexp_replace(F.coalesce("env.errors", F.lit("")), r"\s", "")
    refused = (F.col("kind") == "envelope") & ~errors.isin("", "[]", "{}", "null")
    none = F.array().cast("array<string>")
    found = (F.when(refused | (F.col("kind") == "none"), F.array(F.lit(None).cast("string")))
             .when(F.col("kind") == "list", F.coalesce(F.from_json("text", "array<string>"), none))
             .when(F.col("kind") == "envelope", F.coalesce("env.response", none)).otherwise(F.array("text")))
    reason = F.when(F.col("kind") == "none", F.lit("not JSON")).when(refused, F.concat(F.lit("errors: "), F.col("env.errors")))
    return v.select("path", "text", reason.alias("reason"), F.posexplode(found).alias("place", "element"))


def parsed(spark: SparkSession, path: str, schema: StructType, required: tuple[str, ...] = (), most_bytes: int | None = None) -> DataFrame:
    """``path, place, record, reason, text``: every record (reason null) and every reject."""
    with_corrupt = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    rows = _elements(values(spark, path, most_bytes))
    rows = rows.withColumn("record", F.from_json("element", with_corrupt, {"columnNameOfCorruptRecord": CORRUPT}))
    missing = F.lit(None).cast("string")
    for field in reversed(required):
        missing = F.when(F.col(f"record.{field}").isNull(), F.lit(f"no {field}")).otherwise(missing)
    reason = (F.when(F.col("reason").isNotNull(), F.col("reason"))
              .when(F.col("element").isNull() | ~F.ltrim("element").startswith("{"), F.lit("not a record"))
              .when(F.col(f"record.{CORRUPT}").isNotNull(), F.lit("wrong type")).otherwise(missing))
    return rows.select("path", "place", "record", reason.alias("reason"), F.coalesce("element", "text").alias("text"))


def records(spark: SparkSession, path: str, schema: StructType, required: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``schema`` with ``__path`` and ``__place`` (in its value)."""
    good = parsed(spark, path, schema, required).where(F.col("reason").isNull())
    return good.select(*(F.col(f"record.`{f.name}`").alias(f.name) for f in schema.fields), F.col("path").alias("__path"), F.col("place").alias("__place"))


def rejects(spark: SparkSession, path: str, schema: StructType, required: tuple[str, ...] = ()) -> DataFrame:
    """``path, reason, text`` (its start) of what is no record."""
    bad = parsed(spark, path, schema, required).where(F.col("reason").isNotNull())
    return bad.select("path", "reason", F.substring("text", 1, SHOWN).alias("text"))
