"""Training-data pipeline over ``documents``.

Five stages, each an operator of ``touchline.llm``: language ID, SimHash
near-dedup, substring dedup, secret scan, packing. A stage takes (spark, docs,
sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as Parquet to
the shared checkpoint folder and reads them back for the next, so a lost
executor costs at most one stage. All stages but the last return the columns
of their input. Columns other than ``doc_id`` and ``text`` are carried along;
``n_chars`` follows the text where the table has it.

Defined cases: a null text has no language, so its row goes in the first
stage; where no document has a label, nothing else goes there, and where
labels are, a text without a letter does (``und``). In the second stage a row is
named by its id and its text, so different texts that share an id, or have none, are
documents of their own. An empty table gives empty stages. Rows of the same id and text
are copies of each other and one of them stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import langid, packing, secrets, simhash, substrings
from touchline.llm.common import stored
from touchline.session import configure
from touchline.sources.tables import read_table


def _with_length(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognised language; a low score alone drops
    none, as labels that are near equal share it."""
    configure(spark)
    model = langid.fit(docs)
    if not model.langs:
        return docs.filter(F.col("text").isNotNull())
    judged = langid.predict(docs, model, lang_out="_lang_pred", score_out="_lang_score")
    return judged.filter(F.col("_lang_pred") != "und").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash component: that of the least id, a
    null id last, then the least digest of id and text."""
    configure(spark)
    # the digest names a row by its id and text, so one key serves the join and the copies
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("\x01")), F.lit("\x00"), F.coalesce("text", F.lit("\x01"))))
    named = docs.select("text", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), digest.alias("digest")).alias("_named"))
    found = simhash.near_duplicates(named, id_col="_named")
    first = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id.digest").alias("_digest")).distinct()
    return docs.withColumn("_digest", digest).join(first, "_digest", "left_semi").dropDuplicates(["_digest"]).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut words that repeated windows cover; a document that loses all its
    words goes."""
    configure(spark)
    cut = substrings.remove_repeats(docs).filter("_n_removed = 0 OR _n_removed < _n_words")
    return _with_length(cut).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mark; all documents stay."""
    configure(spark)
    return _with_length(secrets.redact(docs)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, with their token ids."""
    configure(spark)
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: The first stage is a fitted model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the pieces of the last."""
    configure(spark)
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
