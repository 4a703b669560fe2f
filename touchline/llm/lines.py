"""Line dedup: drop lines that many documents share, in DataFrame functions only.

Every text is split at newlines. A line's key is the line without white space
at its ends and with A-Z lower-cased; keys travel as 128-bit hashes. The
documents that hold a key are counted (each counts once, pre-aggregated before
the shuffle), the keys at or over the threshold are written as a table, and
every line meets that table by its key. What is found goes back to its
document as positions, and the other lines are joined again in order.

Skew: a key that very many lines have is spread over several salted copies of
its table row. How many copies a key has is broadcast for the keys that need
more than one; there are at most :data:`SHARES` of those. Documents meet their
positions by a hash of id and text, so copies of a text do not share a key
unless they share the id too, and then their positions are the same.

Defined cases: each row is a document, also a repeated one or one with a null
id. A null text counts as empty; an empty text is one empty line. An empty key
is never dropped, nor any shorter than ``least_chars``. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: The documents a key must be found in, its least length.
LEAST_DOCS, LEAST_CHARS = 10, 1
#: A key with more than this share of all found lines gets salted copies.
SHARES = 2_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ENDS = " \t\n\x0b\x0c\r"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_keys(text: Column, least_chars: int = LEAST_CHARS) -> Column:
    """An array with one entry a line: the 128-bit hash of its key, null where
    the key is too short."""
    lines = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), "\n")

    def hashed(key: Column) -> Column:
        return F.when(F.length(key) >= max(1, least_chars), F.struct(F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(1), key).alias("k2")))

    return F.transform(F.transform(lines, lambda x: F.trim(x, F.lit(_ENDS))), hashed)


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two hashes that name a row by its id and text, and the text."""
    own = (F.col(id_col), F.col(text_col))
    return docs.select(F.xxhash64(*own).alias("r1"), F.xxhash64(F.lit(1), *own).alias("r2"), F.col(text_col).alias("text"))


def frequent_keys(docs: DataFrame, text_col: str = "text", least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``k1, k2, n_docs`` of the keys found in at least ``least_docs`` rows."""
    held = docs.select(F.explode(F.array_distinct(line_keys(F.col(text_col), least_chars))).alias("k")).filter("k IS NOT NULL")
    return held.groupBy("k.k1", "k.k2").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") >= least_docs)


def dropped_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = LEAST_DOCS,
                      least_chars: int = LEAST_CHARS, shares: int = SHARES) -> DataFrame:
    """``r1, r2, at``: the row by its hashes, and the ascending positions (from
    0) of its lines that go. Rows that lose no line are absent."""
    frequent = stored(frequent_keys(docs, text_col, least_docs, least_chars))
    total = frequent.agg(F.sum("n_docs")).first()[0] or 0
    quota = max(1, -(-total // shares))  # ceiling; at most `shares` keys can hold more than a quota
    copies = F.ceil(F.col("n_docs") / F.lit(quota)).cast("int")
    heavy = F.broadcast(frequent.filter(F.col("n_docs") > quota).select("k1", "k2", copies.alias("copies")))
    salted = frequent.select("k1", "k2", F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt"))
    lines = (_named(docs, id_col, text_col)
             .select("r1", "r2", F.posexplode(line_keys(F.col("text"), least_chars)).alias("at", "k"))
             .filter("k IS NOT NULL").select("r1", "r2", "at", "k.k1", "k.k2")
             .join(heavy, ["k1", "k2"], "left")
             .withColumn("salt", F.pmod(F.hash("r1", "at"), F.coalesce("copies", F.lit(1)))))
    found = lines.join(salted, ["k1", "k2", "salt"]).select("r1", "r2", "at")
    return found.groupBy("r1", "r2").agg(F.sort_array(F.collect_set("at")).alias("at"))


def _without(lines: Column, at: Column) -> Column:
    """Lines that are not at the given ascending positions; the gaps between
    positions become an array of flags, so the work follows the line count."""
    gaps = F.transform(at, lambda p, i: F.concat(
        F.array_repeat(F.lit(False), p - F.coalesce(F.get(at, i - 1), F.lit(-1)) - 1), F.array(F.lit(True))))

    def kept(flags: Column) -> Column:
        return F.filter(lines, lambda _, i: ~F.coalesce(F.get(flags, i), F.lit(False)))

    return F.element_at(F.transform(F.array(F.flatten(gaps)), kept), 1)


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = LEAST_DOCS,
               least_chars: int = LEAST_CHARS, shares: int = SHARES) -> DataFrame:
    """All rows and columns of ``docs`` with shared lines cut from the text, and
    ``_n_lines``, ``_n_dropped`` (long). A null text stays null."""
    names = list(docs.columns)
    rows = docs.toDF(*(f"c{i}" for i in range(len(names))))  # no name of the input can clash with those used here
    own, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    # the positions are the small side: hashed in a task, so that the texts stream by and are not sorted
    cuts = dropped_positions(rows, own, text, least_docs, least_chars, shares).hint("shuffle_hash")
    lines = split_lines(F.col(text))
    kept = F.when(F.col("at").isNull(), F.col(text)).otherwise(F.array_join(_without(lines, F.col("at")), "\n"))
    return rows.withColumns({"r1": F.xxhash64(own, text), "r2": F.xxhash64(F.lit(1), own, text)}).join(cuts, ["r1", "r2"], "left").select(
        *(kept.alias(c) if c == text else F.col(c) for c in rows.columns), F.size(lines).cast("long"),
        F.coalesce(F.size("at"), F.lit(0)).cast("long")).toDF(*names, "_n_lines", "_n_dropped")


def op13_lines(docs: DataFrame) -> DataFrame:
    return drop_lines(docs.select("doc_id", "text")).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op13_sql() -> str:
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT r, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM docs),
keyed AS (SELECT r, i, line, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''), '{_UPPER}', '{_LOWER}') AS k FROM lines),
shared AS (SELECT k FROM keyed WHERE length(k) >= {LEAST_CHARS} GROUP BY k HAVING count(DISTINCT r) >= {LEAST_DOCS}),
judged AS (SELECT r, i, line, shared.k IS NOT NULL AS gone FROM keyed LEFT JOIN shared USING (k)),
put AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM judged GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM docs JOIN put USING (r)"""
