"""Quality rules by host, in DataFrame functions only.

Every document gets counts and rule failures. Failures are summed by host
(pre-aggregated, so a host with a third of all documents is one row), each
host's failure rates are shrunk by a beta prior fitted to the hosts, and the
host's verdict is joined back to its documents. A document is kept if it
passes the base rule and its host is not one that mostly fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: The base rule and the window of repeated words.
LEAST_WORDS, REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
#: A host is rejected if the shrunk rate of a rule reaches this.
HOST_LIMIT = 0.5
#: Rules counted by host: percent of symbols among word characters, and of
#: repeated lines among lines, beside the base rule.
SYMBOL_PERCENT, LINE_PERCENT = 10, 30
RULES = ("failed_base", "failed_symbols", "failed_lines")


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column, window: int = REPEAT_WINDOW) -> Column:
    """Words covered by windows of a word array that occur twice or more.

    Windows are hashed (64 bits). Only texts where a hash repeats are sorted:
    equal neighbours mark repeated windows, and the marked positions' gaps give
    the words they cover.
    """
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window)))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, j: F.least(F.lit(window), F.coalesce(F.get(at, j + 1), p + window) - p))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def marked(rows: Column) -> Column:
        same = F.filter(rows, lambda r, j: (F.get(rows, j - 1)["h"] == r["h"]) | (F.get(rows, j + 1)["h"] == r["h"]))
        return _let(F.sort_array(F.transform(same, lambda r: r["i"])), covered)

    def found(h: Column) -> Column:
        rows = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(rows, marked))

    return F.when(F.size(words) < window + 1, F.lit(0)).otherwise(_let(hashes, found))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``doc_id, host``, counts and rule failures of every row (null text: none)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def shape(w: Column) -> Column:
        return F.struct(F.size(w).alias("n"), repeat_words(w).alias("r"))

    def repeated(x: Column) -> Column:
        return F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))

    counted = rows.select(
        "doc_id", "host", _let(words, shape).alias("w"), _let(lines, repeated).alias("l"),
        F.length(F.translate(text, _SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"))
    n, r = F.col("w.n").cast("long"), F.col("w.r").cast("long")
    return counted.select(
        "doc_id", "host", n.alias("n_words"), "word_chars", "n_symbols", F.col("l.d").cast("long").alias("n_dup_lines"),
        r.alias("n_repeat_words"),
        ((n < LEAST_WORDS) | (100 * r > REPEAT_PERCENT * n)).alias("failed_base"),
        (100 * F.col("n_symbols") > SYMBOL_PERCENT * F.col("word_chars")).alias("failed_symbols"),
        (100 * F.col("l.d") > LINE_PERCENT * F.col("l.n")).alias("failed_lines"))


def host_rates(found: DataFrame, rules: tuple[str, ...] = RULES) -> DataFrame:
    """``host, n_docs``, and the shrunk rate of each rule.

    The prior of a rule has the mean and variance of the hosts' rates (method
    of moments), with a strength between 1 and 10^6; with one host, or equal
    rates, it is the mean itself. Rows without a host form no host.
    """
    hosts = found.filter("host IS NOT NULL").groupBy("host").agg(
        F.count("*").alias("n_docs"), *(F.sum(F.col(r).cast("long")).alias(r) for r in rules))
    hosts = stored(hosts)
    moments = hosts.agg(*(f(F.col(r) / F.col("n_docs")).alias(f"{r}_{k}") for r in rules for k, f in (("mean", F.avg), ("var", F.var_pop)))).first()
    rates = []
    for r in rules:
        mean, var = moments[f"{r}_mean"] or 0.0, moments[f"{r}_var"] or 0.0
        strength = min(max(mean * (1 - mean) / var - 1, 1.0), 1e6) if var > 0 else 1e6
        rates.append(((F.col(r) + mean * strength) / (F.col("n_docs") + strength)).alias(r))
    return hosts.select("host", "n_docs", *rates)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          limit: float = HOST_LIMIT) -> DataFrame:
    """Counts of every row with ``base_failed``, ``host_rejected`` and ``kept``.

    A row without a host is judged by the base rule alone. Repeated rows each
    count and each keep their row; an empty table gives an empty result.
    """
    found = stored(features(docs, id_col, text_col, host_col))
    worst = F.greatest(*(F.col(r) for r in RULES)) if len(RULES) > 1 else F.col(RULES[0])
    hosts = host_rates(found).select("host", (worst >= limit).alias("host_rejected"))
    joined = found.join(hosts, "host", "left")
    rejected = F.coalesce("host_rejected", F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         F.col("failed_base").alias("base_failed"), (~F.col("failed_base") & ~rejected).alias("kept"),
                         rejected.alias("host_rejected"))


def op8_quality(docs: DataFrame) -> DataFrame:
    return judge(docs)
