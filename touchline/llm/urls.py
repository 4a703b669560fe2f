"""URL filters in DataFrame functions and Spark ML only.

Host and path rules decide what they fit. The URLs they decide are the labels
of gradient-boosted trees on lexical features (length, depth, digit ratio,
entropy, parameter counts, statistics of the host's suffixes), and the trees
judge the URLs that no rule fits.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: The rules (verdict, host and path).
RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
    ("block", "net/es/"), ("block", "net/fr/"),
)
#: Most labelled URLs that the trees are fitted on, drawn by hash.
SAMPLE = 20_000
#: Labelled URLs that weigh as much as a suffix's own in its block rate.
PRIOR = 20.0
FEATURES = ("n_chars", "host_chars", "path_chars", "labels", "depth", "digit_ratio", "entropy", "params", "query_chars",
            "hyphens", "upper", "has_fragment", "top_rate", "top_seen", "site_rate", "site_seen")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def parse(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, url, host, path``: host and path are empty for a null URL or
    one without ``://``; a null URL counts as empty."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    return rows.select("page_id", "url",
                       F.translate(F.regexp_extract("url", _PARTS, 1), _UPPER, _LOWER).alias("host"),
                       F.regexp_extract("url", _PARTS, 2).alias("path"))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _count(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    def over(chars: Column) -> Column:
        size = F.size(chars).cast("double")
        terms = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + F.aggregate(
            chars, F.lit(0.0), lambda n, x: n + F.when(x == c, 1.0).otherwise(0.0),
            lambda n: n * F.log2(n)))
        return F.log2(size) - terms / size

    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(
        F.element_at(F.transform(F.array(F.split(text, "")), over), 1))


def lexical(parsed: DataFrame) -> DataFrame:
    """Lexical features of :func:`parse` rows, with ``top`` (last host label)
    and ``site`` (last two labels)."""
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    n = F.length(url)
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    return parsed.select(
        "*", n.cast("double").alias("n_chars"), F.length(host).cast("double").alias("host_chars"),
        F.length(path).cast("double").alias("path_chars"), F.size(labels).cast("double").alias("labels"),
        _count(path, "/").cast("double").alias("depth"),
        (_count(url, "0123456789") / F.greatest(n, F.lit(1))).alias("digit_ratio"), _entropy(url).alias("entropy"),
        F.when(query == "", 0.0).otherwise(_count(query, "&") + 1.0).alias("params"),
        F.length(query).cast("double").alias("query_chars"), _count(host, "-").cast("double").alias("hyphens"),
        _count(url, _UPPER).cast("double").alias("upper"), url.contains("#").cast("double").alias("has_fragment"),
        F.substring_index(host, ".", -1).alias("top"), F.substring_index(host, ".", -2).alias("site"))


def suffix_rates(labelled: DataFrame, suffix: str, mean: float) -> DataFrame:
    """Block rate (pulled to the mean) and log count of a suffix among labelled rows."""
    return labelled.groupBy(suffix).agg(F.sum("label").alias("b"), F.count("*").alias("n")).select(
        suffix, ((F.col("b") + PRIOR * mean) / (F.col("n") + PRIOR)).alias(f"{suffix}_rate"),
        F.log1p(F.col("n").cast("double")).alias(f"{suffix}_seen"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """``page_id, host, path, rule, verdict, p_block``: one row per input row.

    ``verdict`` is the rule's, else the trees' (block from a probability of
    0.5). Without labelled URLs of both verdicts no trees can be fitted: the
    verdict is then the only one seen, or allow. ``p_block`` is null for
    URLs that a rule decides.
    """
    verdicts = dict((rule, verdict) for verdict, rule in rules)
    parsed = parse(pages, id_col, url_col).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    blocks = F.col("rule").isin([r for r, v in verdicts.items() if v == "block"])
    rows = stored(lexical(parsed).withColumn("label", F.when(F.col("rule").isNotNull(), blocks.cast("double"))))
    labelled = rows.filter("label IS NOT NULL")
    n, mean = labelled.agg(F.count("*"), F.avg("label")).first()
    ruled = F.when(blocks, "block").otherwise("allow")
    out = ["page_id", "host", "path", "rule"]
    if not n or mean in (0.0, 1.0):
        only = "block" if n and mean == 1.0 else "allow"
        return rows.select(*out, F.when(F.col("rule").isNotNull(), ruled).otherwise(only).alias("verdict"),
                           F.lit(None).cast("double").alias("p_block"))
    known = rows
    for suffix in ("top", "site"):
        known = known.join(suffix_rates(labelled, suffix, mean), suffix, "left")
    known = known.fillna({"top_rate": mean, "top_seen": 0.0, "site_rate": mean, "site_seen": 0.0})
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    draw = F.pmod(F.xxhash64("url", F.lit(7)), F.lit(1 << 20)) < int(min(1.0, sample / n) * (1 << 20))
    train = stored(known.filter(F.col("label").isNotNull() & draw).select("label", *FEATURES))
    model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=20, maxDepth=4, stepSize=0.2,
                          maxBins=64, seed=7).fit(assemble.transform(train))
    open_rows = model.transform(assemble.transform(known.filter("label IS NULL")))
    p = vector_to_array("probability")[1]
    judged = open_rows.select(*out, F.when(p >= 0.5, "block").otherwise("allow").alias("verdict"), p.alias("p_block"))
    decided = rows.filter("label IS NOT NULL").select(*out, ruled.alias("verdict"), F.lit(None).cast("double").alias("p_block"))
    return decided.unionByName(judged)


def op7_urls(pages: DataFrame) -> DataFrame:
    return judge(pages)
