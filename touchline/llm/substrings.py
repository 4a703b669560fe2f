"""Substring dedup by compacting the repeated part of the token k-mer graph.

Edges are windows of ``k`` words. Windows of a text that share their least
inner ``SEED``-gram (their seed) follow one another and form one path, so a
path is known by its seed and by the hash of the words it spans. Equal windows
have equal seeds at equal places, wherever they stand.

1. Each text gives one row per path: about a tenth of its windows.
2. Seeds that occur once have no repeated window. A seed whose paths are all
   the same word span does not branch: joined back, each of its paths is one
   repeated span. (Seed and span hash, 64 bits each, must both agree.)
3. A seed with different paths branches. Its paths alone are expanded to
   windows at their source coordinates, which are compared by two 64-bit
   hashes of their words.
4. The spans of a text are united and their words removed.

Rows of one text (copies) share a key of two 64-bit hashes, so spans of a copied
text are collected once; counts are pre-aggregated before every shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BASE, _INVERSE, _powers, gram_hashes, mix, raw, serve, slices, stored, word_hashes

#: Words of a window, and of the seed inside it.
K, SEED = 35, 15
_KEY = ("_t1", "_t2")


def keyed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The table with the text's key, two 64-bit hashes (null: as empty)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({"_t1": F.xxhash64(text), "_t2": F.xxhash64(F.lit("other"), text)})


def span_hashes(words: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of each run of words [first, stop)."""
    up, down = _powers(words.size, BASE, "up"), _powers(words.size, _INVERSE, "down")
    total = np.zeros(words.size + 1, np.uint64)
    np.cumsum(words * up[:words.size], out=total[1:])
    return mix((total[stop] - total[first]) * down[first] + (stop - first).astype(np.uint64))


def paths(texts: list[bytes], k: int = K, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Paths of all texts: (text number, seed, span hash, first window, windows)."""
    words, counts = word_hashes(texts)
    width = k - seed + 1
    ends = np.cumsum(counts)
    if words.size < k:
        none = np.empty(0, np.int64)
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    grams = gram_hashes(words, seed)
    owner = np.repeat(np.arange(len(texts)), counts)
    at = np.arange(words.size - k + 1)
    at = at[owner[at] == owner[at + k - 1]]  # windows inside one text
    least = np.lib.stride_tricks.sliding_window_view(grams, width)[at].argmin(1) + at
    head = np.ones(at.size, bool)
    head[1:] = (least[1:] != least[:-1]) | (owner[at[1:]] != owner[at[:-1]])
    first = np.flatnonzero(head)
    windows = np.diff(np.append(first, at.size))
    start, place = at[first], least[first]
    span = span_hashes(words, start, start + windows + k - 1)
    own = owner[start]
    # the same span can only be one path if the seed stands at one place in it
    span = mix(span + (place - start).astype(np.uint64))
    return own, grams[place], span, start - (ends - counts)[own], windows


def path_rows(rows: DataFrame, text_col: str, k: int, seed: int) -> DataFrame:
    """``seed, span, _t1, _t2, start, windows`` of every path of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve()
        for batch in slices(batches):
            own, node, span, start, windows = paths(raw(batch), k, seed)
            take = pa.array(own)
            yield pa.RecordBatch.from_pydict({
                "seed": pa.array(node.view(np.int64)), "span": pa.array(span.view(np.int64)),
                "_t1": batch.column(1).take(take), "_t2": batch.column(2).take(take),
                "start": pa.array(start.astype(np.int32)), "windows": pa.array(windows.astype(np.int32))})

    picked = rows.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), *_KEY)
    return picked.mapInArrow(run, "seed long, span long, _t1 long, _t2 long, start int, windows int")


def window_rows(rows: DataFrame, k: int) -> DataFrame:
    """Windows ``h, check, _t1, _t2, start, copies`` of the open paths of
    ``rows(text, _t1, _t2, open, copies)``, from the words at their places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve()
        for batch in slices(batches):
            columns: list[list[np.ndarray]] = [[], [], [], []]
            for i, (text, found) in enumerate(zip(raw(batch), batch.column(3).to_pylist())):
                words, _ = word_hashes([text])
                at = np.unique(np.concatenate([np.arange(p["start"], p["start"] + p["windows"]) for p in found]))
                for out, values in zip(columns, (np.full(at.size, i), gram_hashes(words, k)[at], gram_hashes(mix(words + np.uint64(1)), k)[at], at)):
                    out.append(values)
            own, h, check, at = (np.concatenate(c) for c in columns)
            take = pa.array(own)
            yield pa.RecordBatch.from_pydict({
                "h": pa.array(h.view(np.int64)), "check": pa.array(check.view(np.int64)),
                "_t1": batch.column(1).take(take), "_t2": batch.column(2).take(take), "start": pa.array(at.astype(np.int32)),
                "copies": batch.column(4).take(take)})

    return rows.select("text", *_KEY, "open", "copies").mapInArrow(run, "h long, check long, _t1 long, _t2 long, start int, copies long")


def repeated_spans(docs: DataFrame, text_col: str = "text", k: int = K, seed: int = SEED) -> DataFrame:
    """``_t1, _t2, spans``: the word spans [start, stop) of each text (by key)
    that repeated windows cover; texts without any are absent."""
    rows = keyed(docs, text_col)
    found = path_rows(rows, text_col, k, seed)
    # the small side of each join below is written first: both sides then come straight from a
    # shuffle, and Spark can split the rows of a very common seed or window over several tasks
    nodes = stored(found.groupBy("seed").agg(F.count("*").alias("n"), F.min("span").alias("low"), F.max("span").alias("high"))
                   .filter("n > 1").select("seed", (F.col("low") != F.col("high")).alias("branches")))
    tied = stored(found.join(nodes, "seed")
                  .select(*_KEY, "start", "windows", "branches"))
    plain = tied.filter("NOT branches").groupBy(*_KEY).agg(F.collect_set(
        F.struct("start", (F.col("start") + F.col("windows") + (k - 1)).alias("stop"))).alias("spans"))
    opened = tied.filter("branches").groupBy(*_KEY).agg(F.collect_set(F.struct("start", "windows")).alias("open"))
    # each text once, with its number of copies: copies collapse before they are shuffled
    texts = rows.groupBy(*_KEY).agg(F.first(F.coalesce(F.col(text_col), F.lit(""))).alias("text"), F.count("*").alias("copies"))
    windows = stored(window_rows(texts.join(opened.hint("shuffle_hash"), list(_KEY)), k))
    again = stored(windows.groupBy("h", "check").agg(F.sum("copies").alias("n")).filter("n > 1").select("h", "check"))
    edges = windows.join(again, ["h", "check"], "left_semi").groupBy(*_KEY).agg(F.collect_set(
        F.struct("start", (F.col("start") + k).alias("stop"))).alias("spans"))
    return plain.unionByName(edges).groupBy(*_KEY).agg(F.flatten(F.collect_list("spans")).alias("spans"))


def kept_words(words: list[bytes], spans: list[dict] | None) -> tuple[int, bytes]:
    """Number of removed words, and the others joined by spaces."""
    if not spans:
        return 0, b" ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, [s["start"] for s in spans], 1)
    np.add.at(step, [s["stop"] for s in spans], -1)
    stay = np.cumsum(step[:-1]) == 0
    return int(len(words) - stay.sum()), b" ".join([words[i] for i in np.flatnonzero(stay).tolist()])


def remove_repeats(docs: DataFrame, text_col: str = "text", k: int = K, seed: int = SEED) -> DataFrame:
    """The table with repeated words removed from ``text_col`` (words joined
    by one space; a text that loses nothing stays as it is, a null stays null)
    and two more columns, ``_n_words`` and ``_n_removed``. Every occurrence of a
    repeated window goes, the first included; repeated rows repeat each other.
    """
    rows = keyed(docs, text_col).join(repeated_spans(docs, text_col, k, seed).withColumnRenamed("spans", "_spans").hint("shuffle_hash"), list(_KEY), "left")
    names = [c for c in rows.columns if c not in (*_KEY, "_spans")]
    rows = rows.select(*names, "_spans")
    schema = T.StructType([rows.schema[c] for c in names] + [T.StructField("_n_words", T.LongType()), T.StructField("_n_removed", T.LongType())])
    text_at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve()
        for batch in slices(batches, text_col):
            texts, total, gone = [], [], []
            for text, spans in zip(raw(batch, text_col), batch.column(len(names)).to_pylist()):
                words = (text or b"").split()
                n, kept = kept_words(words, spans)
                texts.append(text if not n else kept)
                total.append(len(words))
                gone.append(n)
            columns = [batch.column(i) for i in range(len(names))]
            columns[text_at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=[*names, "_n_words", "_n_removed"])

    return rows.mapInArrow(run, schema)


def op4_substrings(docs: DataFrame) -> DataFrame:
    kept = remove_repeats(docs.select("doc_id", "text"))
    words = F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""), " ")
    return kept.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"),
                       F.sha2(words, 256).alias("kept_sha256"))


def op4_sql(k: int = K) -> str:
    """DuckDB twin: windows as word sequences, counted; words covered by one
    that is counted twice are dropped."""
    return f"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS r,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
starts AS (SELECT r, w, unnest(range(1, len(w) - {k - 2})) AS i FROM words WHERE len(w) >= {k}),
grams AS (SELECT r, i, md5(array_to_string(list_slice(w, i, i + {k - 1}), ' ')) AS g FROM starts),
again AS (SELECT g FROM grams GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {k})) AS j FROM grams SEMI JOIN again USING (g)),
lost AS (SELECT r, list(j) AS js FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
       sha256(coalesce(CASE WHEN js IS NULL THEN array_to_string(w, ' ')
                            ELSE (SELECT string_agg(x, ' ' ORDER BY j) FROM (SELECT unnest(w) AS x, generate_subscripts(w, 1) AS j)
                                  WHERE NOT list_contains(js, j)) END, '')) AS kept_sha256
FROM words LEFT JOIN lost USING (r)"""

