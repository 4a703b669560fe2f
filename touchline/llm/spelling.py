"""Spelling variants: near words by a variable-length gram index.

**Words** are letter runs with A-Z lower-cased, counted over all texts. So that
variants exist in clean text, a run whose CRC-32 with its document id is
divisible by :data:`EDIT_EVERY` loses one code point first.

**Dictionary.** Words are padded at both ends. A gram is in the dictionary if
the gram without its last sign is frequent (at more than a share of all places)
and it is not itself rarer than a 64th of that; so the dictionary has at most
64 x :data:`SHARES` grams of each length, whatever the words are, and may be
broadcast. The shortest grams need no entry.

**Grams of a word.** At each place the longest dictionary gram is taken, and
dropped if an earlier one covers it. A change at one place of the word can only
touch grams near it: before it those whose look-up could reach the place, after
it those that a gram over the place could come to cover. The grams left and
right of these bounds are in every word that is one edit at that place away.

**Lists.** So a near word has the same signs up to the end of the last safe gram
before the place, and from the start of the first one after it, and a length
known up to the kind of edit. A list of the index holds the words with the same
such head and tail, at bounds of their own grams, and length; a word asks one list
a place and kind of edit. The bounds are at most ``2 * longest - 1`` signs apart, so
a word is in few lists. Words of a list are verified by edit distance. A list of more than
:data:`HOT` words is split: its words meet by the word with one sign left out
(or none), which two words one edit apart share, so no list is compared whole.

Defined cases: a null text has no words; a null id counts as an empty string; each row is
a document, also a repeated one; ties are broken by code-point order; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Fixed values of the query: letters, the edited share, the least word, the form's lead.
LETTERS = "A-Za-z\\u00C0-\\u00FF"
EDIT_EVERY, LEAST_LENGTH, LEAST_COUNT, LEAD = 199, 6, 5, 5
#: Lengths of grams; dictionary shares; words of a list that are compared pair by pair.
SHORTEST, LONGEST = 2, 3
SHARES = 2_000
HOT = 300
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HEAD, TAIL = "\x02", "\x03"
_MASK = (1 << 64) - 1


# ---------------------------------------------------------------- words

def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit_every: int | None = EDIT_EVERY,
                least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of the letter runs of all texts; ``edit_every=None`` leaves
    every run as it is."""
    runs = F.split(F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _LOWER), f"[^{LETTERS}]+")
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                        F.explode(F.filter(runs, lambda r: F.length(r) >= least_length)).alias("run"))
    if edit_every is None:
        words = found.select(F.col("run").alias("word"))
    else:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        at = F.pmod(h, F.length("run").cast("long")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        words = found.select(F.when(h % edit_every == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


# ---------------------------------------------------------------- dictionary

def _padded(word: Column, longest: int) -> Column:
    return F.concat(F.lit(HEAD * (longest - 1)), word, F.lit(TAIL * (longest - 1)))


def dictionary(words: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, shares: int = SHARES) -> set[str]:
    """Grams longer than ``shortest`` that words are cut into."""
    padded = words.select(_padded(F.col("word"), longest).alias("w"))
    places = padded.agg(F.sum(F.length("w") - (shortest - 1))).first()[0] or 0
    frequent = max(1, places // shares)
    grams: set[str] = set()
    before: list[str] | None = None
    for size in range(shortest, longest + 1):
        cut = padded.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - (size - 1)),
                                                  lambda i: F.substring("w", i, F.lit(size)))).alias("g"))
        if before is not None:
            cut = cut.filter(F.substring("g", 1, size - 1).isin(before))
        counted = cut.groupBy("g").agg(F.count("*").alias("n"))
        if before is None:
            before = [r.g for r in counted.filter(F.col("n") > frequent).collect()]
        else:
            kept = counted.filter(F.col("n") >= max(1, frequent // 64)).collect()
            grams |= {r.g for r in kept}
            before = [r.g for r in kept if r.n > frequent]
        if not before:
            break
    return grams


class Index:
    """Cuts words into grams and names the lists that hold or answer them."""

    def __init__(self, grams: set[str], shortest: int = SHORTEST, longest: int = LONGEST):
        self.grams, self.shortest, self.longest = grams, shortest, longest
        self.heads = {g[:k] for g in grams for k in range(1, len(g))}
        self.tails = {g[-k:] for g in grams for k in range(1, len(g))}

    def cut(self, w: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Length of the gram looked up at each place of a padded word, and the
        (start, end) of those that no earlier one covers."""
        grams, shortest, longest, n = self.grams, self.shortest, self.longest, len(w)
        sizes, kept, until = [], [], 0
        for p in range(n - shortest + 1):
            size = shortest
            for q in range(min(longest, n - p), shortest, -1):
                if w[p:p + q] in grams:
                    size = q
                    break
            sizes.append(size)
            if p + size > until:
                until = p + size
                kept.append((p, until))
        return sizes, kept

    def safe_before(self, w: str, sizes: list[int], i: int) -> int:
        """Grams that start before this are the same in any word that differs
        from ``w`` at ``i`` or later."""
        for p in range(max(0, i - self.longest + 1), i):
            if p >= len(sizes) or p + sizes[p] > i or i - p < self.shortest or w[p:i] in self.heads:
                return p
        return i

    def covered_after(self, w: str, j: int) -> int:
        """No gram that starts before ``j`` can cover one that ends after this
        in any word that is the same from ``j`` on."""
        for e in range(min(len(w), j + self.longest - 1), j, -1):
            if e - j < self.shortest or w[j:e] in self.tails:
                return e
        return j

    def places(self, w: str) -> Iterator[tuple[int, int, tuple[int, ...], int]]:
        """For each place and kind of edit of a padded word: end of the safe head,
        start of the safe tail, lengths of the words meant, and the number of
        grams that the edit cannot touch."""
        sizes, kept = self.cut(w)
        pad, n = self.longest - 1, len(w)
        after = []
        for j in range(pad, n - pad + 1):
            e = self.covered_after(w, j)
            right = [p for p, end in kept if p >= j and end > e]
            after.append((right[0] if right else n, len(right)))
        for i in range(pad, n - pad + 1):
            p = self.safe_before(w, sizes, i)
            left = [end for start, end in kept if start < p]
            head = left[-1] if left else 0
            tail, more = after[i - pad]
            yield head, tail, (n + 1,), len(left) + more  # one sign more before i
            if i < n - pad:
                tail, more = after[i + 1 - pad]
                yield head, tail, (n, n - 1), len(left) + more  # sign i replaced or left out

    def bound(self, w: str) -> int:
        """Grams that a word and any word one edit away share at least."""
        return min(k for _, _, _, k in self.places(w))

    def lists(self, word: str) -> tuple[list[int], list[int]]:
        """Names (64-bit) of the lists that hold a word, and of those it asks."""
        pad = self.longest - 1
        w = HEAD * pad + word + TAIL * pad
        n = len(w)
        up = [0] * (n + 1)
        for i, c in enumerate(w):
            up[i + 1] = (up[i] * 0x100000001B3 + ord(c) + 1) & _MASK
        down = [0] * (n + 1)
        for i in range(n - 1, -1, -1):
            down[i] = (down[i + 1] * 0x9E3779B97F4A7C15 + ord(w[i]) + 1) & _MASK

        def name(head: int, tail: int, length: int) -> int:
            x = (up[head] * 0xFF51AFD7ED558CCD + down[tail]) & _MASK
            x = ((x ^ x >> 31) * 0xC4CEB9FE1A85EC53 + length * 0x9E3779B1) & _MASK
            x ^= x >> 29
            return x - (1 << 64) if x >> 63 else x

        _, kept = self.cut(w)
        ends, starts = [0, *(e for _, e in kept)], [*(p for p, _ in kept), n]
        held = {name(a, b, n) for a in ends for b in starts if 0 <= b - a <= 2 * self.longest}
        asked = {name(a, b, k) for a, b, lengths, _ in self.places(w) for k in lengths}
        return list(held), list(asked)


# ---------------------------------------------------------------- near words

def near_words(words: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, shares: int = SHARES, hot: int = HOT) -> DataFrame:
    """``word, n, near, near_n`` for every ordered pair of words exactly one
    inserted, deleted or replaced code point apart. ``words`` are distinct
    (``word, n``)."""
    spark = words.sparkSession
    grams = spark.sparkContext.broadcast(dictionary(words, shortest, longest, shares))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(grams.value, shortest, longest)
        for batch in batches:
            found = [index.lists(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([h for h, _ in found], pa.list_(pa.int64())),
                                              pa.array([a for _, a in found], pa.list_(pa.int64()))], ["word", "n", "held", "asked"])

    cut = stored(words.select("word", "n").mapInArrow(run, "word string, n long, held array<long>, asked array<long>"))
    held = cut.select(F.explode("held").alias("list"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    asked = cut.select(F.explode("asked").alias("list"), "word", "n")
    crowded = stored(held.groupBy("list").agg(F.count("*").alias("k")).filter(F.col("k") > hot).select("list"))
    near = F.levenshtein("word", "near", 1) == 1
    if crowded.isEmpty():
        return held.join(asked, "list").filter(near).select("word", "n", "near", "near_n").distinct()
    usual = held.join(crowded, "list", "left_anti").join(asked.join(crowded, "list", "left_anti"), "list")

    def left_out(rows: DataFrame, word: str) -> DataFrame:
        w = F.col(word)
        less = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
        return rows.join(crowded, "list").withColumn("key", F.explode(F.array_distinct(F.concat(F.array(w), less))))

    split = left_out(held, "near").join(left_out(asked, "word"), ["list", "key"])
    out = ["word", "n", "near", "near_n"]
    return usual.filter(near).select(*out).unionByName(split.filter(near).select(*out)).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the last word when forms are followed. Each round doubles
    the way; counts grow by the lead at each step, so there are few rounds."""
    at = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        after = at.select(F.col("word").alias("root"), F.col("root").alias("later"))
        joined = stored(at.join(after, "root", "left").select("word", F.coalesce("later", "root").alias("root"), F.col("later").isNotNull().alias("moved")))
        if joined.filter("moved").isEmpty():
            return joined.select("word", "root")
        at = joined.select("word", "root")


def variants(words: DataFrame, lead: int = LEAD, hot: int = HOT, shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word of ``(word, n)``.

    The form is the near word of largest count (ties: the first in code-point
    order) if that is at least ``lead`` times the word's own, else null; ``lead`` above 1
    makes every way along forms end.
    """
    if lead <= 1:
        raise ValueError("a form must be more frequent than the word")
    near = near_words(words, shortest, longest, hot=hot).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    judged = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "best")
    led = -F.col("best.less") >= lead * F.col("n")
    judged = stored(judged.select("word", "n", "n_near", F.when(led, F.col("best.near")).alias("form"), F.when(led, -F.col("best.less")).alias("form_n")))
    roots = _roots(judged.filter("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op11_spelling(docs: DataFrame) -> DataFrame:
    return variants(stored(word_counts(docs))).select("word", "n", "n_near", "form", "form_n", "root")
