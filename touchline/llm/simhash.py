"""SimHash near-dedup: fingerprints, block joins, Hamming check, components.

A pair that differs in at most ``d`` of 64 bits, cut into ``d + 2`` blocks,
agrees on at least two whole blocks. Every distinct fingerprint is sent to one
bucket per pair of blocks; inside a bucket the Hamming distance decides. A
bucket gives a spanning forest of its links (at most one row per member), not
its pairs, which keeps every connection. Buckets above ``hot`` members are cut
again by more and finer blocks (``2 d`` blocks, of which ``d`` must agree), so
no task holds a bucket that grows with the corpus.

Equal fingerprints (exact copies, empty texts) collapse before the buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, ddl, frame, raw, rows_of, serve, slices, stored

#: Buckets with more members than this are cut by finer blocks.
HOT = 20_000
#: Buckets up to this size are compared by shifted arrays, larger ones by search.
SMALL = 32


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 (seed 42) of the ``k``-word shingles of a lower-cased text; the
    whole word sequence if it is shorter."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    hash_of = xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([hash_of(joined, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-k].tolist()]
    return np.array([hash_of(joined[a:b], 42) for a, b in zip(starts, (ends[k - 1:] - 1).tolist())], np.uint64)


def fingerprint(text: bytes, k: int) -> int:
    """A bit is 1 if it is set in over half of the shingle hashes."""
    h = shingle_hashes(text, k)
    if not h.size:
        return 0
    ones = np.zeros(64, np.int64)
    for part in np.array_split(h, h.size // 4096 + 1):
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > h.size, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``(doc_id, fp)``: the 64-bit SimHash of each row's whole text, as a
    signed long. Null and wordless texts have fingerprint 0."""
    rows = rows_of(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve()
        for batch in slices(batches):
            fp = np.array([fingerprint(t, shingle) for t in raw(batch)], np.uint64)
            yield frame(batch, ["doc_id"], fp=pa.array(fp.view(np.int64)))

    return rows.mapInArrow(run, f"doc_id {ddl(rows, 'doc_id')}, fp long")


def block_keys(bits: int, blocks: int, agree: int, salt: list) -> list:
    """Bucket keys of column ``fp``: one per choice of ``agree`` of ``blocks``."""
    widths = [bits // blocks + (i < bits % blocks) for i in range(blocks)]
    offsets = np.cumsum([0, *widths]).tolist()
    cut = [F.shiftrightunsigned("fp", o).bitwiseAND(F.lit((1 << w) - 1)) for o, w in zip(offsets, widths)]
    return [F.xxhash64(*salt, F.lit(i), *(cut[j] for j in chosen))
            for i, chosen in enumerate(combinations(range(blocks), agree))]


def _forest(fp: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Spanning links of a bucket: each member found is taken out of the rest,
    so tight clusters cost about one pass."""
    links, left = [], np.arange(fp.size)
    while left.size:
        todo, left = [int(left[0])], left[1:]
        while todo and left.size:
            u = todo.pop()
            near = np.bitwise_count(fp[left] ^ fp[u]) <= most
            if near.any():
                hit = left[near]
                left = left[~near]
                links += [(u, v) for v in hit.tolist()]
                todo += hit.tolist()
    return links


def _thin(pairs: np.ndarray) -> list[tuple[int, int]]:
    """Drop links that close a cycle."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    kept = []
    for a, b in pairs.tolist():
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def bucket_links(key: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the buckets of rows sorted by key."""
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(first, key.size))
    small = np.repeat(sizes <= SMALL, sizes)
    size_at = np.repeat(sizes, sizes)
    found = []
    for lag in range(1, min(SMALL, int(sizes.max(initial=1)))):
        i = np.flatnonzero(small[:-lag] & (size_at[:-lag] > lag))
        i = i[key[i] == key[i + lag]]
        i = i[np.bitwise_count(fp[i] ^ fp[i + lag]) <= most]
        found.append(np.stack([i, i + lag], 1))
    links = _thin(np.concatenate(found)) if found else []
    for a, n in zip(first[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        links += [(a + u, a + v) for u, v in _forest(fp[a:a + n], most)]
    at = np.array(links, np.int64).reshape(-1, 2)
    return fp[at[:, 0]], fp[at[:, 1]]


def _link_rows(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve()
        held: list[tuple[np.ndarray, np.ndarray]] = []  # rows of the last key seen, still open

        def out(key, fp):
            a, b = bucket_links(key, fp.view(np.uint64), most)
            return pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

        for batch in batches:
            if not batch.num_rows:
                continue
            key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            last = int(np.searchsorted(key, key[-1]))
            if held and (last or held[0][0][0] != key[0]):
                parts = [*held, (key[:last], fp[:last])]
                yield out(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                held = []
            elif last:
                yield out(key[:last], fp[:last])
            held.append((key[last:], fp[last:]))
        if held:
            yield out(np.concatenate([p[0] for p in held]), np.concatenate([p[1] for p in held]))

    return run


def links(distinct: DataFrame, most: int = 4, hot: int = HOT) -> DataFrame:
    """Links ``(a, b)`` that connect all fingerprints of ``distinct(fp)`` within
    ``most`` bits."""
    buckets = distinct.select(F.explode(F.array(*block_keys(64, most + 2, 2, []))).alias("key"), "fp")
    crowded = stored(buckets.groupBy("key").count().filter(F.col("count") > hot).select("key"))
    cold, fine = buckets, None
    if crowded.head(1):
        cold = buckets.join(crowded, "key", "left_anti")
        blocks = max(2 * most, 2)
        fine = (buckets.join(crowded, "key", "left_semi")
                .select(F.explode(F.array(*block_keys(64, blocks, blocks - max(most, 1), [F.col("key")]))).alias("key"), "fp"))
    parts = []
    for part in (cold, fine):
        if part is not None:
            sorted_rows = part.repartition("key").sortWithinPartitions("key", "fp")
            parts.append(sorted_rows.mapInArrow(_link_rows(most), "a long, b long").distinct())
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 4, most: int = 4, hot: int = HOT) -> DataFrame:
    """One row per input row: ``doc_id, fp, component_id``.

    ``component_id`` is the least doc_id reachable over links of at most
    ``most`` differing bits, the row's own included. Null texts count as empty
    (fingerprint 0, linked like any other); rows with a null id take part and
    get the least non-null id of their component, or null. Repeated rows each
    keep their row. An empty table gives an empty result.
    """
    fps = stored(fingerprints(docs, id_col, text_col, shingle))
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    tied = components(links(distinct.select("fp"), most, hot)).select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(tied, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(rooted.select("fp", "root").join(named, "root").select("fp", "component_id"), "fp")


def op1_simhash(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
