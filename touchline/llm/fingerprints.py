"""Document fingerprints: one-permutation MinHash, densified, in packed bits.

Each word shingle is hashed once; its top bits choose one of ``bins`` bins and
the least remaining value stays in each bin. An empty bin copies the value of
a filled bin drawn by a hash of (bin, attempt) that all documents share
(optimal densification). The low ``bits`` bits of each bin are packed. Equal
shingle sets give equal fingerprints, and the share of equal bins, corrected
for chance agreement of ``bits`` bits, estimates the Jaccard likeness.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import ddl, frame, gram_hashes, mix, raw, rows_of, slices, word_hashes

SHINGLE, BINS, BITS = 5, 512, 4
#: Documents handled together; their number in a slice fits the sort key.
_GROUP = 256


def _empty_sources(bins: int, attempts: int = 64) -> np.ndarray:
    """Shared draws: the bin that empty bin ``i`` tries at each attempt."""
    i = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(0x1F3D5B79)
    a = np.arange(1, attempts + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    return (mix(i + a) % np.uint64(bins)).astype(np.int64)


_DRAWS: dict[int, np.ndarray] = {}


def densify(values: np.ndarray, filled: np.ndarray) -> None:
    """Fill the empty bins of one document in place."""
    bins = values.size
    draws = _DRAWS.setdefault(bins, _empty_sources(bins))
    empty = np.flatnonzero(~filled)
    for attempt in range(draws.shape[1]):
        source = draws[empty, attempt]
        good = filled[source]
        values[empty[good]] = values[source[good]]
        empty = empty[~good]
        if not empty.size:
            return
    have = np.flatnonzero(filled)  # few are filled: the one that comes first in the empty bin's own shared order
    order = mix(empty.astype(np.uint64)[:, None] << np.uint64(32) | have.astype(np.uint64)[None, :])
    values[empty] = values[have[order.argmin(1)]]


def sketches(texts: list[bytes], shingle: int = SHINGLE, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """Bin values of each text (one row each), and whether it has any word."""
    out = np.zeros((len(texts), bins), np.uint64)
    some = np.zeros(len(texts), bool)
    shift = np.uint64(int(bins).bit_length() - 1)
    for at in range(0, len(texts), _GROUP):
        part = texts[at:at + _GROUP]
        words, counts = word_hashes(part)
        ends = np.cumsum(counts)
        some[at:at + len(part)] = counts > 0
        grams = gram_hashes(words, shingle)
        owner = np.repeat(np.arange(len(part)), counts)
        inside = owner[:grams.size] == owner[shingle - 1:] if grams.size else np.empty(0, bool)
        grams, owner = grams[inside], owner[:grams.size][inside]
        short = [(j, gram_hashes(words[ends[j] - n:ends[j]], n)[0]) for j, n in enumerate(counts.tolist()) if 0 < n < shingle]
        if short:  # fewer words than a shingle: the whole sequence counts as one
            grams = np.concatenate([grams, np.array([h for _, h in short], np.uint64)])
            owner = np.concatenate([owner, np.array([j for j, _ in short])])
        if not grams.size:
            continue
        # document (8 bits) | bin | value: the first of each (document, bin) after a sort is its minimum
        rest = np.uint64(56) - shift
        key = owner.astype(np.uint64) << np.uint64(56) | grams >> np.uint64(8)
        key.sort()
        cell = (key >> rest).astype(np.int64)
        head = np.concatenate(([True], cell[1:] != cell[:-1]))
        cell, value = cell[head], key[head] & ((np.uint64(1) << rest) - np.uint64(1))
        doc, slot = cell // bins, cell % bins
        filled = np.zeros((len(part), bins), bool)
        filled[doc, slot] = True
        block = np.zeros((len(part), bins), np.uint64)
        block[doc, slot] = value
        for j in np.flatnonzero(filled.any(1) & ~filled.all(1)).tolist():
            densify(block[j], filled[j])
        out[at:at + len(part)] = block
    return out, some


def low_bits(values: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Low bits of each bin's value, hashed with the bin's number: a value that
    densification copied to several bins agrees by chance in each on its own."""
    own = np.arange(values.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mix(values + own) & np.uint64((1 << bits) - 1)).astype(np.uint8)


def packed(low: np.ndarray, bits: int = BITS) -> list[bytes]:
    """Rows of low bits as byte strings, most significant bit first."""
    one = np.unpackbits(low[:, :, None], axis=2)[:, :, 8 - bits:].reshape(low.shape[0], -1)
    return [row.tobytes() for row in np.packbits(one, axis=1)]


def likeness(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Jaccard estimate of rows of low bits, freed of chance agreement. Two
    texts without words are alike, one without words is unlike any other."""
    chance = 2.0 ** -bits
    same = (a == b).mean(1)
    found = np.clip((same - chance) / (1 - chance), 0.0, 1.0)
    return np.where(some_a & some_b, found, (some_a == some_b).astype(float))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                shingle: int = SHINGLE, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """``doc_id, fingerprint`` (binary, ``bins * bits / 8`` bytes): one row per
    input row. Null, empty and wordless texts have a fingerprint of zeros."""
    rows = rows_of(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values, _ = sketches(raw(batch), shingle, bins)
            yield frame(batch, ["doc_id"], fingerprint=pa.array(packed(low_bits(values, bits), bits), pa.binary()))

    return rows.mapInArrow(run, f"doc_id {ddl(rows, 'doc_id')}, fingerprint binary")


# ---------------------------------------------------------------- neighbours in id order

#: Rows wanted in a bucket of consecutive ids, and the most buckets.
BUCKET_ROWS, MOST_BUCKETS = 1_000, 20_000


def in_order(rows: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows(doc_id, text)`` in buckets of consecutive ids, one shuffle: quantiles
    of doc_id are the bucket bounds, each bucket is sorted in one partition,
    and the row at a bound is also sent to the bucket before it (the first row
    of all to the last bucket) with ``guest`` true, as that bucket's end. Texts
    travel compressed."""
    total = rows.count()
    wanted = min(max(1, total // bucket_rows), MOST_BUCKETS)
    cuts = rows.approxQuantile("doc_id", [i / wanted for i in range(1, wanted)], 0.25 / wanted) if wanted > 1 else []
    rough = np.array(sorted({int(c) for c in cuts}), np.int64)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array(pc.drop_null(batch.column(0)).cast(pa.int64()))
            at = np.searchsorted(rough, ids, "right")
            some = np.unique(at)
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int64()), "id": pa.array([ids[at == b].min() for b in some.tolist()], pa.int64())})

    # the least id of each bucket: at most one row per bucket
    found = rows.select("doc_id").mapInArrow(firsts, "bucket long, id long").groupBy("bucket").agg(F.min("id").alias("id")).collect()
    bounds = np.array(sorted(r["id"] for r in found) or [0], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for batch in slices(batches):
            ids = batch.column(0)
            has = np.array(pc.is_valid(ids))
            key = np.array(pc.fill_null(ids, int(bounds[0])).cast(pa.int64()))
            bucket = np.where(has, np.searchsorted(bounds, key, "right") - 1, 0)
            at_bound = np.flatnonzero(has & (bounds[bucket] == key))
            texts = raw(batch)
            blobs = [codec.compress(t, asbytes=True) if t else b"" for t in texts]
            take = np.concatenate([np.arange(len(blobs)), at_bound])
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array(np.concatenate([bucket, (bucket[at_bound] - 1) % bounds.size]).astype(np.int32)),
                "guest": pa.array(np.arange(take.size) >= len(blobs)),
                "doc_id": ids.take(pa.array(take)),
                "size": pa.array([len(texts[i]) for i in take.tolist()], pa.int64()),
                "blob": pa.array([blobs[i] for i in take.tolist()], pa.binary())})

    kind = ddl(rows, "doc_id")
    dealt = rows.mapInArrow(run, f"bucket int, guest boolean, doc_id {kind}, size long, blob binary")
    partitions = int(max(1, min(bounds.size, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // 100_000))))
    return dealt.repartition(partitions, "bucket").sortWithinPartitions("bucket", "guest", "doc_id", "blob")


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Groups of (doc_id, text, next text) from rows of :func:`in_order`."""
    codec, held, group, size = pa.Codec("zstd"), None, [], 0
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(5)]
        for bucket, guest, doc_id, n, blob in zip(*cols):
            text = codec.decompress(blob, decompressed_size=n, asbytes=True).decode() if n else ""
            if held is not None:  # a bucket without a guest has no row after its last
                group.append((held[1], held[2], text if held[0] == bucket else ""))
                size += len(held[2])
                if size >= 1 << 20 or len(group) >= _GROUP:
                    yield group
                    group, size = [], 0
            held = None if guest else (bucket, doc_id, text)
    if held is not None:
        group.append((held[1], held[2], ""))
    if group:
        yield group


def edit_and_compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     shingle: int = SHINGLE, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next document.

    The edited text has the last floor(n/4) code points replaced by the first
    as many of the next document in ascending doc_id (after the last: the
    first; rows with one id follow each other in the order of their compressed
    bytes, rows without id come first). One row per input row; a table with one
    row is its own next. Likeness is between 0 and 1.
    """
    rows = rows_of(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _with_next(batches):
            texts = [t for _, t, _ in group]
            edited = []
            for _, text, after in group:
                n = len(text) // 4
                edited.append((text[:len(text) - n] + after[:n]).encode())
            own = [t.encode() for t in texts]
            a, some_a = sketches(own, shingle, bins)
            e, some_e = sketches(edited, shingle, bins)
            # a next text is the following row's own, except at the end of the group or of a bucket
            follows = np.array([i + 1 if i + 1 < len(group) and group[i][2] is group[i + 1][1] else -1 for i in range(len(group))])
            b, some_b = a[follows], some_a[follows]
            rest = np.flatnonzero(follows < 0)
            b[rest], some_b[rest] = sketches([group[i][2].encode() for i in rest.tolist()], shingle, bins)
            a, e, b = low_bits(a, bits), low_bits(e, bits), low_bits(b, bits)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([d for d, _, _ in group]).cast(kind),
                "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in edited]),
                "fingerprint": pa.array([p.hex() for p in packed(a, bits)]),
                "edited_fingerprint": pa.array([p.hex() for p in packed(e, bits)]),
                "near_edited": pa.array(likeness(a, e, some_a, some_e, bits)),
                "near_next": pa.array(likeness(a, b, some_a, some_b, bits))})

    kind = to_arrow_type(rows.schema["doc_id"].dataType)
    return in_order(rows).mapInArrow(
        run, f"doc_id {ddl(rows, 'doc_id')}, n_chars long, edited_sha256 string, fingerprint string, "
             "edited_fingerprint string, near_edited double, near_next double")


def op2_fingerprints(docs: DataFrame) -> DataFrame:
    return edit_and_compare(docs)
