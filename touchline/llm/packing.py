"""Packing along a space-filling curve.

Each document's token counts are hashed to a fixed number of dimensions, the
unit vector is projected to three, and the point's Hilbert key orders the
documents: neighbours on the curve share vocabulary. Documents are range
sorted by that key (copies, which share a key, are spread by id), each range
is laid out as one stream of tokens and cut into full sequences. What is left
at the end of a range becomes sequences whose lengths are powers of two, which
need no padding.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Recent, ddl, frame, mix, raw, rows_of, serve, slices, stored

LENGTH = 4096
END_ID = 2
#: Hashed dimensions, projected dimensions, bits of each on the curve.
HASHED, DIMS, ORDER = 1024, 3, 14
#: Tokens wanted in a range of the curve.
RANGE_TOKENS = 8_000_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokens:
    """Token ids of whole texts as little-endian 32-bit bytes.

    The tokenizer lower-cases, then cuts at white space and between letters or
    digits and other signs before it merges. So a text's ids are the ids of its
    parts between white space, one after the other, a point or comma that ends a
    word being a part of its own; parts seen before are looked up."""

    _made: dict[str, "WordTokens"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tok = Tokenizer.from_file(path)
        self.special = [t.content.lower().encode() for t in self.tok.get_added_tokens_decoder().values()]
        ids = self.tok.get_vocab()
        self.ends = np.zeros(max(ids.values()) + 1, bool)  # ids that end a word
        self.ends[[i for piece, i in ids.items() if piece.endswith("</w>")]] = True
        self.parts = Recent(lambda part: self.encode([part])[0], 400_000)
        # the sign stands first, so that a search runs from sign to sign
        self.point, self.comma = (re.compile(rb"[%s](?<=[a-z0-9].)(?=[ \n]|\Z)" % sign) for sign in (b".", b","))

    @classmethod
    def of(cls, path: str) -> "WordTokens":
        serve(cls._made)
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def encode(self, parts: list[bytes]) -> list[bytes]:
        """Ids of parts. Parts of letters are one word each, and a word's last
        id is known by its end mark: many of them go through the tokenizer as
        one text and are told apart again."""
        words = [p.decode() for p in parts]
        letters = [w.isalpha() and (w.isascii() or w.lower().isalpha()) for w in words]
        alone = [i for i, yes in enumerate(letters) if not yes]
        joined = [i for i, yes in enumerate(letters) if yes]
        out: list[bytes] = [b""] * len(parts)
        lines = [joined[i:i + 64] for i in range(0, len(joined), 64)]
        found = self.tok.encode_batch_fast([" ".join([words[i] for i in own]) for own in lines], add_special_tokens=False)
        for own, ids in zip(lines, found):
            ids = np.array(ids.ids, np.int64)
            stop = np.flatnonzero(self.ends[ids]) + 1
            if stop.size != len(own):  # a sign that the tokenizer takes apart
                alone += own
                continue
            data, at = ids.astype("<u4").tobytes(), [0, *(4 * stop).tolist()]
            for i, x, y in zip(own, at, at[1:]):
                out[i] = data[x:y]
        for i, ids in zip(alone, self.tok.encode_batch_fast([words[i] for i in alone], add_special_tokens=False)):
            out[i] = np.array(ids.ids, "<u4").tobytes()
        return out

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        # bytes.lower() touches A-Z only, which the tokenizer lower-cases too
        lowered = [t.lower() for t in texts]
        marked = {i for i, t in enumerate(lowered) if any([x in t for x in self.special])}
        cut = [self.apart(t).split() if i not in marked else [] for i, t in enumerate(lowered)]
        new = list(filterfalse(self.parts.old.__contains__, filterfalse(self.parts.__contains__, set().union(*cut))))
        self.parts.keep_all(new, self.encode(new))
        ids_of = self.parts.__getitem__
        return [b"".join(map(ids_of, own)) if i not in marked else self.of_whole(texts[i]) for i, own in enumerate(cut)]

    def apart(self, text: bytes) -> bytes:
        """A point or comma that ends a word set apart from it."""
        return self.comma.sub(b" ,", self.point.sub(b" .", text))

    def of_whole(self, text: bytes) -> bytes:
        """For texts with the string of a special token, which is that token."""
        return np.array(self.tok.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()


def projection(hashed: int = HASHED, dims: int = DIMS) -> np.ndarray:
    return np.random.default_rng(42).standard_normal((hashed, dims))


def hilbert_keys(cells: np.ndarray, order: int) -> np.ndarray:
    """Position on the Hilbert curve of integer points (one per row), by
    the transpose form: undo the excess rotations from the top bit down, Gray
    code the axes, then interleave the bits."""
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    top = 1 << (order - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            flip = (x[:, i] & q) != 0
            swap = np.where(flip, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] = np.where(flip, x[:, 0] ^ p, x[:, 0] ^ swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(x.shape[0], np.int64)
    q = top
    while q > 1:
        t = np.where((x[:, n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(x.shape[0], np.int64)
    for bit in range(order - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[:, i] >> bit & 1)
    return key


def curve_keys(ids: list[np.ndarray], table: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Hilbert key of each document's hashed, projected unit vector."""
    points = np.zeros((len(ids), table.shape[1]))
    for row, own in zip(points, ids):
        counts = np.bincount(own & np.uint32(table.shape[0] - 1), minlength=table.shape[0])
        row[:] = counts @ table / max(1.0, float(np.sqrt(counts @ counts)))
    side = (1 << order) - 1
    return hilbert_keys(np.rint((np.tanh(points) + 1) / 2 * side), order)


def tokenized(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """``doc_id, curve, spread, doc_tokens, blob``: each row's curve key, a hash
    that spreads copies, its token count with the end id, and its compressed ids."""
    rows = rows_of(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, table = WordTokens.of(path), projection().round(6)
        codec, end = pa.Codec("zstd", compression_level=1), np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            found = [ids + end for ids in words(raw(batch))]
            keys = curve_keys([np.frombuffer(f, "<u4") for f in found], table)
            spread = mix(np.array([zlib.crc32(str(d).encode()) for d in batch.column(0).to_pylist()], np.uint64) + keys.astype(np.uint64))
            yield frame(batch, ["doc_id"], curve=pa.array(keys),
                        spread=pa.array((spread >> np.uint64(33)).astype(np.int64)),
                        doc_tokens=pa.array([len(f) // 4 for f in found], pa.int64()),
                        blob=pa.array([codec.compress(f, asbytes=True) for f in found], pa.binary()))

    return rows.mapInArrow(run, f"doc_id {ddl(rows, 'doc_id')}, curve long, spread long, doc_tokens long, blob binary")


def _cut(batches: Iterator[pa.RecordBatch], length: int, numbered: int) -> Iterator[list[tuple]]:
    """Pieces (doc_id, start, ids, doc_tokens, sequence, offset) of one range."""
    codec, sequence, room = pa.Codec("zstd"), numbered, length
    open_pieces: list[tuple] = []  # of the sequence that is not full yet
    done: list[tuple] = []
    for batch in batches:
        for doc_id, n, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
            ids, start = codec.decompress(blob, decompressed_size=4 * n, asbytes=True), 0
            while start < n:
                take = min(room, n - start)
                open_pieces.append((doc_id, start, ids[4 * start:4 * (start + take)], n, sequence, length - room))
                start, room = start + take, room - take
                if not room:
                    done += open_pieces
                    open_pieces, room, sequence = [], length, sequence + 1
                    if len(done) >= 512:
                        yield done
                        done = []
    left = length - room
    if left:  # the rest of the range: sequences of falling powers of two
        sizes = [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]
        offset = 0
        for doc_id, start, ids, n, _, _ in open_pieces:
            while ids:
                take = min(sizes[0] - offset, len(ids) // 4)
                done.append((doc_id, start, ids[:4 * take], n, sequence, offset))
                ids, start, offset = ids[4 * take:], start + take, offset + take
                if offset == sizes[0]:
                    sizes.pop(0)
                    sequence, offset = sequence + 1, 0
    if done:
        yield done


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
         length: int = LENGTH, end_id: int = END_ID, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """Pieces of all rows in sequences of at most ``length`` tokens.

    Returns ``doc_id, start, length, ids (binary), doc_tokens, sequence_id,
    offset``. A null, empty or blank text is the end id alone. Sequence ids
    are unique: the range's number times 2^32 plus a count. An empty table
    gives no piece; repeated rows are packed once each.
    """
    spark = docs.sparkSession
    ready = stored(tokenized(docs, path, id_col, text_col, end_id))
    total = ready.agg(F.sum("doc_tokens")).first()[0] or 0
    ranges = max(1, int(-(-total // range_tokens)), int(spark.conf.get("spark.sql.shuffle.partitions")) if total > range_tokens else 1)
    laid = ready.repartitionByRange(ranges, "curve", "spread").sortWithinPartitions("curve", "spread", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for done in _cut(batches, length, number):
            cols = list(zip(*done))
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(cols[0], id_type), "start": pa.array(cols[1], pa.int64()),
                "length": pa.array([len(i) // 4 for i in cols[2]], pa.int64()), "ids": pa.array(cols[2], pa.binary()),
                "doc_tokens": pa.array(cols[3], pa.int64()), "sequence_id": pa.array(cols[4], pa.int64()),
                "offset": pa.array(cols[5], pa.int64())})

    id_type = to_arrow_type(ready.schema["doc_id"].dataType)
    return laid.select("doc_id", "doc_tokens", "blob").mapInArrow(
        run, f"doc_id {ddl(ready, 'doc_id')}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op5_packing(docs: DataFrame) -> DataFrame:
    return pack(docs, tokenizer_path()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

