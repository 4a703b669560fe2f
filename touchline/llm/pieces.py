"""Exact merge-type piece encoding by backtracking, and decoding.

A sequence of pieces is what merging would give exactly when every adjacent
pair re-merges to itself. So a text is read from the left: the longest piece
at the position (Aho-Corasick, one pass over the text) is tried, then its
shorter prefixes, and taken if it is compatible with the piece before it;
where none fits, the last piece is taken back and its end is marked in a
bitfield as a position that leads nowhere. Characters outside the vocabulary
become byte pieces. White space is kept as the meta symbol.

Rules of the model file are read from it: dummy prefix, byte fallback, piece
types and scores. No piece has the meta symbol after another character or
holds a newline (checked when the model is loaded), so merges never cross the
start of a run of spaces or a newline, and chunks cut there are encoded once
and looked up after that.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Recent, ddl, frame, rows_of, slices

META = "▁"
#: Piece types of the model file.
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the top level of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else 4 if kind == 5 else 8
        yield tag >> 3, data[at:at + size]
        at += size


class Pieces:
    """Vocabulary, encoder and decoder of a merge-type model file."""

    _made: dict[str, "Pieces"] = {}

    def __init__(self, path: str):
        import struct

        self.pieces: list[str] = []
        self.rank: dict[str, tuple[float, int]] = {}  # score, id of the pieces that merging can make
        self.byte_id: dict[int, int] = {}
        self.bytes_of: list[bytes] = []
        self.unknown = 0
        options: dict[str, int] = {}
        with open(path, "rb") as f:
            content = f.read()
        for number, value in _fields(content):
            if number == 1:  # a piece: its text, score and type
                part = dict(_fields(value))
                text, score, kind = part[1].decode(), struct.unpack("<f", part.get(2, b"\0\0\0\0"))[0], part.get(3, NORMAL)
                i = len(self.pieces)
                self.pieces.append(text)
                self.bytes_of.append(b"" if kind in (CONTROL,) else text.replace(META, " ").encode())
                if kind == UNKNOWN:
                    self.unknown = i
                    self.bytes_of[i] = " ⁇ ".encode()
                elif kind == BYTE:
                    self.byte_id[int(text[3:5], 16)] = i
                    self.bytes_of[i] = bytes([int(text[3:5], 16)])
                elif kind in (NORMAL, USER):
                    self.rank[text] = (score, i)
            elif number == 2:
                trainer = dict(_fields(value))
                options["model_type"], options["byte_fallback"] = trainer.get(3, 1), trainer.get(35, 0)
            elif number == 3:
                normalizer = dict(_fields(value))
                options |= {"map": len(normalizer.get(2, b"")), "prefix": normalizer.get(3, 1), "squeeze": normalizer.get(4, 1), "escape": normalizer.get(5, 1)}
        if options["model_type"] != 2 or options["map"] or options["squeeze"] or not options["escape"] or not options["prefix"]:
            raise ValueError("only merge-type models that keep white space and add a dummy prefix are supported")
        if any(META in p.lstrip(META) or "\n" in p for p in self.rank):
            raise ValueError("a piece crosses a space or a newline")
        if any(c not in self.rank for p in self.rank for c in p):
            raise ValueError("a character of a piece is no piece")
        self.byte_fallback = bool(options["byte_fallback"])
        self.symbols = {c for p in self.rank for c in p}
        self.automaton = ahocorasick.Automaton()
        for p, (_, i) in self.rank.items():
            self.automaton.add_word(p, (len(p) - 1, i))
        self.automaton.make_automaton()
        self.shorter = {}  # piece id -> its longest proper prefix that is a piece
        for p, (_, i) in self.rank.items():
            cut = next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.rank), None)
            self.shorter[i] = self.rank[cut][1] if cut else None
        self.known = re.compile("[" + "".join(re.escape(c) for c in sorted(self.symbols)) + "]+|[^" + "".join(re.escape(c) for c in sorted(self.symbols)) + "]")
        self.size = [len(p) for p in self.pieces]
        self.start = len(self.pieces)  # stands for the start of a text in a pair
        self.pairs = Recent(self._compatible, 200_000)
        self.chunks = Recent(self._chunk, 200_000)
        self.written = {str(i): b for i, b in enumerate(self.bytes_of)}
        self.cut = re.compile(r" +[^ \n]*|\n[^ \n]*")

    @classmethod
    def of(cls, path: str) -> "Pieces":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    # -- compatibility
    def merged(self, text: str) -> list[str]:
        """Merge a short text: best score first, leftmost of equals."""
        parts = list(text)
        rank = self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = rank.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or found[0] > best):
                    best, at = found[0], i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compatible(self, pair: int) -> bool:
        """Does the pair (first << 20 | second) re-merge to itself?"""
        own = [self.pieces[i] for i in (pair >> 20, pair & 0xFFFFF) if i != self.start]
        return self.merged("".join(own)) == own

    # -- encoding
    def _run(self, text: str) -> list[int]:
        """Pieces of a text whose characters are all in the vocabulary."""
        longest: list[int | None] = [None] * (len(text) + 1)
        for end, (back, i) in self.automaton.iter(text):
            longest[end - back] = i  # matches come by their end, so the longest comes last
        size, shorter, pairs, n = self.size, self.shorter, self.pairs, len(text)
        dead = 0  # bit p: no way from position p to the end
        out: list[int] = []
        at, piece, last = 0, longest[0], self.start
        while at < n:
            if piece is None:  # nothing fits here: give the last piece back
                dead |= 1 << at
                if not out:
                    raise ValueError("the vocabulary is not closed under merging")
                piece = out.pop()
                at -= size[piece]
                last = out[-1] if out else self.start
            end = at + size[piece]
            if not (dead and dead >> end & 1) and pairs[last << 20 | piece]:
                out.append(piece)
                at, last, piece = end, piece, longest[end]
            else:
                piece = shorter[piece]
        return out

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of normalized text without a dummy prefix."""
        if self.symbols.issuperset(chunk):
            return self._run(chunk)
        out: list[int] = []
        for part in self.known.findall(chunk):
            if part[0] in self.symbols:
                out += self._run(part)
            elif self.byte_fallback:
                out += [self.byte_id[b] for b in part.encode()]
            else:
                out.append(self.unknown)
        return out

    def _chunk(self, chunk: str) -> str:
        return ",".join(map(str, self.encode_chunk(chunk.replace(" ", META))))

    def ids_of(self, text: str) -> str:
        """Ids of a text, joined by commas: its chunks' ids, one after the other."""
        if not text:
            return ""
        chunks = self.chunks
        return ",".join([chunks[c] for c in self.cut.findall(" " + text.replace(META, " "))])

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.ids_of(text).split(",")] if text else []

    # -- decoding
    def decode(self, ids: list[int]) -> str:
        """Text of ids: the dummy space of a leading piece goes, bytes that
        form no character become U+FFFD."""
        text = b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if ids and self.pieces[ids[0]][:1] == META else text

    def text_of(self, ids: str) -> str:
        """:meth:`decode` of ids joined by commas."""
        if not ids:
            return ""
        written = self.written
        text = b"".join([written[i] for i in ids.split(",")]).decode("utf-8", "replace")
        return text[1:] if self.pieces[int(ids.partition(",")[0])][:1] == META else text


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids (array<int>)`` of each row's whole text; a null or empty
    text has no ids."""
    rows = rows_of(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces.of(path)
        for batch in slices(batches):
            found = [model.encode(t) for t in batch.column(1).to_pylist()]
            yield frame(batch, ["doc_id"], ids=pa.array(found, pa.list_(pa.int32())))

    return rows.mapInArrow(run, f"doc_id {ddl(rows, 'doc_id')}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of rows of ids; null ids count as none."""
    from pyspark.sql import functions as F

    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces.of(path)
        for batch in batches:
            yield frame(batch, ["doc_id"], text=pa.array([model.decode(i or []) for i in batch.column(1).to_pylist()], pa.string()))

    return rows.mapInArrow(run, f"doc_id {ddl(rows, 'doc_id')}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of the ids and of the decoded text of each row: ``doc_id,
    n_tokens, ids_sha256, decoded_sha256``."""
    rows = rows_of(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces.of(path)
        sha = hashlib.sha256
        for batch in slices(batches):
            count, ids, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                own = model.ids_of(text)
                count.append(own.count(",") + 1 if own else 0)
                ids.append(sha(own.encode()).hexdigest())
                decoded.append(sha(model.text_of(own).encode()).hexdigest())
            yield frame(batch, ["doc_id"], n_tokens=pa.array(count, pa.int64()), ids_sha256=pa.array(ids),
                        decoded_sha256=pa.array(decoded))

    return rows.mapInArrow(run, f"doc_id {ddl(rows, 'doc_id')}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_pieces(docs: DataFrame) -> DataFrame:
    return round_trip(docs, model_path())
