"""SentencePiece encoding that keeps the offsets of the original text, and decoding.

The library gives the ids. The normaliser here follows the model's compiled character map, by longest
prefix, and records for every normalised byte the original byte it comes from; the lengths of the pieces
add up to positions in the normalised text, which that record projects to spans of original bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from structdoc.llm.common import trimmed

SPACE = "▁".encode()
#: Characters above which a text is encoded in parts, cut where no piece can reach across.
LONG = 1 << 18


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protobuf message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class CharacterMap:
    """A compiled character map: a double-array trie of source prefixes and their replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist()
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest prefix of data[at:] in the map, and that prefix's length."""
        if not self.units:
            return None
        found, node, units = None, 0, self.units
        step = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        node ^= step(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= step(unit)
            if unit >> 8 & 1:
                found = (units[node] & 0x7FFFFFFF, i + 1 - at)
        if not found:
            return None
        return self.texts[found[0] : self.texts.index(b"\0", found[0])], found[1]


class Codec:
    """A SentencePiece model with its normaliser's alignment."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        self.map, self.dummy, self.squeeze, self.escape = CharacterMap(b""), True, True, True
        pieces, kinds, suffix = [], [], False
        for field, value in _fields(Path(model).read_bytes()):
            if field == 1:
                piece = dict(_fields(value))
                pieces.append(piece[1])
                kinds.append(piece.get(3, 1))
            elif field == 2:
                suffix = bool(dict(_fields(value)).get(24, 0))
            elif field == 3:
                rules = dict(_fields(value))
                self.map = CharacterMap(rules.get(2, b""))
                self.dummy, self.squeeze, self.escape = (bool(rules.get(k, 1)) for k in (3, 4, 5))
        if suffix or 4 in kinds:
            raise ValueError("models with white space as suffix or user-defined symbols aren't supported")
        self.lengths = np.array([1 if k == 6 else 0 if k == 3 else len(p) for p, k in zip(pieces, kinds, strict=True)], dtype=np.int64)
        self.unknown = kinds.index(2)
        whole = all("\u2581" not in p.decode().lstrip("\u2581") for p, k in zip(pieces, kinds, strict=True) if k == 1)
        #: True if a text can be cut before a space that follows another character.
        self.cuts = whole and self.dummy and self.escape and not self.squeeze and not self.map.units

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text and, for each of its bytes and its end, the original position."""
        space = SPACE if self.escape else b" "
        if not text:
            return b"", np.zeros(1, dtype=np.int64)
        if not self.squeeze and not self.map.units:  # nothing but the spaces changes
            data = np.frombuffer(text, dtype=np.uint8)
            times = np.where(data == 32, len(space), 1)
            source = np.repeat(np.arange(len(data), dtype=np.int64), times)
            head = space if self.dummy else b""
            return head + text.replace(b" ", space), np.concatenate([np.zeros(len(head), dtype=np.int64), source, [len(data)]])
        out, source, at, after_space = bytearray(), [], 0, self.squeeze
        parts = []
        while at < len(text):
            got = self.map.longest(text, at)
            if not got:
                n = 1
                while at + n < len(text) and text[at + n] & 0xC0 == 0x80:
                    n += 1
                got = (text[at : at + n], n)
            parts.append((got[0], at, at + got[1]))
            at += got[1]
        if self.squeeze:
            while parts and parts[0][0] == b" ":
                parts.pop(0)
            if not parts:
                return b"", np.zeros(1, dtype=np.int64)
        end = parts[-1][2]
        if self.dummy:
            out += space
            source += [parts[0][1]] * len(space)
        for piece, start, _ in parts:
            while after_space and piece.startswith(b" "):
                piece = piece[1:]
            if piece:
                for byte in piece:
                    new = space if byte == 32 else bytes([byte])
                    out += new
                    source += [start] * len(new)
                after_space = self.squeeze and piece.endswith(b" ")
        if self.squeeze:
            while out.endswith(space):
                end = source[len(out) - len(space)]
                del out[-len(space) :], source[-len(space) :]
        return bytes(out), np.array([*source, end], dtype=np.int64)

    def parts(self, text: str) -> list[str]:
        """A long text in parts that are encoded alike alone, each but the first without the space before it."""
        if len(text) <= LONG or not self.cuts:
            return [text]
        out, at = [], 0
        while len(text) - at > LONG:
            cut = text.find(" ", at + LONG)
            while cut > 0 and text[cut - 1] in " ▁":
                cut = text.find(" ", cut + 1)
            if cut < 0:
                break
            out.append(text[at:cut])
            at = cut + 1
        return [*out, text[at:]] if text[at:] else [*out[:-1], out[-1] + " "]

    def encode(self, text: str) -> tuple[list[int], np.ndarray]:
        """ids, and the original byte positions at which the pieces start, with the last one's end."""
        ids = self.library.encode(text, num_threads=1)
        data = text.encode()
        size = self.lengths[ids] if ids else np.zeros(0, dtype=np.int64)
        if self.unknown in ids:
            size = np.array([n if i != self.unknown else len(p.encode()) for n, i, p in zip(size.tolist(), ids, self.library.encode(text, out_type=str), strict=True)])
        normal, source = self.normalise(data)
        edges = np.concatenate([[0], np.cumsum(size)])
        if edges[-1] != len(normal):
            raise AssertionError(f"pieces cover {edges[-1]} of {len(normal)} normalised bytes")
        return ids, source[edges]


@lru_cache(maxsize=2)
def codec(model: str) -> Codec:
    return Codec(model)


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_equal boolean, spans_crc32 long"


@trimmed
def _digests(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    c = codec(model)
    for batch in batches:
        rows = []
        for value in batch.column(1):
            text = value.as_py() or ""
            n, base, spans, of_ids, of_text, equal = 0, 0, 0, hashlib.sha256(), hashlib.sha256(), True
            for i, part in enumerate(c.parts(text)):
                ids, edges = c.encode(part)
                spans = zlib.crc32((edges[:-1] + base).astype("<i8").tobytes(), spans)
                base += len(part.encode()) + 1
                of_ids.update(("," * (n > 0 and bool(ids)) + ",".join(map(str, ids))).encode())
                n += len(ids)
                back = c.library.decode(ids) if ids else ""
                equal &= back == part
                of_text.update((" " * (i > 0) + back).encode())
            rows.append((n, of_ids.hexdigest(), of_text.hexdigest(), equal, spans))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64())
        yield pa.record_batch([batch.column(0), *map(pa.array, cols, kinds)], ["doc_id", *(x.split()[0] for x in DIGESTS.split(", ")[1:])])


def digest_pieces(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, decoded_equal, spans_crc32 for every row of docs(doc_id, text, ...).

    Every whole text (null: empty) is encoded without begin or end ids and its ids decoded. ids_sha256 is of the
    decimal ids joined by commas, decoded_sha256 of the decoded text, spans_crc32 of the original byte
    positions at which pieces start, as 64-bit integers. decoded_equal tells whether the text came back as it
    was, which control characters of the model can prevent. Rows that repeat a doc_id or have none are
    encoded each for itself; an empty table gives an empty result; other columns are ignored.
    """
    return docs.select("doc_id", "text").mapInArrow(partial(_digests, model=model), DIGESTS)


@trimmed
def _spans(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    c = codec(model)
    for batch in batches:
        for low in range(0, batch.num_rows, 64):
            part = batch.slice(low, 64)
            ids, begins, ends = [], [], []
            for value in part.column(1):
                found = [(c.encode(p), p) for p in c.parts(value.as_py() or "")]
                base, own = 0, ([], [], [])
                for (i, edges), p in found:
                    own[0].extend(i)
                    own[1].extend((edges[:-1] + base).tolist())
                    own[2].extend((edges[1:] + base).tolist())
                    base += len(p.encode()) + 1
                ids.append(own[0])
                begins.append(own[1])
                ends.append(own[2])
            yield pa.record_batch([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(begins, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], ["doc_id", "ids", "begins", "ends"])


def encode_with_offsets(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, begins, ends for every row of docs: the span of original UTF-8 bytes of every piece.

    A piece that the normaliser adds has an empty span; a null text has no pieces.
    """
    return docs.select("doc_id", "text").mapInArrow(partial(_spans, model=model), "doc_id long, ids array<int>, begins array<long>, ends array<long>")


@trimmed
def _decoded(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    c = codec(model)
    for batch in batches:
        for low in range(0, batch.num_rows, 64):
            part = batch.slice(low, 64)
            texts = [None if x is None else c.library.decode(x) if x else "" for x in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text of encoded(doc_id, ids, ...); null ids give a null text."""
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decoded, model=model), "doc_id long, text string")
