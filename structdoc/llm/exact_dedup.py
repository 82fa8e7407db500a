"""Exact dedup by content-defined chunk recipes.

Every text is cut where a rolling hash of its last bytes has zeros, so equal passages give equal
chunks wherever they stand. A chunk's identifier is its SHA-256; the dictionary of distinct chunks
shows whether an identifier ever stands for two different byte strings, and chunks of such an
identifier get their bytes as identifier. Texts are equal when their ordered identifier lists are. Chunk
bytes move once for each distinct chunk and map task; after that only identifiers move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structdoc.llm.common import ascii_lower, keyed_join, trimmed, written

#: Bytes of text that the rolling hash takes at a time; a longer text is taken alone.
BLOCK = 1 << 20
WINDOW = 16
GEAR = np.random.default_rng(20240607).integers(0, 2**32, 256, dtype=np.uint32)


def cut_points(data: np.ndarray, mask: int) -> np.ndarray:
    """Ends of chunks: positions behind a window of WINDOW bytes whose gear hash has zeros under mask."""
    h = GEAR[data]
    span = 1
    while span < WINDOW:
        h[span:] += h[:-span] << np.uint32(span)
        span *= 2
    return np.flatnonzero((h >> np.uint32(8)) & np.uint32(mask) == 0) + 1


def chunks_of(text: bytes, average: int) -> list[bytes]:
    """The chunks of a text, each at least a quarter and at most eight times the average, but for the last."""
    least, most, out, at = average // 4, average * 8, [], 0
    if len(text) <= least:
        return [text]
    for low in range(0, len(text), BLOCK):
        lead = min(low, WINDOW - 1)
        found = cut_points(np.frombuffer(text[low - lead : low + BLOCK], dtype=np.uint8), average - 1)
        for end in (found[found >= max(lead + 1, WINDOW)] + (low - lead)).tolist():
            if end - at < least:
                continue
            while end - at > most:
                out.append(text[at : at + most])
                at += most
            if end - at >= least:
                out.append(text[at:end])
                at = end
    while len(text) - at > most:
        out.append(text[at : at + most])
        at += most
    if at < len(text) or not out:
        out.append(text[at:])
    return out


def normal(value: str | None) -> bytes:
    return (value or "").encode().lower()  # of bytes, lower() changes A-Z only


def _id(chunk: bytes, id_bytes: int) -> bytes:
    return hashlib.sha256(chunk).digest()[:id_bytes]


@trimmed
def _emit_places(batches: Iterator[pa.RecordBatch], average: int, id_bytes: int) -> Iterator[pa.RecordBatch]:
    """(text_sha256, pos, chunk_id, chunk) for every chunk of every text."""
    for batch in batches:
        for t in batch.column(0).to_pylist():
            text = normal(t)
            pieces = chunks_of(text, average)
            digest = [hashlib.sha256(text).hexdigest()] * len(pieces)
            yield pa.record_batch([pa.array(digest), pa.array(range(len(pieces)), pa.int32()), pa.array([_id(c, id_bytes) for c in pieces], pa.binary()), pa.array(pieces, pa.binary())], ["text_sha256", "pos", "chunk_id", "chunk"])


@trimmed
def _emit_chunks(batches: Iterator[pa.RecordBatch], average: int, id_bytes: int) -> Iterator[pa.RecordBatch]:
    """(chunk_id, chunk), once for each distinct chunk of a batch."""
    for batch in batches:
        seen = {c for t in batch.column(0).to_pylist() for c in chunks_of(normal(t), average)}
        ids = [_id(c, id_bytes) for c in seen]
        yield pa.record_batch([pa.array(ids, pa.binary()), pa.array(list(seen), pa.binary())], ["chunk_id", "chunk"])


@trimmed
def _emit_recipes(batches: Iterator[pa.RecordBatch], average: int, id_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        recipes, digests = [], []
        for t in batch.column(1).to_pylist():
            text = normal(t)
            recipes.append([_id(c, id_bytes) for c in chunks_of(text, average)])
            digests.append(hashlib.sha256(text).hexdigest())
        yield pa.record_batch([batch.column(0), pa.array(recipes, pa.list_(pa.binary())), pa.array(digests, pa.string())], ["doc_id", "recipe", "text_sha256"])


def clashing_ids(docs: DataFrame, average: int, id_bytes: int) -> DataFrame:
    """Identifiers that stand for more than one chunk: none unless the hash fails."""
    chunks = docs.select("text").mapInArrow(partial(_emit_chunks, average=average, id_bytes=id_bytes), "chunk_id binary, chunk binary")
    return chunks.groupBy("chunk_id", "chunk").agg(F.lit(1).alias("one")).groupBy("chunk_id").agg(F.count("one").alias("n")).where("n > 1").select("chunk_id")


def with_bytes(recipes: DataFrame, docs: DataFrame, clashes: DataFrame, average: int, id_bytes: int) -> DataFrame:
    """recipes with the bytes of a chunk, behind "=", in place of an identifier that clashes."""
    places = docs.select("text").mapInArrow(partial(_emit_places, average=average, id_bytes=id_bytes), "text_sha256 string, pos int, chunk_id binary, chunk binary")
    hit = places.join(clashes, "chunk_id", "left_semi").select("text_sha256", F.struct("pos", F.concat(F.lit(b"="), F.col("chunk")).alias("chunk")).alias("place"))
    hit = hit.groupBy("text_sha256").agg(F.map_from_entries(F.collect_set("place")).alias("told"))
    told = F.transform("recipe", lambda x, i: F.coalesce(F.try_element_at("told", i), x))
    return recipes.join(hit, "text_sha256", "left").withColumn("recipe", F.when(F.col("told").isNull(), F.col("recipe")).otherwise(told)).select(*recipes.columns)


def exact_dedup(docs: DataFrame, average_chunk: int = 2048, id_bytes: int = 32) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs(doc_id, text, ...).

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts
    the row with the largest doc_id stays. Rows that repeat a doc_id count each in group_size and
    share the decision. A null doc_id is smaller than any other: it stays only if its whole group
    has none. An empty table gives an empty result; other columns are ignored.
    average_chunk must be a power of two.
    """
    docs = docs.select("doc_id", "text")
    clashes = written(clashing_ids(docs, average_chunk, id_bytes), "clashing-chunks")
    read = partial(_emit_recipes, average=average_chunk, id_bytes=id_bytes)
    recipes = docs.mapInArrow(read, "doc_id long, recipe array<binary>, text_sha256 string")
    if not clashes.isEmpty():
        recipes = with_bytes(recipes, docs, clashes, average_chunk, id_bytes)
    recipes = written(recipes, "recipes")
    groups = written(recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.count("*").alias("rows")).where("rows > 1"), "recipe-groups")
    out = keyed_join(recipes, groups, ["recipe"], "rows", F.coalesce("doc_id", F.lit(0)))
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that exact_dedup() keeps."""
    keys = ["_row0", "_row1"]
    while set(keys) & set(docs.columns):
        keys = [f"_{k}" for k in keys]
    name = lambda digest: [F.xxhash64(F.lit(seed), "doc_id", digest).alias(k) for seed, k in zip((7, 77), keys, strict=True)]
    gone = exact_dedup(docs).where(~F.col("kept")).select(*name(F.col("text_sha256"))).distinct()
    digest = F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256)
    return docs.select("*", *name(digest)).join(gone, keys, "left_anti").select(*docs.columns)
