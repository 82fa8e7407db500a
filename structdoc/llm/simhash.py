"""SimHash near-dedup: exact search for fingerprints within a Hamming radius, by tiles.

Copies of a fingerprint are merged first. Distinct fingerprints are dealt into buckets such that any
two within the radius share one: of radius + 1 blocks of bits one is equal, and of radius + 1 blocks of the
remaining bits another one is. A bucket's rows stand in the order of their population counts; tiles of them are
compared by exclusive-or and bit counts, skipping tiles whose population counts differ beyond the
radius. A bucket gives a spanning star for each of its groups, never all pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structdoc.llm.common import keyed_join, written
from structdoc.llm.components import components

SEED = 42
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BITS_AT_ONCE = 1 << 15
TILE = 64
#: A bucket with more rows is dealt out as pairs of parts, a group each.
MOST_ROWS = 16_384


def fingerprint(text: str | None, words_in_shingle: int = 3) -> int:
    """64 bits, each set if it is in over half of the shingles' XXH64; 0 without words."""
    words = WORD.findall((text or "").encode().lower())
    if not words:
        return 0
    n = max(1, len(words) - words_in_shingle + 1)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(size + 1) - 1
    first = (ends - size)[:n].tolist()
    last = ends[-n:].tolist() if len(words) >= words_in_shingle else [len(joined)]
    of, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, BITS_AT_ONCE):
        part = np.array([of(joined[a:b], SEED) for a, b in zip(first[at : at + BITS_AT_ONCE], last[at : at + BITS_AT_ONCE], strict=True)], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], words_in_shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.fromiter((fingerprint(t.as_py(), words_in_shingle) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
        yield pa.record_batch([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])


def with_fingerprints(docs: DataFrame, words_in_shingle: int = 3) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(partial(_fingerprints, words_in_shingle=words_in_shingle), "doc_id long, fp long")


def bucket_masks(radius: int) -> list[int]:
    """The masks under which fingerprints within the radius agree for at least one: a block of bits, and a block of the rest."""
    blocks = [range(64 * i // (radius + 1), 64 * (i + 1) // (radius + 1)) for i in range(radius + 1)]
    out = []
    for block in blocks:
        rest = [b for b in range(64) if b not in block]
        for i in range(radius + 1):
            inner = rest[len(rest) * i // (radius + 1) : len(rest) * (i + 1) // (radius + 1)]
            out.append(sum(1 << b for b in (*block, *inner)))
    return out


def _buckets(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    masks = np.array(bucket_masks(radius), dtype=np.uint64)
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        for i, mask in enumerate(masks):
            yield pa.record_batch([pa.array(np.full(len(fp), i, dtype=np.int32)), pa.array((fp & mask).view(np.int64)), batch.column(0), batch.column(1)], ["table", "key", "fp", "rep"])


def stars(fps: np.ndarray, reps: np.ndarray, radius: int, left: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (child, parent) that join what chains of fingerprints within the radius join; with left, only pairs of it with the rest count."""
    ones = np.bitwise_count(fps)
    order = np.argsort(ones, kind="stable")
    fps, reps, ones = fps[order], reps[order], ones[order].astype(np.int64)
    left = None if left is None else left[order]
    label = np.arange(len(fps))
    for at in range(0, len(fps), TILE):
        upto = min(at + TILE, len(fps))
        end = int(np.searchsorted(ones, ones[upto - 1] + radius, side="right"))  # beyond, population counts differ too much
        near = np.bitwise_count(fps[at:upto, None] ^ fps[None, at:end]) <= radius
        if left is not None:
            near &= left[at:upto, None] != left[None, at:end]
        for i in np.flatnonzero(near.sum(axis=1) > (left is None)).tolist():
            with_it = label[at + np.flatnonzero(near[i])]
            own = label[at + i]
            if (with_it != own).any():
                label[np.isin(label, np.append(with_it, own))] = min(int(with_it.min()), int(own))
    least = np.full(len(fps), np.iinfo(np.int64).max)
    np.minimum.at(least, label, reps)
    root = least[label]
    child = reps != root
    return reps[child], root[child]


def _pairs_of_few(fps: list[int], reps: list[int], radius: int) -> list[tuple[int, int]]:
    return [(max(a, b), min(a, b)) for i, (x, a) in enumerate(zip(fps, reps, strict=True)) for y, b in zip(fps[:i], reps[:i], strict=True) if ((x ^ y) & 0xFFFFFFFFFFFFFFFF).bit_count() <= radius]


LINKS = "child long, parent long, table int, key long"


def _compare(batches: Iterator[pa.RecordBatch], radius: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (table, key) -> links; rows of buckets above ``most`` come out as (fp, rep, table, key) with table >= 0."""
    held: list[tuple[np.ndarray, ...]] = []  # of the bucket that the last batch ended in
    over: tuple[int, int] | None = None

    def out(child, parent, table, key) -> pa.RecordBatch:
        return pa.record_batch([pa.array(child, pa.int64()), pa.array(parent, pa.int64()), pa.array(table, pa.int32()), pa.array(key, pa.int64())], ["child", "parent", "table", "key"])

    def links(fps: np.ndarray, reps: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        child, parent = [], []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if b - a < 2:
                continue
            if b - a <= 6:
                for c, p in _pairs_of_few(fps[a:b].tolist(), reps[a:b].tolist(), radius):
                    child.append(c)
                    parent.append(p)
            else:
                c, p = stars(fps[a:b].view(np.uint64), reps[a:b], radius)
                child.extend(c.tolist())
                parent.extend(p.tolist())
        if child:
            yield out(child, parent, np.full(len(child), -1), np.zeros(len(child), dtype=np.int64))

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(cols[0]):
            continue
        if over and (cols[0][0], cols[1][0]) != over:
            over = None
        if over:  # the rest of a bucket that was too large
            n = int(((cols[0] == over[0]) & (cols[1] == over[1])).sum())
            yield out(cols[2][:n], cols[3][:n], cols[0][:n], cols[1][:n])
            cols = [c[n:] for c in cols]
            if not len(cols[0]):
                continue
            over = None
        if held:
            cols = [np.concatenate([h[i] for h in held] + [c]) for i, c in enumerate(cols)]
        table, key, fps, reps = cols
        starts = np.flatnonzero(np.r_[True, (table[1:] != table[:-1]) | (key[1:] != key[:-1])])
        yield from links(fps, reps, starts)
        last = int(starts[-1])
        held = [tuple(c[last:] for c in cols)]
        if len(table) - last > most:
            over = (table[last], key[last])
            yield out(fps[last:], reps[last:], table[last:], key[last:])
            held = []
    if held:
        _, _, fps, reps = held[0]
        yield from links(fps, reps, np.array([0, len(fps)]))


def _compare_parts(key, pdf, radius: int):
    import pandas as pd

    if key[2] == key[3]:
        child, parent = stars(pdf.fp.to_numpy().view(np.uint64), pdf.rep.to_numpy(), radius)
    else:
        child, parent = stars(pdf.fp.to_numpy().view(np.uint64), pdf.rep.to_numpy(), radius, (pdf.part == key[2]).to_numpy())
    return pd.DataFrame({"child": child, "parent": parent})


def _links_of_large(large: DataFrame, radius: int, most: int) -> DataFrame:
    """Links within buckets above ``most`` rows: parts of near population counts meet pairwise, each pair a group of its own."""
    rows = large.select("table", "key", F.col("child").alias("fp"), F.col("parent").alias("rep")).withColumn("ones", F.bit_count("fp").cast("int"))
    sizes = written(rows.groupBy("table", "key", "ones").agg(F.count("*").alias("n")), "bucket-sizes")
    near = sizes.alias("a").join(sizes.alias("b"), (F.col("a.table") == F.col("b.table")) & (F.col("a.key") == F.col("b.key")) & F.col("b.ones").between(F.col("a.ones"), F.col("a.ones") + radius))
    parts = lambda c: F.ceil(F.col(c) / most).cast("int")
    name = lambda a, b: F.col(a) * 1_000_000 + F.col(b)
    pairs = near.select("a.table", "a.key", F.col("a.ones").alias("x"), F.col("b.ones").alias("y"), F.explode(F.sequence(F.lit(0), parts("a.n") - 1)).alias("i"), parts("b.n").alias("m"))
    pairs = pairs.select("table", "key", "x", "i", "y", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("j"))
    pairs = pairs.select("table", "key", name("x", "i").alias("p"), name("y", "j").alias("q")).where("p <= q")
    to = pairs.select("table", "key", "p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("part"))
    rows = rows.join(sizes, ["table", "key", "ones"]).withColumn("part", F.col("ones") * 1_000_000 + F.pmod(F.xxhash64("fp"), parts("n")).cast("int"))
    met = rows.join(to, ["table", "key", "part"]).select("table", "key", "p", "q", "part", "fp", "rep")
    return met.groupBy("table", "key", "p", "q").applyInPandas(lambda key, pdf: _compare_parts(key, pdf, radius), "child long, parent long")


def near_links(reps: DataFrame, radius: int = 3, most: int = MOST_ROWS) -> DataFrame:
    """Links (child, parent) between reps(fp, rep), distinct fingerprints: their components are those of all pairs within the radius."""
    dealt = reps.select("fp", "rep").mapInArrow(partial(_buckets, radius=radius), "table int, key long, fp long, rep long")
    dealt = dealt.repartition("table", "key").sortWithinPartitions("table", "key")
    found = written(dealt.mapInArrow(partial(_compare, radius=radius, most=most), LINKS), "near-links")
    links = found.where("table < 0").select("child", "parent")
    large = found.where("table >= 0")
    if not large.isEmpty():
        links = links.unionByName(_links_of_large(large, radius, max(1, most // 4)))
    return links


def near_dedup(docs: DataFrame, words_in_shingle: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of docs(doc_id, text, ...).

    Documents are linked when their fingerprints differ in at most radius bits; component_id is the
    smallest doc_id that links reach, the document itself included. A null or empty text has
    fingerprint zero and is linked like any other. A row with a null doc_id gets its fingerprint
    and a null component_id and links nothing. Rows that repeat a doc_id are nodes of that one name, so
    their components are joined. An empty table gives an empty result.
    """
    fps = written(with_fingerprints(docs, words_in_shingle), "fingerprints")
    reps = written(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), "distinct-fingerprints")
    links = components(near_links(reps, radius))
    named = reps.join(links.withColumnRenamed("child", "rep"), "rep", "left").select("fp", F.coalesce("parent", "rep").alias("component_id"), "rows")
    out = keyed_join(fps, written(named, "fingerprint-components"), ["fp"], "rows", F.coalesce("doc_id", F.lit(0)))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def without_near_copies(docs: DataFrame, words_in_shingle: int = 5, similarity: float | None = 0.8, radius: int = 3) -> DataFrame:
    """The rows of docs, with all their columns, but one document for each component: that of the smallest doc_id.

    Components are those of documents whose fingerprints lie within a wide radius and whose sets of shingles
    have the similarity (jaccard.similar()), or without a similarity those of near_dedup() at the radius.
    Rows without doc_id stay.
    """
    from structdoc.llm.jaccard import without_similar

    if similarity is not None:
        return without_similar(docs, words_in_shingle, similarity)
    gone = near_dedup(docs, words_in_shingle, radius).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
