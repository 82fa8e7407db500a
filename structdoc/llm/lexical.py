"""Ranked lexical search by sort-based accumulation.

Queries are items of a table, all of them against all documents. One pass counts documents, terms and the document frequencies of
the items' terms. In the second each task matches the terms of its documents with the items' postings, lays the
matched (item, document, impact) arrays end to end, sorts packed keys by radix and sums runs of equal keys; a heap selection
leaves it the best few documents of each item, which are enough: a document is scored whole, by one task. These
rows are range-partitioned by item and score, selected from again, and ranked. All scores are integers.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from structdoc.llm.common import written
from structdoc.llm.tokens import ALNUM, joined, words

#: Bytes of items in a shard, about: what is broadcast at a time. More items take a pass for each shard.
SHARD_BYTES = 8_000_000
#: Bytes of text that are matched at a time.
BLOCK = 4 << 20
#: Fixed values of the ranking: a term's weight, and a document's length, count in these units.
WEIGHT, IMPACT, TF, LENGTH, LEAST, SLOPE = 1000, 1_000_000_000, 1000, 8, 10, 90


def term_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the terms of a text, A-Z lower-cased, with repeats."""
    return words((text or "").encode().lower(), ALNUM)[2]  # of bytes, lower() changes A-Z only


class Index:
    """A shard of the items: the distinct terms' hashes in order, and for each of them the items that hold it."""

    def __init__(self, items: list[tuple[int, set[int]]]):
        self.ids = [i for i, _ in items]
        terms = np.array([t for _, own in items for t in sorted(own)], dtype=np.uint64)
        item = np.repeat(np.arange(len(items)), [len(own) for _, own in items])
        order = np.lexsort((item, terms))
        self.terms, self.first = np.unique(terms[order], return_index=True)
        self.items, self.last = item[order], np.append(self.first[1:], len(terms))
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(self.terms >> np.uint64(44)).astype(np.int64)] = True
        self.weights = np.zeros(len(self.terms), dtype=np.int64)

    def matched(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For blocks of texts: the first one's number, the terms of each text, and (text in the block, term, occurrences) of the terms that items hold."""
        for low, block, at in joined(texts, BLOCK):
            starts, _, h = words(block, ALNUM)
            base = np.searchsorted(starts, at)
            own = np.repeat(np.arange(len(at) - 1), np.diff(base))
            some = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.terms, h[some]), len(self.terms) - 1) if len(self.terms) else some[:0]
            hit = self.terms[place] == h[some[: len(place)]]
            keys, tf = np.unique(own[some[: len(place)]][hit] * len(self.terms) + place[hit], return_counts=True)
            yield low, np.diff(base), keys // max(1, len(self.terms)), keys % max(1, len(self.terms)), tf


def radix_order(keys: np.ndarray, top: int) -> np.ndarray:
    """The stable order of keys from 0 to top: least significant 16 bits first; numpy sorts 16-bit numbers by radix."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    for shift in range(16, int(top).bit_length(), 16):
        order = order[np.argsort((keys[order] >> shift & 0xFFFF).astype(np.uint16), kind="stable")]
    return order


def _counts(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """(term, documents) of the items' terms; null stands for documents with terms, and terms in all."""
    index = shared.value
    documents, some, total = np.zeros(len(index.terms), dtype=np.int64), 0, 0
    for batch in batches:
        for _, n, _, term, _ in index.matched([(t or "").encode().lower() for t in batch.column(0).to_pylist()]):
            documents += np.bincount(term, minlength=len(documents))
            some, total = some + int((n > 0).sum()), total + int(n.sum())
    seen = np.flatnonzero(documents)
    yield pa.record_batch([pa.array([None, *index.terms[seen].view(np.int64).tolist()], pa.int64()), pa.array([some, *documents[seen].tolist()], pa.int64()), pa.array([total, *[0] * len(seen)], pa.int64())], ["term", "documents", "terms"])


def lengths(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """The documents' m from their numbers of terms; beyond 64 bits in numbers of any size."""
    if int(n.max(initial=0)) * documents * SLOPE < 2**63:
        return 100 - SLOPE + n * (SLOPE * documents) // total
    return np.array([100 - SLOPE + SLOPE * int(x) * documents // total for x in n], dtype=np.int64)


def _best(item: np.ndarray, doc: list, score: np.ndarray, most: int) -> list[tuple[int, int, int | None]]:
    """(item, score, doc_id) of the most best documents of each item: rows are sorted by item. Equal scores by doc_id, null last."""
    out = []
    cuts = np.flatnonzero(np.diff(item)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(item)], strict=True):
        rows = range(a, b)
        if b - a > 4 * most:  # only what reaches the score of the last place
            rows = (a + np.flatnonzero(score[a:b] >= np.partition(score[a:b], b - a - most)[b - a - most])).tolist()
        key = lambda i: (-int(score[i]), doc[i] is None, doc[i] or 0)
        out += [(int(item[a]), int(score[i]), doc[i]) for i in heapq.nsmallest(most, rows, key=key)]
    return out


def _scored(batches: Iterator[pa.RecordBatch], shared, documents: int, total: int, most: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> the best documents of each item in each stretch of texts."""
    index = shared.value
    for batch in batches:
        ids = batch.column(0).to_pylist()
        held: list[tuple[int, int, int | None]] = []
        for low, n, own, term, tf in index.matched([(t or "").encode().lower() for t in batch.column(1).to_pylist()]):
            if not len(own):
                continue
            impact = index.weights[term] * (IMPACT * tf // (TF * tf + LENGTH * lengths(n, documents, total)[own]))
            times = index.last[term] - index.first[term]
            pick = np.repeat(index.first[term], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            keys = index.items[pick] * len(n) + np.repeat(own, times)
            impacts = np.repeat(impact, times)
            order = radix_order(keys, len(index.ids) * len(n))
            keys = keys[order]
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            score, keys = np.add.reduceat(impacts[order], starts), keys[starts]
            fit = score > 0
            doc = (keys[fit] % len(n)).tolist()
            if doc:
                held += _best(keys[fit] // len(n), [ids[low + d] for d in doc], score[fit], most)
        held.sort(key=lambda x: x[0])
        if held:
            held = _best(np.array([x[0] for x in held]), [x[2] for x in held], np.array([x[1] for x in held]), most)
        item, score, doc = zip(*held, strict=True) if held else ((), (), ())
        yield pa.record_batch([pa.array([index.ids[i] for i in item], pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], ["item_id", "doc_id", "score"])


def _selected(frames: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """The best rows of each item in a partition, kept in a heap of that size."""
    heaps: dict[int, list] = {}
    for f in frames:
        for item, doc, score in zip(f.item_id.tolist(), f.doc_id.tolist(), f.score.tolist(), strict=True):
            row = (score, not pd.isna(doc), 0 if pd.isna(doc) else -int(doc))
            heap = heaps.setdefault(item, [])
            if len(heap) < most:
                heapq.heappush(heap, row)
            elif row > heap[0]:
                heapq.heapreplace(heap, row)
    rows = [(item, -doc if known else None, score) for item, heap in heaps.items() for score, known, doc in heap]
    yield pd.DataFrame(rows, columns=["item_id", "doc_id", "score"]).astype({"item_id": "int64", "doc_id": "Int64", "score": "int64"})


def _weights(documents: int, frequency: dict[int, int], terms: np.ndarray) -> np.ndarray:
    return np.array([math.floor(WEIGHT * math.log((2 * documents + 2) / (2 * frequency.get(int(t), 0) + 1))) for t in terms.view(np.int64)], dtype=np.int64)


def _indexes(items: DataFrame, shard_bytes: int) -> Iterator[Index]:
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    for s in range(shards):
        own: dict[int, set[int]] = {}
        for item, text in items.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == s).toLocalIterator():
            own.setdefault(item, set()).update(term_hashes(text).tolist())
        yield Index(sorted(own.items()))


def search(docs: DataFrame, items: DataFrame, most: int = 10, shard_bytes: int = SHARD_BYTES, parts: int | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of items(item_id, text, ...) the most best rows of docs(doc_id, text, ...) with a score above 0.

    Terms are runs of letters, digits and characters outside ASCII, A-Z lower-cased; 64-bit hashes stand for them. A document's score sums over the
    item's distinct terms w * ((10^9 tf) div (1000 tf + 8 m)), with w = floor(1000 ln((2 N + 2) / (2 df + 1))) and m = 10 + (90 n N) div L; N counts the documents
    with terms, L their terms, n those of the document, df the documents with the term. Equal scores go by doc_id. All counts are over all documents.

    Null and empty texts have no terms and are found by nothing. Rows that repeat a doc_id are documents of their own; rows without doc_id can be found, and
    come last among equal scores. Rows that repeat an item_id are one item with the terms of all; items without item_id or text are
    left out. Empty tables give an empty result; other columns are ignored. Items are broadcast shard by shard; each shard takes its own passes.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").where("text is not null")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    found = []
    for index in _indexes(items, shard_bytes):
        counting = spark.sparkContext.broadcast(index)
        counts = docs.select("text").mapInArrow(lambda b, i=counting: _counts(b, i), "term long, documents long, terms long")
        got = counts.groupBy("term").agg(F.sum("documents").alias("documents"), F.sum("terms").alias("terms")).collect()  # a row for each term of the items at most
        frequency = {r[0]: r[1] for r in got}
        documents, total = next(((r[1], r[2]) for r in got if r[0] is None), (0, 0))
        index.weights = _weights(documents, frequency, index.terms)
        scoring = spark.sparkContext.broadcast(index)
        found.append(docs.mapInArrow(lambda b, i=scoring, n=documents, t=max(1, total): _scored(b, i, n, t, most), "item_id long, doc_id long, score long"))
    best = written(reduce(DataFrame.unionByName, found), "best")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = best.repartitionByRange(parts, "item_id", "score", "doc_id")  # an item may take many partitions
    spread = spread.mapInPandas(lambda f: _selected(f, most), "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return spread.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("item_id", "rank", "doc_id", "score")
