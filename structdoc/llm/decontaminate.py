"""Benchmark decontamination: rare n-gram seeds lead to passages, Smith-Waterman alignment scores them.

Words are runs of letters and digits, lower-cased. The corpus is read once for the document frequency of the
benchmark's n-grams, and once to align: a document's rare seeds give items and diagonals, and the words
around these are aligned with the item. Only tables as large as a shard of the benchmark are broadcast; a larger
benchmark takes a pass for each shard.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structdoc.llm.common import trimmed
from structdoc.llm.tokens import ALNUM, grams, joined, words

#: Words of benchmark items in a shard, about: what is broadcast at a time.
SHARD_WORDS = 2_000_000
#: Longer items are aligned in passages of so many words.
PASSAGE = 200
MATCH, MISMATCH, GAP = 2, -1, -1


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman over words: the best local score, and the aligned words of text [start, end)."""
    n = len(text)
    row, begin = np.zeros(n + 1, dtype=np.int64), np.arange(n + 1)
    slope = np.arange(n + 1)
    best = (0, 0, 0)
    for word in item.tolist():
        step = np.where(text == word, MATCH, MISMATCH)
        diagonal = row[:-1] + step
        above = row[1:] + GAP
        new, start = np.zeros(n + 1, dtype=np.int64), np.arange(n + 1)
        up = above > diagonal
        here = np.where(up, above, diagonal)
        live = here > 0
        new[1:][live] = here[live]
        start[1:][live] = np.where(up, begin[1:], begin[:-1])[live]
        lifted = new - GAP * slope  # a gap in the item costs the same for every word, so the best one comes from a running maximum
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, slope, 0))
        row = top + GAP * slope
        begin = start[source]
        at = int(row.argmax())
        if row[at] > best[0]:
            best = (int(row[at]), int(begin[at]), at)
    return best


#: Letters of scripts that don't put spaces between words: each is a word.
UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff])")


def _lower(text: str | None) -> bytes:
    text = (text or "").lower()
    return (text if text.isascii() else UNSPACED.sub(r" \1 ", text)).encode()


class Index:
    """A shard of the benchmark: its passages' words, and where each seed stands."""

    def __init__(self, items: list[tuple[int, str]], seed_words: int, min_words: int, threshold: float, short_threshold: float):
        self.passages: list[tuple[int, np.ndarray, float]] = []  # item, words, and the score from which on it is found
        self.short: dict[int, dict[int, list[int]]] = {}  # items of fewer words than a seed: for each length the item ids by the hash of all words
        codes, places = [], []
        for item_id, text in sorted(items, key=lambda x: (x[0], x[1] or "")):
            h = words(_lower(text), ALNUM)[2]
            if 0 < len(h) < seed_words:
                self.short.setdefault(len(h), {}).setdefault(int(grams(h, len(h))[0]), []).append(item_id)
            cuts = list(range(0, len(h), PASSAGE))
            if len(cuts) > 1 and len(h) - cuts[-1] < min_words:
                cuts.pop()
            for a, b in zip(cuts, [*cuts, len(h)][1:], strict=True):
                if b - a >= seed_words:
                    g = grams(h[a:b], seed_words)
                    codes.append(g)
                    places.append(np.stack([np.full(len(g), len(self.passages)), np.arange(len(g))]))
                    self.passages.append((item_id, h[a:b], threshold if len(h) >= min_words else short_threshold))
        self.codes = np.concatenate(codes) if codes else np.zeros(0, dtype=np.uint64)
        self.places = np.concatenate(places, axis=1) if places else np.zeros((2, 0), dtype=np.int64)
        order = np.argsort(self.codes, kind="stable")
        self.codes, self.places = self.codes[order], self.places[:, order]
        self.distinct = np.unique(self.codes)
        self.maybe = self._table()

    def _table(self) -> np.ndarray:
        out = np.zeros(1 << 20, dtype=bool)
        out[(self.distinct >> np.uint64(44)).astype(np.int64)] = True
        return out

    def keep_rare(self, documents: dict[int, int], floor: int, shared: int = 64) -> None:
        """Keeps of each passage's seeds those in no more documents than twice its median seed, or than floor; of these, where any is in over ``shared`` passages, the half that fewest passages share and those in no more."""
        self._keep_rare(documents, floor)
        _, own, passages = np.unique(self.codes, return_inverse=True, return_counts=True)
        fan = passages[own]
        keep = fan <= shared
        order = np.argsort(self.places[0], kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(self.places[0][order])) + 1):
            if len(part) and not keep[part].all():
                keep[part] |= fan[part] <= np.median(fan[part])
        self.codes, self.places = self.codes[keep], self.places[:, keep]
        self.distinct = np.unique(self.codes)
        self.maybe = self._table()

    def _keep_rare(self, documents: dict[int, int], floor: int) -> None:
        of = np.array([documents.get(int(c), 0) for c in self.codes.view(np.int64)], dtype=np.int64)
        keep = of <= floor
        order = np.argsort(self.places[0], kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(self.places[0][order])) + 1):
            seen = of[part][of[part] > 0]  # seeds that no document holds say nothing
            if len(seen):
                keep[part] |= of[part] <= 2 * np.median(seen)
        self.codes, self.places = self.codes[keep], self.places[:, keep]

    def hits(self, texts: list[bytes], seed_words: int) -> Iterator[tuple]:
        """For blocks of texts: (text number, word in the text, seed), and the words' hashes and texts."""
        for low, block, at in joined(texts):
            starts, _, h = words(block, ALNUM)
            own = np.searchsorted(at, starts, side="right") - 1
            g = grams(h, seed_words)
            found = np.flatnonzero(self.maybe[(g >> np.uint64(44)).astype(np.int64)] & (own[: len(g)] == own[len(own) - len(g) :]))
            if len(found) and len(self.distinct):
                place = np.minimum(np.searchsorted(self.distinct, g[found]), len(self.distinct) - 1)
                found = found[self.distinct[place] == g[found]]
            else:
                found = found[:0]
            base = np.searchsorted(starts, at)
            yield low + own[found], found - base[own[found]], g[found], h, base, low


@trimmed
def _document_counts(batches: Iterator[pa.RecordBatch], shared, seed_words: int) -> Iterator[pa.RecordBatch]:
    index = shared.value
    for batch in batches:
        count = np.zeros(len(index.distinct), dtype=np.int64)
        for of, _, g, *_ in index.hits([_lower(t) for t in batch.column(0).to_pylist()], seed_words):
            once = np.unique(np.stack([of, np.searchsorted(index.distinct, g)]), axis=1)
            np.add.at(count, once[1], 1)
        some = np.flatnonzero(count)
        yield pa.record_batch([pa.array(index.distinct[some].view(np.int64)), pa.array(count[some])], ["seed", "documents"])


def short_matches(index: Index, texts: list[bytes]) -> list[tuple]:
    """(text number, item, score, start, end) for items of fewer words than a seed: the text has all of them in their order, and no others."""
    out = []
    for low, block, at in joined(texts) if index.short else ():
        starts, _, h = words(block, ALNUM)
        base = np.searchsorted(starts, at)
        for n, items in index.short.items():
            for d in np.flatnonzero(np.diff(base) == n).tolist():
                own = items.get(int(grams(h[base[d] : base[d + 1]], n)[0]), ())
                out += [(low + d, item, 1.0, 0, n) for item in dict.fromkeys(own)]
    return out


FOUND = "doc_id long, item_id long, score double, start_word int, end_word int"


def matches(index: Index, texts: pa.Array, seed_words: int) -> list[tuple]:
    """(text number, item, score, start, end) for texts and items that align."""
    lowered = [_lower(t) for t in texts.to_pylist()]
    out = short_matches(index, lowered)
    for of, at, g, h, base, low in index.hits(lowered, seed_words):
        a, b = np.searchsorted(index.codes, g, side="left"), np.searchsorted(index.codes, g, side="right")
        times = b - a
        pick = np.repeat(a, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        passage, offset = index.places[0][pick], index.places[1][pick]
        doc, diagonal = np.repeat(of, times), np.repeat(at, times) - offset
        order = np.lexsort((diagonal, passage, doc))
        doc, passage, diagonal = doc[order], passage[order], diagonal[order]
        new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (passage[1:] != passage[:-1])][: len(doc)])
        best: dict[tuple[int, int], tuple] = {}
        for x, y in zip(new.tolist(), [*new.tolist(), len(doc)][1:], strict=True):
            d, (item_id, item, threshold) = int(doc[x]), index.passages[int(passage[x])]
            first, last = int(base[d - low]), int(base[d - low + 1])
            slack = len(item) // 2 + seed_words
            reach = len(item) + 2 * slack
            cuts = np.flatnonzero(np.diff(diagonal[x:y]) > reach) + 1  # far hits are regions of their own
            for part in np.split(diagonal[x:y], cuts):
                begin, end = max(first, first + int(part[0]) - slack), min(last, first + int(part[-1]) + len(item) + slack)
                region = h[begin:end]
                if np.isin(region, item).sum() < threshold * len(item):
                    continue
                score, s, e = align(item, region)
                score /= MATCH * len(item)
                if score >= threshold and score > best.get((d, item_id), (0,))[0]:
                    best[d, item_id] = (score, begin - first + s, begin - first + e)
        out += [(d, item_id, *found) for (d, item_id), found in best.items()]
    return out


@trimmed
def _aligned(batches: Iterator[pa.RecordBatch], shared, seed_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        out = [(ids[d], *found) for d, *found in matches(shared.value, batch.column(1), seed_words)]
        cols = list(zip(*out, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
        yield pa.record_batch(list(map(pa.array, cols, kinds)), [x.split()[0] for x in FOUND.split(", ")])


@trimmed
def _clean(batches: Iterator[pa.RecordBatch], shared, text: int, seed_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.ones(batch.num_rows, dtype=bool)
        keep[[d for d, *_ in matches(shared.value, batch.column(text), seed_words)]] = False
        yield batch.filter(pa.array(keep))


def _indexes(docs: DataFrame, benchmark: DataFrame, seed_words: int, min_words: int, threshold: float, short_threshold: float, rare_share: float, shard_words: int) -> Iterator:
    """The rare seeds of each shard of the benchmark, for the executors."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    shards, floor = max(1, -(-total // (5 * shard_words))), int(docs.count() * rare_share)
    for s in range(shards):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == s).collect()
        index = Index([(r[0], r[1]) for r in own], seed_words, min_words, threshold, short_threshold)
        counted = spark.sparkContext.broadcast(index)
        counts = docs.select("text").mapInArrow(lambda b, i=counted: _document_counts(b, i, seed_words), "seed long, documents long")
        index.keep_rare({r[0]: r[1] for r in counts.groupBy("seed").agg(F.sum("documents")).collect()}, floor)  # a row for each seed at most
        yield spark.sparkContext.broadcast(index)


def contaminated(docs: DataFrame, benchmark: DataFrame, seed_words: int = 3, min_words: int = 8, threshold: float = 0.5, short_threshold: float = 0.85, rare_share: float = 0.001, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, item_id, score, start_word, end_word for every document and item that align by the threshold or more.

    docs(doc_id, text, ...), benchmark(item_id, text, ...). score is the best Smith-Waterman score over
    that of a full match of the item (of its best passage, if it is longer than PASSAGE words), 0 to 1. A seed is rare
    if in no more of the documents than rare_share, or than twice the item's median seed, so items that leak into very many
    documents keep theirs. Null or empty texts match nothing. Items of fewer than min_words words, which chance would match
    in part, are aligned like others but found from short_threshold on; those of fewer than seed_words words, which have no seed, where the document has no other words. Letters of
    scripts without spaces are words of their own. Rows that repeat a doc_id, or have none, are reported each for itself; of items
    that repeat an item_id the best counts. Empty tables give an empty result; other columns are ignored.
    """
    docs = docs.select("doc_id", "text").where("text is not null")
    rare = _indexes(docs, benchmark, seed_words, min_words, threshold, short_threshold, rare_share, shard_words)
    return reduce(DataFrame.unionByName, [docs.mapInArrow(lambda b, i=index: _aligned(b, i, seed_words), FOUND) for index in rare])


def without_contaminated(docs: DataFrame, benchmark: DataFrame, seed_words: int = 3, min_words: int = 8, threshold: float = 0.5, short_threshold: float = 0.85, rare_share: float = 0.001, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The rows of docs, with all their columns, for which contaminated() finds no item."""
    text, out = docs.columns.index("text"), docs
    for index in _indexes(docs.select("text").where("text is not null"), benchmark, seed_words, min_words, threshold, short_threshold, rare_share, shard_words):
        out = out.mapInArrow(lambda b, i=index: _clean(b, i, text, seed_words), docs.schema)
    return out
