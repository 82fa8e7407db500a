"""Substring dedup by matching statistics on suffix automata of reference shards.

A window is so many consecutive words of one document. Its seed is the shorter word sequence in it with the
least hash, so equal windows have equal seeds, and neighbouring windows with one seed form a
run. Runs whose seed stands in one document only are done. For the others the distinct word sequences of runs (contexts)
with a common seed form a reference shard. In the order of doc_id each context is streamed through a suffix
automaton of the contexts before it: where its matching statistic reaches the window's length, the
window stands in a document with a smaller doc_id. Shards meet the contexts to be streamed by a shuffle on
the seed; broadcasting every shard to every task would grow with the square of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structdoc.llm.common import keyed_join, written
from structdoc.llm.tokens import grams, joined, mix, powers, words

SEED_WORDS = 16
#: Words of a long document that are windowed at a time.
SEGMENT = 1 << 20
#: Contexts of one seed above which windows are grouped by themselves instead: bounds a shard.
MOST_CONTEXTS = 1000
#: Bits of the filter that tells which contexts' words are wanted: a fixed size, so it can be broadcast.
FILTER_BITS = 1 << 26


def least_position(g: np.ndarray, width: int) -> np.ndarray:
    """For each window of so many values the position of the least, the first of equals."""
    value, place, span = g, np.arange(len(g), dtype=np.int32), 1

    def joint(a: int) -> None:  # of windows of span and of those that start a later
        nonlocal value, place
        later = value[a:] < value[:-a]
        place = np.where(later, place[a:], place[:-a])
        value = np.where(later, value[a:], value[:-a])

    while span * 2 <= width:
        joint(span)
        span *= 2
    if width > span:
        joint(width - span)
    return place


def runs(h: np.ndarray, own: np.ndarray, n: int, k: int) -> tuple[np.ndarray, ...]:
    """Of words' hashes and their documents: each run's document, first word, number of windows, seed and context hash."""
    if len(h) < n:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    g = grams(h, k)
    at = least_position(g, n - k + 1)
    valid = own[: len(at)] == own[n - 1 :]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
    stop = np.append(np.flatnonzero(new | ~valid), len(at))
    first = np.flatnonzero(new)
    count = stop[np.searchsorted(stop, first, side="right")] - first
    seed = g[at[first]]
    power, inverse = powers(len(h))
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * power[: len(h)], out=total[1:])
    context = mix((total[first + count + n - 1] - total[first]) * inverse[first] + mix((count * 64 + at[first] - first).astype(np.uint64)))
    return own[first], first, count, seed, context


def _blocks(texts: list[bytes], n: int, k: int) -> Iterator[tuple]:
    """For blocks of texts: runs (text number, first word in the text, windows, seed, context), and the words behind them."""
    for low, block, at in joined(texts):
        starts, ends, h = words(block)
        own = np.searchsorted(at, starts, side="right") - 1
        base = np.searchsorted(starts, at)  # the first word of each text
        for s in range(0, max(1, len(h)), SEGMENT):
            of, first, count, seed, context = runs(h[s : s + SEGMENT + n - 1], own[s : s + SEGMENT + n - 1], n, k)
            yield low + of, first + s - base[of], count, seed, context, (block, starts, ends, first + s)


RUNS = "seed long, context long, doc_id long, row0 long, row1 long, start int, windows int"


def _emit(batches: Iterator[pa.RecordBatch], n: int, k: int, full: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, row0, row1 = (batch.column(i).to_numpy() for i in range(3))
        texts = [(t or "").encode() for t in batch.column(3).to_pylist()]
        for of, start, count, seed, context, _ in _blocks(texts, n, k):
            if full:
                cols = [seed.view(np.int64), context.view(np.int64), ids[of], row0[of], row1[of], start.astype(np.int32), count.astype(np.int32)]
                yield pa.record_batch([pa.array(c) for c in cols], ["seed", "context", "doc_id", "row0", "row1", "start", "windows"])
            else:
                once = np.unique(np.rec.fromarrays([of, seed.view(np.int64)]))
                yield pa.record_batch([pa.array(once.f1), pa.array(ids[once.f0])], ["seed", "doc_id"])


def _wanted(seed: np.ndarray, context: np.ndarray, doc_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two places of a context in the filter."""
    h = mix(seed.view(np.uint64) ^ mix(context.view(np.uint64) + mix(doc_id.astype(np.int64).view(np.uint64))))
    return (h & np.uint64(FILTER_BITS - 1)).astype(np.int64), (h >> np.uint64(32) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _filter_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places = np.concatenate(_wanted(*(batch.column(i).to_numpy() for i in range(3))))
        yield pa.record_batch([pa.array((places >> 6).astype(np.int32)), pa.array((np.uint64(1) << (places & 63).astype(np.uint64)).view(np.int64))], ["place", "bits"])


def _contexts(batches: Iterator[pa.RecordBatch], n: int, k: int, wanted) -> Iterator[pa.RecordBatch]:
    """The words of the contexts that the filter lets through."""
    bits = wanted.value
    for batch in batches:
        ids = batch.column(0).to_numpy()
        texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
        for of, _, count, seed, context, (block, starts, ends, first) in _blocks(texts, n, k):
            hit = np.ones(len(of), dtype=bool)
            for place in _wanted(seed.view(np.int64), context.view(np.int64), ids[of]):
                hit &= (bits[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            found = np.flatnonzero(hit)
            text = [b" ".join(block[a:b].split()).decode() for a, b in zip(starts[first[found]].tolist(), ends[first[found] + count[found] + n - 2].tolist(), strict=True)]
            yield pa.record_batch([pa.array(seed[found].view(np.int64)), pa.array(context[found].view(np.int64)), pa.array(ids[of[found]]), pa.array(text, pa.string())], ["seed", "context", "doc_id", "words"])


class Automaton:
    """A suffix automaton of many word sequences."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, to: dict[str, int]) -> int:
        self.next.append(to)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _extend(self, last: int, word: str) -> int:
        nexts, link, length = self.next, self.link, self.length
        known = nexts[last].get(word)
        if known is not None and length[known] == length[last] + 1:
            return known
        new = None
        p = last
        if known is None:
            new = self._state(length[last] + 1, 0, {})
            while p >= 0 and word not in nexts[p]:
                nexts[p][word] = new
                p = link[p]
            if p < 0:
                return new
        q = nexts[p][word]
        if length[q] == length[p] + 1:
            link[new] = q
            return new
        copy = self._state(length[p] + 1, link[q], dict(nexts[q]))
        while p >= 0 and nexts[p].get(word) == q:
            nexts[p][word] = copy
            p = link[p]
        link[q] = copy
        if new is None:
            return copy
        link[new] = copy
        return new

    def add(self, sequence: list[str]) -> None:
        last = 0
        for word in sequence:
            last = self._extend(last, word)

    def statistics(self, sequence: list[str], most: int) -> list[int]:
        """For each position the length, up to most, of the longest match that ends there."""
        out, state, matched = [], 0, 0
        nexts, link, length = self.next, self.link, self.length
        for word in sequence:
            while state and word not in nexts[state]:
                state = link[state]
                matched = length[state]
            if word in nexts[state]:
                state, matched = nexts[state][word], matched + 1
                while matched > most and length[link[state]] >= most:
                    state = link[state]
                    matched = length[state]
            out.append(min(matched, most))
        return out


def match_shard(contexts: list[tuple[int, int, str]], n: int) -> list[tuple[int, int]]:
    """Of one seed's contexts (doc_id, context, words) in the order of doc_id: the windows, as bits, that a smaller doc_id has."""
    out, automaton, waiting, current = [], Automaton(), [], None
    for doc_id, context, text in contexts:
        if doc_id != current:
            for sequence in waiting:
                automaton.add(sequence)
            waiting, current = [], doc_id
        sequence = text.split(" ")
        seen = [m >= n for m in automaton.statistics(sequence, n)[n - 1 :]] if len(automaton.length) > 1 else [False] * (len(sequence) - n + 1)
        bits = sum(1 << i for i, s in enumerate(seen) if s)
        if bits:
            out.append((context, bits))
        a = 0
        while a < len(seen):  # what is new joins the reference
            if seen[a]:
                a += 1
                continue
            b = a
            while b < len(seen) and not seen[b]:
                b += 1
            waiting.append(sequence[a : b + n - 1])
            a = b
    return out


def _match(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Rows (seed, context, doc_id, words) sorted by seed and doc_id -> (seed, context, bits)."""

    def out(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
        cols = list(zip(*found, strict=True)) or [[], [], []]
        return pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["seed", "context", "bits"])

    held, of, found = [], None, []
    for batch in batches:
        for seed, context, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if seed != of:
                found += [(of, *x) for x in match_shard(held, n)]
                held, of = [], seed
            held.append((doc_id, context, text))
        if found:
            yield out(found)
            found = []
    yield out([(of, *x) for x in match_shard(held, n)])


def _windows_of_large(contexts: DataFrame, n: int) -> DataFrame:
    """(seed, context, bits) for contexts of seeds with very many: windows grouped by their own words."""
    sequence = F.split("words", " ")
    each = contexts.select("seed", "context", "doc_id", sequence.alias("sequence")).select("seed", "context", "doc_id", "sequence", F.explode(F.sequence(F.lit(0), F.size("sequence") - n)).alias("at"))
    each = each.select("seed", "context", "doc_id", "at", F.array_join(F.slice("sequence", F.col("at") + 1, n), " ").alias("window"))
    first = written(each.groupBy("window").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("rows")), "large-windows")
    seen = keyed_join(each, first, ["window"], "rows", F.struct("context", "at")).where("first_doc < doc_id")
    return seen.groupBy("seed", "context").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("bits"))


def _remove(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 512):
            part = batch.slice(low, 512)
            total, removed, kept = [], [], []
            for text, hits in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                tokens = (text or "").encode().split()
                total.append(len(tokens))
                if hits:
                    edge = np.zeros(len(tokens) + 1, dtype=np.int32)
                    for hit in hits:
                        bits, at = hit["bits"], hit["start"]
                        while bits:
                            b = (bits & -bits).bit_length() - 1
                            edge[at + b] += 1
                            edge[at + b + n] -= 1
                            bits &= bits - 1
                    keep = (np.cumsum(edge[:-1]) == 0).tolist()
                    tokens = [t for t, k in zip(tokens, keep, strict=True) if k]
                removed.append(total[-1] - len(tokens))
                kept.append(b" ".join(tokens).decode())
            yield pa.record_batch([part.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])


def substring_dedup(docs: DataFrame, window_words: int = 50, seed_words: int = SEED_WORDS, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text for every row of docs(doc_id, text, ...).

    Words are [^\\x20\\x09-\\x0D]+, unchanged; a null text has none. Every word is removed that is covered by a
    window of window_words consecutive words which also starts in a document with a smaller doc_id; the
    others are joined by one space. Rows that repeat a doc_id never make each other lose words. A row with
    a null doc_id is compared with none and loses nothing. An empty table gives an empty result; other
    columns are ignored. window_words must exceed seed_words by 1 to 62. Rows and contexts are told apart by 128 bits
    of hash; what differs in a context's words is decided by the words themselves.
    """
    spark, n, k = docs.sparkSession, window_words, seed_words
    row = ["row0", "row1"]
    docs = docs.select("doc_id", "text", *(F.xxhash64(F.lit(s), "doc_id", "text").alias(c) for s, c in zip((7, 77), row, strict=True)))
    named = docs.where("doc_id is not null").select("doc_id", *row, "text")
    seeds = named.mapInArrow(partial(_emit, n=n, k=k, full=False), "seed long, doc_id long")
    shared = seeds.groupBy("seed").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("rows")).where("first_doc < last_doc")
    shared = written(shared.drop("last_doc"), "shared-seeds")
    every = named.mapInArrow(partial(_emit, n=n, k=k, full=True), RUNS)
    found = written(keyed_join(every, shared, ["seed"], "rows", F.struct("row0", "start")).where("first_doc is not null").drop("first_doc"), "shared-runs")

    contexts = written(found.groupBy("seed", "context").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows")), "contexts")
    several = written(contexts.groupBy("seed").agg(F.count("*").alias("n_contexts")).where("n_contexts > 1").withColumn("weight", F.col("n_contexts")), "several")
    needed = keyed_join(contexts.drop("rows"), several, ["seed"], "weight", F.col("context")).where("n_contexts is not null")
    needed = written(needed, "needed-contexts")
    bits = needed.select("seed", "context", "doc_id").mapInArrow(_filter_bits, "place int, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits"))
    wanted = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    got = bits.toPandas()
    wanted[got.place.to_numpy(dtype=np.int64)] = got.bits.to_numpy(dtype=np.int64).view(np.uint64)
    wanted = spark.sparkContext.broadcast(wanted)
    texts = named.select("doc_id", "text").mapInArrow(lambda batches: _contexts(batches, n, k, wanted), "seed long, context long, doc_id long, words string")
    texts = texts.join(needed, ["seed", "context", "doc_id"]).dropDuplicates(["seed", "context"])
    texts = written(texts, "context-words")
    small = texts.where(F.col("n_contexts") <= most_contexts).select("seed", "context", "doc_id", "words")
    masks = small.repartition("seed").sortWithinPartitions("seed", "doc_id").mapInArrow(partial(_match, n=n), "seed long, context long, bits long")
    masks = masks.unionByName(_windows_of_large(texts.where(F.col("n_contexts") > most_contexts), n))

    firsts = contexts.withColumnRenamed("doc_id", "first_doc").join(masks, ["seed", "context"], "left")
    marked = keyed_join(found, written(firsts, "first-contexts"), ["seed", "context"], "rows", F.struct("row0", "start"))
    all_bits = F.expr("shiftleft(1L, windows) - 1L")
    marked = marked.withColumn("bits", F.when(F.col("doc_id") > F.col("first_doc"), all_bits).otherwise(F.coalesce("bits", F.lit(0))))
    # what is hashed is smaller than the texts that it meets, which would be sorted else: a document has fewer runs than words
    hits = marked.where("bits <> 0").groupBy(*row).agg(F.collect_list(F.struct("start", "bits")).alias("hits"))
    ready = docs.join(hits.hint("shuffle_hash"), row, "left").select("doc_id", "text", F.when(F.col("doc_id").isNotNull(), F.col("hits")).alias("hits"))
    return ready.mapInArrow(partial(_remove, n=n), "doc_id long, n_words long, n_removed long, kept_text string")
