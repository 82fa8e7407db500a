"""Source divergence audit: how far the words of a language's sources lie apart.

Two passes over the corpus. The first counts exactly in how many documents of a language each term stands; terms in
enough of them are kept. The second recounts occurrences: an Aho-Corasick automaton of the kept terms, each between
two delimiters, runs over whole texts whose other characters have become delimiters. What it finds are sparse postings
(language, source, term, count). Blocks of terms give partial distances between sources, which are summed; ranks come last.
The vocabulary is dealt out to automata of a bounded size; a language of a larger vocabulary takes a pass for each of them.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structdoc.llm.common import written

#: Bytes of terms, with their delimiters, in one automaton at most; an automaton takes some 60 times as much.
SHARD_BYTES = 4_000_000
#: Counts that a task holds before it hands them on.
HELD = 1_000_000
#: Sources that one group compares with as many others, and terms in a block.
TILE, BLOCK_TERMS = 256, 8192
#: Letters stay, A-Z becomes a-z, the rest of ASCII becomes the delimiter; bytes outside ASCII are letters.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def delimited(text: str) -> str:
    return f" {text.encode().translate(TABLE).decode()} "


def _emit_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, term, documents), counted over batches."""
    held: dict[str, Counter] = defaultdict(Counter)
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held[lang].update(set(delimited(text).split(" ")))
            if sum(map(len, held.values())) > HELD:
                yield from _frequencies(held)
                held.clear()
    yield from _frequencies(held)


def _frequencies(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    for lang, of in held.items():
        of.pop("", None)
        yield pa.record_batch([pa.array([lang] * len(of), pa.string()), pa.array(of.keys(), pa.string()), pa.array(of.values(), pa.int64())], ["lang", "term", "documents"])


@lru_cache(maxsize=1)
def _automata(key: int, shared) -> dict[str, tuple[ahocorasick.Automaton, list[str]]]:
    """The automaton of each language in a shard, and its terms by number; a worker keeps those of the last shard."""
    out = {}
    for lang, terms in shared.value.items():
        automaton = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            automaton.add_word(f" {term} ", i)
        automaton.make_automaton()
        out[lang] = (automaton, terms)
    return out


def _emit_counts(batches: Iterator[pa.RecordBatch], key: int, shared) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> (lang, source, term, count) of one shard of the vocabulary, counted over batches."""
    held: dict[tuple[str, str], np.ndarray] = {}
    automata = _automata(key, shared)
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if lang not in automata:
                continue
            automaton, terms = automata[lang]
            found = np.fromiter((i for _, i in automaton.iter(delimited(text))), dtype=np.int64)
            if (lang, source) not in held:
                if sum(map(len, held.values())) + len(terms) > 8 * HELD:
                    yield from _counts(held, automata)
                    held.clear()
                held[lang, source] = np.zeros(len(terms), dtype=np.int64)
            if len(found) > len(terms) // 16:
                held[lang, source] += np.bincount(found, minlength=len(terms))
            else:
                np.add.at(held[lang, source], found, 1)
    yield from _counts(held, automata)


def _counts(held: dict[tuple[str, str], np.ndarray], automata: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), count in held.items():
        some = np.flatnonzero(count)
        terms = automata[lang][1]
        columns = [pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), pa.array([terms[i] for i in some.tolist()], pa.string()), pa.array(count[some])]
        yield pa.record_batch(columns, ["lang", "source", "term", "count"])


def _shards(kept: DataFrame, shard_bytes: int) -> Iterator[dict[str, list[str]]]:
    """The kept terms by language, so many at a time as an automaton may hold."""
    size = F.octet_length("term") + 2
    total = kept.agg(F.sum(size)).first()[0] or 0
    shards = -(-total // shard_bytes)
    for s in range(shards):
        out: dict[str, list[str]] = defaultdict(list)
        for lang, term in kept.where(F.pmod(F.xxhash64("lang", "term"), F.lit(shards)) == s).select("lang", "term").toLocalIterator():
            out[lang].append(term)
        yield dict(out)


def kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term) of terms in at least min_docs of a language's documents."""
    counts = docs.select("lang", "text").mapInArrow(_emit_frequencies, "lang string, term string, documents long")
    return counts.groupBy("lang", "term").agg(F.sum("documents").alias("documents")).where(F.col("documents") >= min_docs)


def occurrences(docs: DataFrame, kept: DataFrame, shard_bytes: int) -> DataFrame:
    """(lang, source, term, count) for kept terms that occur in the documents of a group; a pass for each shard of the vocabulary."""
    parts = []
    for key, terms in enumerate(_shards(kept, shard_bytes)):
        shared = docs.sparkSession.sparkContext.broadcast(terms)
        own = docs.where(F.col("lang").isin(list(terms))) if len(terms) <= 1000 else docs
        # the broadcast's number tells shards of different calls apart in a worker that is used again
        parts.append(own.select("lang", "source", "text").mapInArrow(lambda b, k=shared._jbroadcast.id(), s=shared: _emit_counts(b, k, s), "lang string, source string, term string, count long"))
    if not parts:
        return docs.sparkSession.createDataFrame([], "lang string, source string, term string, count long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), in decimals: counts of any size fit."""
    top = (count + 5).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    return F.call_function("div", top, (total + 5 * terms).cast("decimal(20,0)")) + 1


def _distances(group: pd.DataFrame) -> pd.DataFrame:
    """Postings of one block of terms and two tiles of sources -> for each pair of sources the sum of differences over the block's terms here, and how many terms those are.

    Rows without a term name the tiles' sources, so that those with none of the terms are compared, too.
    """
    names = group[group.term.isna()].drop_duplicates(["source"]).sort_values("source").reset_index(drop=True)
    posts = group[group.term.notna()].drop_duplicates(["source", "term"])
    own = {s: i for i, s in enumerate(names.source)}
    codes, terms = pd.factorize(posts.term)
    base = names.base.to_numpy(dtype=np.int64)
    table = np.repeat(base[:, None], len(terms), axis=1)
    table[posts.source.map(own).to_numpy(dtype=np.int64), codes] = posts.p.to_numpy(dtype=np.int64)
    one, two = int(group.one.iloc[0]), int(group.two.iloc[0])
    left, right = np.flatnonzero(names.tile == one), np.flatnonzero(names.tile == two)
    sources, items, parts = [], [], []
    for i in left.tolist():
        for low in range(0, len(right), 32):  # a bounded stretch of the differences at a time
            js = right[low : low + 32]
            js = js[js > i] if one == two else js
            parts += np.abs(table[js] - table[i]).sum(axis=1).tolist()
            items += names.source[js].tolist()
            sources += [names.source[i]] * len(js)
    found = pd.DataFrame({"lang": group.lang.iloc[0], "source": pd.Series(sources, dtype=object), "item": pd.Series(items, dtype=object), "part": np.array(parts, dtype=np.int64)})
    return found.assign(terms=len(terms))


def _pairs(postings: DataFrame, groups: DataFrame, block_terms: int, tile: int) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language."""
    cut = Window.partitionBy("lang").orderBy("source")
    groups = groups.withColumn("tile", F.floor((F.row_number().over(cut) - 1) / tile).cast("int"))
    tiles = groups.groupBy("lang").agg((F.max("tile") + 1).alias("tiles"), F.greatest(F.lit(1), F.ceil(F.max("kept") / block_terms)).cast("int").alias("blocks"))
    groups = groups.join(tiles, "lang").select("lang", "source", "tile", "tiles", "blocks", "base", "kept")
    groups = written(groups, "tiles")
    rows = postings.select("lang", "source", "term", "p").join(groups, ["lang", "source"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    marks = groups.where("kept > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("p"))
    both = rows.unionByName(marks).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    both = both.select("lang", "block", F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two"), "source", "tile", "base", "term", "p")
    parts = both.groupBy("lang", "block", "one", "two").applyInPandas(_distances, "lang string, source string, item string, part long, terms long")
    sums = parts.groupBy("lang", "source", "item").agg(F.sum("part").alias("part"), F.sum("terms").alias("terms"))
    turned = sums.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("pair"), "part", "terms")
    turned = turned.select("lang", "pair.source", "pair.item", "part", "terms")
    others = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("other_base"))
    pairs = groups.join(others, "lang").where(F.col("source") != F.col("item")).join(turned, ["lang", "source", "item"], "left")
    rest = (F.col("kept") - F.coalesce("terms", F.lit(0))) * F.abs(F.col("base") - F.col("other_base"))
    return pairs.select("lang", "source", "item", F.when(F.col("kept") == 0, 0).otherwise(F.coalesce("part", F.lit(0)) + rest).cast("long").alias("value"))


def source_divergence(docs: DataFrame, min_docs: int = 30, top: int = 50, shard_bytes: int = SHARD_BYTES, block_terms: int = BLOCK_TERMS, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank for the groups (lang, source) of docs(lang, source, text, ...).

    Terms are runs of letters (A-Z lower-cased) and of characters outside ASCII; each language keeps those in at least min_docs of its
    documents. p of a kept term is 1 + floor(10^9 (count + 5) / (N + 5 V)) with its count in the group (or the language), N the sum of
    counts and V the number of kept terms. Part pair: for each other source of the language the sum of |p - q| over
    all kept terms. Part term: the kept terms of the group that are likelier in it than in the language, by p - q, to rank top.
    Ranks count from 1 by value, descending, then by item in the order of its bytes.

    Null lang, source and text count as empty strings; so a group can have the empty name. Every row is a document, whether or not its
    doc_id is null or repeated. A language without kept terms has pairs of value 0 and no terms. Empty tables give an empty
    result; other columns are ignored. Pairs of sources are returned by contract, so the result has the square of a language's sources.
    """
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = written(kept_terms(docs, min_docs), "kept-terms")
    found = written(occurrences(docs, kept, shard_bytes), "postings")
    terms = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    totals = found.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = docs.groupBy("lang", "source").agg(F.lit(1).alias("one")).drop("one").join(totals, ["lang", "source"], "left").join(terms, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("kept", F.lit(0)).alias("kept"))
    groups = groups.withColumn("base", F.when(F.col("kept") > 0, share(F.lit(0), F.col("n"), F.col("kept"))).otherwise(0))
    groups = written(groups.join(groups.groupBy("lang").agg(F.sum("n").alias("lang_n")), "lang"), "groups")
    posts = found.join(groups.drop("base"), ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("n"), F.col("kept")))

    pairs = _pairs(posts, groups, block_terms, tile)
    whole = found.groupBy("lang", "term").agg(F.sum("count").alias("lang_count"))
    both = posts.join(whole, ["lang", "term"]).withColumn("q", share(F.col("lang_count"), F.col("lang_n"), F.col("kept")))
    likelier = both.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).cast("long").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda of, part: of.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(likelier, "term").where(F.col("rank") <= top))
