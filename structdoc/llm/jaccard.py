"""SimHash near-dedup at a given Jaccard similarity of word shingles: prefixes give buckets, fingerprints candidates, whole sets verify them.

Fingerprints of similar sets differ in few of 64 bits, but in too many to deal them into selective buckets by their bits alone. So rows
share a bucket by a shingle, and within buckets fingerprints are compared: by exclusive-or and bit counts, in tiles in the order of population counts,
skipping tile pairs whose counts differ beyond the radius. A pair of similarity 0.8 lies beyond the radii with a chance of at most 6e-12; they can be switched off.
The order of shingles is by how often a sample of the documents holds them, then by hash; any order gives
the same result. Two sets of the asked similarity share a shingle of their prefixes: the first n - ceil(t n) + 1
of n in that order. Documents with equal sets are one node. Each node of a shingle's bucket is first compared with the
bucket's hub, the node with the fewest rarer shingles of its own: what a group of edited copies was made of has none. Then only nodes of one bucket
that links don't join yet are compared, those outside the bucket's largest component with each other and with it, so that a large
group of near copies takes about as many comparisons as it has rows, and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structdoc.llm.common import dropped, keyed_join, small_batches, trimmed, written
from structdoc.llm.components import components
from structdoc.llm.simhash import BITS_AT_ONCE
from structdoc.llm.tokens import grams, mix, words

#: Documents in the sample that sets the order of shingles, and shingles whose counts are broadcast, at most.
SAMPLE, COUNTED = 10_000, 200_000
#: Bits of the filters that tell which shingles and documents are wanted: a fixed size, so they can be broadcast.
FILTER_BITS = 1 << 24
#: Bits in which fingerprints of candidates may differ. At a similarity of 0.8 a bit differs with a probability of at most 0.1875 (4 of 5 shingles in
#: common), so that the binomial tail beyond 36 of 64 is 4.7e-12.
RADIUS = 36
#: Pairs are looked at once more by fingerprints of WIDE x 64 bits before their sets move; unrelated ones then hardly ever stay. The tail beyond 96 of 256 is 6.7e-13.
WIDE, WIDE_RADIUS = 4, 96
TILE = 64
#: A bucket with more rows is dealt out as pairs of parts, a group each.
MOST_ROWS = 256
EPSILON = 1e-9


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of n words, A-Z lower-cased; a text of fewer words is one shingle."""
    h = words((text or "").encode().lower())[2]
    return np.unique(grams(h, n) if len(h) >= n else grams(np.r_[h, np.zeros(1, dtype=np.uint64)], len(h) + 1))


def signature(of: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        x = (of ^ (of >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        total = np.bitwise_xor.reduce(x) + of.sum(dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return int(total.view(np.int64))


def fingerprints(of: np.ndarray) -> list[int]:
    """WIDE x 64 bits, each set if it is in over half of the shingles' hashes, which are mixed anew for each 64."""
    ones = np.zeros(64 * WIDE, dtype=np.int64)
    for at in range(0, len(of), BITS_AT_ONCE):
        h, parts = of[at : at + BITS_AT_ONCE], []
        for _ in range(WIDE):
            parts.append(h)
            h = mix(h + np.uint64(1))
        bits = np.unpackbits(np.stack(parts, axis=1).astype("<u8").view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > len(of), bitorder="little").view("<i8").tolist()


def prefix(of: np.ndarray, similarity: float, counted: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles in the order by sampled count and hash, so many that similar sets share one."""
    seen = np.zeros(len(of), dtype=np.int64)
    if len(counted):
        place = np.minimum(np.searchsorted(counted, of), len(counted) - 1)
        seen = np.where(counted[place] == of, counts[place], 0)
    return of[np.lexsort((of, seen))][: len(of) - int(np.ceil(similarity * len(of) - EPSILON)) + 1]


@trimmed
def _emit_sample(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t in batch.column(0):
            yield pa.record_batch([pa.array(shingles(t.as_py(), n).view(np.int64))], ["shingle"])


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, so that fewer sets are held at a time."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


@trimmed
def _emit_prefixes(batches: Iterator[pa.RecordBatch], n: int, similarity: float, shared) -> Iterator[pa.RecordBatch]:
    counted, counts = shared.value
    for batch in _sliced(batches):
        sets = [shingles(t.as_py(), n) for t in batch.column(1)]
        first = [prefix(s, similarity, counted, counts).view(np.int64) for s in sets]
        wide = list(map(fingerprints, sets))
        yield pa.record_batch([batch.column(0), pa.array(map(signature, sets), pa.int64()), pa.array(map(len, sets), pa.int32()), pa.array([w[0] for w in wide], pa.int64()), pa.array(first, pa.list_(pa.int64())), pa.array(wide, pa.list_(pa.int64()))], ["doc_id", "sig", "n", "fp", "prefix", "wide"])


def _has(wanted: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the filter has these keys; some that it wasn't given, too."""
    place = mix(keys.view(np.uint64)) % np.uint64(FILTER_BITS)
    return (wanted[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


@trimmed
def _filter_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        place = mix(batch.column(0).to_numpy().view(np.uint64)) % np.uint64(FILTER_BITS)
        bits = np.uint64(1) << (place & np.uint64(63))
        yield pa.record_batch([pa.array((place >> np.uint64(6)).astype(np.int32)), pa.array(bits.view(np.int64))], ["place", "bits"])


def _filter(keys: DataFrame):
    """The filter of keys, a column of longs without nulls, for the executors."""
    got = keys.mapInArrow(_filter_bits, "place int, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    out[got.place.to_numpy(dtype=np.int64)] = got.bits.to_numpy(dtype=np.int64).view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(out)


@trimmed
def _sift(batches: Iterator[pa.RecordBatch], at: int, shared, has: bool) -> Iterator[pa.RecordBatch]:
    """The rows whose key the filter has, or hasn't; a null key it hasn't."""
    for batch in batches:
        keys = batch.column(at)
        found = _has(shared.value, keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) & keys.is_valid().to_numpy(zero_copy_only=False)
        yield batch.filter(pa.array(found == has))


@trimmed
def _emit_places(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """The places of prefixes whose shingle the filter has, with the shingle of the place before, 0 for none."""
    for batch in _sliced(batches):
        first, size = batch.column(3).flatten().to_numpy(), np.diff(batch.column(3).offsets.to_numpy())
        row = np.repeat(np.arange(len(size)), size)
        pos = np.arange(len(first)) - np.repeat(np.cumsum(size) - size, size)
        found = np.flatnonzero(_has(shared.value, first))
        of = pa.array(row[found])
        before = np.where(np.r_[False, row[found][1:] == row[found][:-1]][: len(found)], np.r_[0, first[found][:-1]][: len(found)], 0)
        yield pa.record_batch([batch.column(0).take(of), batch.column(1).take(of), batch.column(2).take(of), pa.array(pos[found].astype(np.int32)), pa.array(first[found]), pa.array(before)], ["sig", "n", "fp", "pos", "shingle", "before"])


@trimmed
def _emit_sets(batches: Iterator[pa.RecordBatch], n: int, shared) -> Iterator[pa.RecordBatch]:
    for batch in _sliced(_sift(batches, 0, shared, True)):
        sets = [shingles(t.as_py(), n) for t in batch.column(1)]
        yield pa.record_batch([pa.array(map(signature, sets), pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["sig", "set"])


def _order(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled shingles that several documents hold, and how many."""
    rate = -(-docs.count() // SAMPLE)
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, rate))) == 0)
    counts = sample.select("text").mapInArrow(partial(_emit_sample, n=n), "shingle long").groupBy("shingle").agg(F.count("*").alias("c")).where("c > 1")
    got = counts.orderBy(F.desc("c"), "shingle").limit(COUNTED).toPandas()
    counted = got.shingle.to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(counted)
    return counted[order], got.c.to_numpy(dtype=np.int64)[order]


def possible(similarity: float, n, pos, other_n, other_pos):
    """Whether sets of these sizes whose first common shingle stands at these places can be similar; for columns and arrays."""
    need = similarity / (1 + similarity)
    left, right = n - pos, other_n - other_pos
    return (left >= need * (n + other_n) - EPSILON) & (right >= need * (n + other_n) - EPSILON)


def verified(pairs: DataFrame, docs: DataFrame, heads: DataFrame, n: int, similarity: float, radius: int) -> DataFrame:
    """Links (child, parent) of the pairs (a, b) whose sets are similar; sets move only of pairs whose wide fingerprints are near, and a hub b meets its partners in lists."""
    wide = lambda end: heads.select(F.col("sig").alias(end), F.col("wide").alias(f"wide_{end}"))
    apart = sum((F.bit_count(F.col("wide_a")[i].bitwiseXOR(F.col("wide_b")[i])) for i in range(WIDE)), F.lit(0))
    pairs = written(pairs.join(wide("b"), "b").join(wide("a"), "a").where(apart <= radius).select("a", "b"), "candidates")
    sigs = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    wanted = _filter(heads.join(sigs, "sig", "left_semi").select("least"))
    sets = docs.mapInArrow(lambda b: _emit_sets(b, n, wanted), "sig long, set array<long>")
    sets = written(sets.groupBy("sig").agg(F.first("set").alias("set")), "sets")
    lists = pairs.groupBy("b", F.pmod(F.xxhash64("a"), F.lit(32)).alias("slot")).agg(F.collect_list("a").alias("list"))
    lists = lists.join(sets.select(F.col("sig").alias("b"), F.col("set").alias("set_b")), "b")
    both = lists.select("b", "set_b", F.explode("list").alias("a")).join(sets.select(F.col("sig").alias("a"), F.col("set").alias("set_a")), "a")
    both = both.select("a", "b", F.size("set_a").alias("x"), F.size("set_b").alias("y"), F.size(F.array_intersect("set_a", "set_b")).alias("both"))
    near = both.where(F.col("both") >= similarity * (F.col("x") + F.col("y") - F.col("both")) - EPSILON)
    links = written(near.select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent")), "similar-pairs")
    dropped(pairs, sets)
    wanted.unpersist()
    return links


def near(wide: np.ndarray, ones: np.ndarray, radius: int = RADIUS, wide_radius: int = WIDE_RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of places whose fingerprints, given in the order of the first's population counts, lie within the radius, first by 64 bits, then by all."""
    left, right, fps = [], [], wide[:, 0]
    for at in range(0, len(fps), TILE):
        upto = min(at + TILE, len(fps))
        end = int(np.searchsorted(ones, ones[upto - 1] + radius, side="right"))  # beyond, population counts differ too much
        i, j = np.nonzero(np.bitwise_count(fps[at:upto, None] ^ fps[None, at:end]) <= radius)
        i, j = at + i[i < j], at + j[i < j]
        both = np.bitwise_count(wide[i] ^ wide[j]).sum(axis=1, dtype=np.int64) <= wide_radius
        left.append(i[both])
        right.append(j[both])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, dtype=np.int64),) * 2


@trimmed
def _compare(batches: Iterator[pa.RecordBatch], similarity: float, radii: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group -> pairs (a, b) of one group that links don't join yet and that can be similar.

    Two rows with the same shingle before this one have met in its bucket, where they stand earlier, so what is possible here is possible there: the pair comes from there.
    """
    held = None

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        shingle, lo, hi, part, sig, n, pos, comp, before = (t.column(i).to_numpy() for i in range(9))
        wide = np.stack([t.column(9 + i).to_numpy() for i in range(WIDE)], axis=1).view(np.uint64)
        ones = np.bitwise_count(wide[:, 0]).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, (shingle[1:] != shingle[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
        for x, y in zip(starts.tolist(), [*starts.tolist(), len(sig)][1:], strict=True):
            order = x + np.argsort(ones[x:y], kind="stable")
            i, j = near(wide[order], ones[order], *radii)
            i, j = order[i], order[j]
            ok = (comp[i] != comp[j]) & ((before[i] != before[j]) | (before[i] == 0)) & possible(similarity, n[i], pos[i], n[j], pos[j])
            if lo[x] != hi[x]:
                ok &= part[i] != part[j]
            if ok.any():
                i, j = i[ok], j[ok]
                yield pa.record_batch([pa.array(np.maximum(sig[i], sig[j])), pa.array(np.minimum(sig[i], sig[j]))], ["a", "b"])

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]) if held is not None else t
        if not len(t):
            continue
        last = np.ones(len(t), dtype=bool)
        for i in range(3):
            c = t.column(i).to_numpy()
            last &= c == c[-1]
        cut = int(np.argmax(last))  # sorted, so the last group is a tail
        if cut:
            yield from pairs(t.slice(0, cut).combine_chunks())
        held = t.slice(cut)
    if held is not None and len(held):
        yield from pairs(held.combine_chunks())


def _rest(shared: DataFrame, heads: DataFrame, stars: DataFrame, similarity: float, most: int, radii: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of nodes in one bucket that no links join yet, but for those with the hub.

    A bucket's largest component is dealt out in parts of about most rows, its other, loose rows likewise; a group is a part of loose rows
    with another one or with a part of the component. So few loose rows are copied once for each part, and the component's rows hardly at all.
    """
    named = shared.where("sig <> hub").join(stars.withColumnRenamed("child", "sig"), "sig", "left").withColumn("comp", F.coalesce("parent", "sig")).drop("parent")
    named = written(named, "named-prefixes")
    each = named.groupBy("shingle", "comp").agg(F.count("*").alias("c"))
    several = each.groupBy("shingle").agg(F.max(F.struct("c", "comp")).alias("main"), F.sum("c").alias("rows"), F.count("*").alias("comps")).where("comps > 1")
    several = written(several.select("shingle", "rows", F.col("main.comp").alias("main"), F.col("main.c").alias("joined"), (F.col("rows") - F.col("main.c")).alias("loose")), "several")
    rows = keyed_join(named, several, ["shingle"], "rows", F.col("sig")).where("main is not null").join(heads.select("sig", "wide"), "sig")
    loose_parts, joined_parts = (F.ceil(F.col(c) / most).cast("int") for c in ("loose", "joined"))
    is_loose, all_loose = F.col("comp") != F.col("main"), F.sequence(F.lit(0), loose_parts - 1)
    own = F.pmod(F.xxhash64("sig"), F.when(is_loose, loose_parts).otherwise(joined_parts)).cast("int")
    rows = rows.withColumn("part", F.when(is_loose, own).otherwise(loose_parts + own))
    rows = rows.withColumn("other", F.explode(F.when(is_loose, F.sequence(F.lit(0), loose_parts + joined_parts - 1)).otherwise(all_loose)))
    rows = rows.select("shingle", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "sig", "n", "pos", "comp", "before", *(F.col("wide")[i].alias(f"wide{i}") for i in range(WIDE)))
    rows = rows.repartition("shingle", "lo", "hi").sortWithinPartitions("shingle", "lo", "hi")
    return rows.mapInArrow(partial(_compare, similarity=similarity, radii=radii), "a long, b long").distinct()


def similar(docs: DataFrame, words_in_shingle: int = 5, similarity: float = 0.8, most: int = MOST_ROWS, by_fingerprints: bool = True) -> DataFrame:
    """doc_id, component_id for every doc_id of docs(doc_id, text, ...), once for each distinct text of it.

    Documents are linked when the sets of their word shingles have the Jaccard similarity or more (hashes of 64 bits
    stand for shingles); component_id is the smallest doc_id that links reach. Null texts count as empty; texts without
    words are alike, and texts of fewer words than a shingle are alike when equal. Rows without doc_id are left out.
    Rows that repeat a doc_id are nodes of that one name. An empty table gives an empty result. Fingerprints spare nearly all comparisons of
    sets; without by_fingerprints all that share a bucket are compared, so that no pair is lost by chance.
    """
    n = words_in_shingle
    small_batches(docs.sparkSession)
    radius, wide_radius = radii = (RADIUS, WIDE_RADIUS) if by_fingerprints else (64, 64 * WIDE)
    named = docs.select("doc_id", "text").where("doc_id is not null")
    order = docs.sparkSession.sparkContext.broadcast(_order(named, n))
    rows = written(named.mapInArrow(lambda b: _emit_prefixes(b, n, similarity, order), "doc_id long, sig long, n int, fp long, prefix array<long>, wide array<long>"), "prefixes")
    heads = written(rows.groupBy("sig").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"), F.min("wide").alias("wide")), "heads")
    several = rows.select(F.explode("prefix").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("rows")).where("rows > 1")
    maybe = _filter(several.select("shingle"))  # lets some others through, which then have a hub and no partner
    places = rows.select("sig", "n", "fp", "prefix").mapInArrow(lambda b: _emit_places(b, maybe), "sig long, n int, fp long, pos int, shingle long, before long").distinct()
    places = written(places, "places")
    maybe.unpersist()
    hubs = places.groupBy("shingle").agg(F.min(F.struct((F.col("pos") / F.col("n")).alias("place"), "sig", "n", "pos", "fp")).alias("hub"), F.count("*").alias("rows")).where("rows > 1")
    hubs = written(hubs.select("shingle", F.col("hub.sig").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.pos").alias("hub_pos"), F.col("hub.fp").alias("hub_fp"), "rows"), "hubs")
    shared = written(keyed_join(places, hubs, ["shingle"], "rows", F.col("sig")).where("hub is not null"), "shared-places")

    can = possible(similarity, F.col("n"), F.col("pos"), F.col("hub_n"), F.col("hub_pos")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("hub_fp"))) <= radius)
    dropped(places, hubs)
    first = shared.where((F.col("sig") != F.col("hub")) & can).select(F.col("sig").alias("a"), F.col("hub").alias("b")).distinct()
    links = verified(first, named, heads, n, similarity, wide_radius)
    names = rows.groupBy("doc_id").agg(F.min("sig").alias("parent"), F.max("sig").alias("most")).where("parent < most").drop("most")
    links = links.unionByName(rows.join(names, "doc_id").where("sig > parent").select(F.col("sig").alias("child"), "parent"))
    stars = components(links)
    links = verified(_rest(shared.drop("fp", "hub_n", "hub_pos", "hub_fp"), heads, stars, similarity, most, radii), named, heads, n, similarity, wide_radius)
    dropped(shared)
    if not links.isEmpty():
        stars = components(stars.unionByName(links))

    heads = heads.join(stars.withColumnRenamed("child", "sig"), "sig", "left").withColumn("comp", F.coalesce("parent", "sig"))
    heads = written(heads.select("sig", "comp", "least", "rows"), "named-heads")
    whole = written(heads.groupBy("comp").agg(F.min("least").alias("component_id"), F.count("*").alias("sets")), "components")
    of = written(keyed_join(heads, whole, ["comp"], "sets", F.col("sig")).select("sig", "component_id", "rows"), "components-of-sets")
    return keyed_join(rows.select("doc_id", "sig"), of, ["sig"], "rows", F.col("doc_id")).select("doc_id", "component_id")


def without_similar(docs: DataFrame, words_in_shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, with all their columns, but one document for each component of similar(): that of the smallest doc_id."""
    gone = written(similar(docs, words_in_shingle, similarity).where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    some, at = _filter(gone), docs.columns.index("doc_id")
    maybe = docs.mapInArrow(lambda b: _sift(b, at, some, True), docs.schema)  # only these move
    rest = docs.mapInArrow(lambda b: _sift(b, at, some, False), docs.schema)
    return rest.unionByName(maybe.join(gone, "doc_id", "left_anti").select(*docs.columns))
