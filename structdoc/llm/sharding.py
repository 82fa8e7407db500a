"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups are rows with equal texts. Best-fit-decreasing treats groups of one size alike: it fills the bin with the
least room that takes the size as long as it can, then the next. So the driver packs a histogram, sizes
and how many groups have each, and gives out segments: so many groups of this size into these bins, so many into
each. Sizes are rounded up to 16 binary digits, which bounds the histogram at any input size and never lets a bin overflow.
Groups are numbered in the order of size, and a segment gives each number its bin. For a given number
of shards the smallest capacity at which that many are enough is found by bisection, which makes sizes near equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structdoc.llm.common import hash128, keyed_join, written

#: Binary digits that are kept of a group's size: at most 2^15 sizes for each power of two.
DIGITS = 16
#: Rows, or groups, that are numbered in one task, about.
SLOT_ROWS = 200_000


class _Node:
    __slots__ = ("key", "left", "right", "level")

    def __init__(self, key: int):
        self.key, self.left, self.right, self.level = key, None, None, 1


class CapacityTree:
    """Remaining capacities of open bins in a balanced search tree, and the runs of bins that have each."""

    def __init__(self) -> None:
        self.root: _Node | None = None
        self.bins: dict[int, list[tuple[int, int]]] = {}

    def put(self, remaining: int, first: int, n: int) -> None:
        """Notes that n bins from first on have so much room."""
        if n and remaining:
            if remaining not in self.bins:
                self.bins[remaining] = []
                self.add(remaining)
            self.bins[remaining].append((first, n))

    def take(self, remaining: int) -> list[tuple[int, int]]:
        """Takes the bins with so much room out."""
        self.remove(remaining)
        return self.bins.pop(remaining)

    def tightest(self, size: int) -> int | None:
        """The least room that takes size."""
        node, best = self.root, None
        while node:
            if node.key >= size:
                best, node = node.key, node.left
            else:
                node = node.right
        return best

    def add(self, key: int) -> None:
        self.root = self._add(self.root, key)

    def remove(self, key: int) -> None:
        self.root = self._remove(self.root, key)

    def _skew(self, n: _Node | None) -> _Node | None:
        if n and n.left and n.left.level == n.level:
            low = n.left
            n.left, low.right = low.right, n
            return low
        return n

    def _split(self, n: _Node | None) -> _Node | None:
        if n and n.right and n.right.right and n.right.right.level == n.level:
            high = n.right
            n.right, high.left = high.left, n
            high.level += 1
            return high
        return n

    def _add(self, n: _Node | None, key: int) -> _Node:
        if n is None:
            return _Node(key)
        if key < n.key:
            n.left = self._add(n.left, key)
        else:
            n.right = self._add(n.right, key)
        return self._split(self._skew(n))

    def _remove(self, n: _Node | None, key: int) -> _Node | None:
        if n is None:
            return None
        if key < n.key:
            n.left = self._remove(n.left, key)
        elif key > n.key:
            n.right = self._remove(n.right, key)
        elif n.left is None and n.right is None:
            return None
        elif n.left is None:
            after = n.right
            while after.left:
                after = after.left
            n.key, n.right = after.key, self._remove(n.right, after.key)
        else:
            before = n.left
            while before.right:
                before = before.right
            n.key, n.left = before.key, self._remove(n.left, before.key)
        low = 1 + min(n.left.level if n.left else 0, n.right.level if n.right else 0)
        if low < n.level:
            n.level = low
            if n.right and n.right.level > low:
                n.right.level = low
        n = self._skew(n)
        n.right = self._skew(n.right)
        if n.right:
            n.right.right = self._skew(n.right.right)
        n = self._split(n)
        n.right = self._split(n.right)
        return n


def best_fit_decreasing(histogram: list[tuple[int, int]], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Packs sizes given as (size, how many), largest first: segments and the number of bins opened.

    A segment (start, first_bin, per_bin, n) puts n items, numbered from start in the order of the histogram, into bins from first_bin on,
    per_bin into each. A size above the capacity gets a bin of its own.
    """
    tree, segments, opened, at = CapacityTree(), [], 0, 0

    def fill(room: int, first: int, n: int, size: int, most: int) -> int:
        """Fills up to n bins of equal room with up to most items; how many went in."""
        per = max(1, room // size)
        used = min(most, n * per)
        full, rest = divmod(used, per)
        segments.append((at, first, per, used))
        tree.put(max(0, room - per * size), first, full)
        tree.put(max(0, room - rest * size), first + full, 1 if rest else 0)
        touched = full + (rest > 0)
        tree.put(room, first + touched, n - touched)
        return used

    for size, left in histogram:
        while left:
            room = tree.tightest(size)
            if room is None:
                bins = -(-left // max(1, capacity // size))
                found, room, opened = [(opened, bins)], max(capacity, size), opened + bins
            else:
                found = tree.take(room)
            for first, n in found:
                if left:
                    used = fill(room, first, n, size, left)
                    at, left = at + used, left - used
                else:
                    tree.put(room, first, n)
    return segments, opened


def fit_into(histogram: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """Segments of best-fit-decreasing at the smallest capacity that needs no more than so many bins; an item above the mean of what is left gets a bin of its own first."""
    left, alone, rest = sum(size * n for size, n in histogram), 0, []
    for size, n in histogram:
        while n and not rest and alone < shards - 1 and size * (shards - alone) > left:
            left, alone, n = left - size, alone + 1, n - 1
        if n:
            rest.append((size, n))
    bins = shards - alone
    low, high = max(-(-left // bins), rest[0][0] if rest else 1, 1), max(left, 1)
    step, best = low, None
    while step < high:  # the least capacity is nearly always within a few thousandths of the mean
        found, opened = best_fit_decreasing(rest, step)
        if opened <= bins:
            best, high = found, step
            break
        low, step = step + 1, min(high, step + max(1, step // 512))
    while low < high and high - low > high // 100_000:
        middle = (low + high) // 2
        found, opened = best_fit_decreasing(rest, middle)
        if opened <= bins:
            best, high = found, middle
        else:
            low = middle + 1
    if best is None:
        best = best_fit_decreasing(rest, high)[0]
    return [(i, i, 1, 1) for i in range(alone)] + [(start + alone, first + alone, per, n) for start, first, per, n in best]


def rounded(size: Column) -> Column:
    """A size rounded up to DIGITS binary digits."""
    unit = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.lit(0), F.length(F.bin(size)) - DIGITS))
    return F.call_function("div", size + unit - 1, unit) * unit


def numbered(groups: DataFrame, slot_rows: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """groups with ``position``, their number in the order of decreasing ``class``, and the histogram of classes.

    Groups of a frequent class are dealt out by hash and numbered deal by deal, so that no task numbers many more than slot_rows.
    """
    spark = groups.sparkSession
    counts = {r["class"]: r["n"] for r in groups.groupBy("class").agg(F.count("*").alias("n")).collect()}  # bounded by DIGITS
    often = [(c, -(-n // slot_rows)) for c, n in counts.items() if n > slot_rows]  # fewer than groups / slot_rows
    frequent = spark.createDataFrame(often, "class long, deals int")
    dealt = groups.join(F.broadcast(frequent), "class", "left")
    dealt = dealt.withColumn("deal", F.when(F.col("deals").isNull(), 0).otherwise(F.pmod("h2", F.col("deals"))).cast("int")).drop("deals")
    parts = {(r["class"], r["deal"]): r["n"] for r in dealt.join(F.broadcast(frequent), "class", "left_semi").groupBy("class", "deal").agg(F.count("*").alias("n")).collect()} if often else {}
    deals, starts, at = dict(often), [], 0
    histogram = sorted(counts.items(), reverse=True)
    for c, n in histogram:
        for deal in range(deals.get(c, 1)):
            starts.append((c, deal, at))
            at += parts.get((c, deal), 0) if c in deals else n
    start = written(spark.createDataFrame(starts, "class long, deal int, start long"), "class-starts")
    rank = F.row_number().over(Window.partitionBy("class", "deal").orderBy("h1", "h2")) - 1
    return dealt.withColumn("rank", rank).join(start, ["class", "deal"]).select(*groups.columns, (F.col("start") + F.col("rank")).alias("position")), histogram


def placed(groups: DataFrame, segments: list[tuple[int, int, int, int]], slot_rows: int) -> DataFrame:
    """groups(h1, h2, rows, position) with the shard that the segments give their positions: h1, h2, rows, shard."""
    spark, cut = groups.sparkSession, []
    for start, first, per, n in segments:  # a segment is named in each block of positions that it reaches
        cut += [(block, max(start, block * slot_rows), start, first, per) for block in range(start // slot_rows, (start + n - 1) // slot_rows + 1)]
    table = written(spark.createDataFrame(cut, "block long, position long, start long, first long, per long"), "segments")
    marks = table.select("block", "position", F.lit(0).alias("kind"), F.struct("start", "first", "per").alias("segment"))
    both = groups.select(F.floor(F.col("position") / slot_rows).cast("long").alias("block"), "position", F.lit(1).alias("kind"), "h1", "h2", "rows").unionByName(marks, allowMissingColumns=True)
    held = both.withColumn("segment", F.last("segment", ignorenulls=True).over(Window.partitionBy("block").orderBy("position", "kind"))).where("kind = 1")
    return held.select("h1", "h2", "rows", F.expr("int(segment.first + (position - segment.start) div segment.per)").alias("shard"))


def shard(docs: DataFrame, n_shards: int | None = 24, capacity: int | None = None, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs(doc_id, text, ...).

    size: UTF-8 bytes of the text plus 8; a null text has none and is in one group with empty
    texts. Rows with equal texts share a shard. With capacity, the number of shards is what
    best-fit-decreasing opens at that capacity, and none is fuller (a larger group has a shard of its own); else
    the groups go into n_shards of near equal bytes, the law ``bytes``. slot numbers a shard's rows from 0
    without gaps, in an order set by doc_id and text; rows without doc_id come last. Rows that repeat a doc_id get slots too.
    An empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *hash128(text), F.monotonically_increasing_id().alias("serial"))
    rows = written(rows, "rows")
    groups = rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    groups = written(groups.withColumn("class", rounded(F.col("bytes"))), "groups")
    inline, histogram = numbered(groups, slot_rows)
    segments = best_fit_decreasing(histogram, capacity)[0] if capacity else fit_into(histogram, n_shards)
    of = written(placed(inline, segments, slot_rows), "shards-of-groups")
    out = keyed_join(rows, of, ["h1", "h2"], "rows", F.col("serial"))
    deals = max(16, rows.count() // slot_rows)
    deal = F.when(F.col("doc_id").isNull(), deals + F.pmod("serial", F.lit(deals))).otherwise(F.pmod(F.xxhash64("doc_id", "h1"), F.lit(deals)))
    out = out.select("doc_id", "size", "text_crc32", "shard", "h1", "h2", deal.cast("int").alias("deal"))
    return with_slots(out).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def with_slots(rows: DataFrame) -> DataFrame:
    """Numbers each shard's rows from 0: within each deal by a window, behind the rows of the deals before."""
    counts = rows.groupBy("shard", "deal").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "deal", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))  # a row for each deal
    within = Window.partitionBy("shard", "deal").orderBy("doc_id", "h1", "h2")
    ranked = rows.withColumn("rank", F.row_number().over(within) - 1)
    return ranked.join(offsets, ["shard", "deal"]).withColumn("slot", (F.col("rank") + F.col("offset")).cast("long"))
