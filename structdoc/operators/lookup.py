"""Relational combinators: winners, fallback and positional joins, nearest matches, runs, caps.

Null keys are a group of their own where rows are grouped or ordered, and match nothing where tables are joined. Of ties the
given order decides, which must be total for a stable result; rows that repeat count each. Empty tables give empty results.
Columns whose names an operator uses inside are an error. Windows hold the rows of one key in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _free(df: DataFrame, *names: str) -> None:
    """An error if a table has columns of names that an operator uses inside, which would be lost."""
    clash = set(names) & set(df.columns)
    if clash:
        raise ValueError(f"columns of these names are used inside: {sorted(clash)}")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """The first k rows of each key. The order must be total for a stable result."""
    name = rank or "_rank"
    _free(df, name)
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def first_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """A row for each key: that of the least order. One partial aggregation, so hot keys don't gather."""
    return _winner(df, keys, F.min_by, F.col(order))


def last_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    return _winner(df, keys, F.max_by, F.col(order))


def keep_best(df: DataFrame, keys: Sequence[str], score: Column, order: str) -> DataFrame:
    """A row for each key: that of the highest score, the least order of equals (order must be a number)."""
    return _winner(df, keys, F.max_by, F.struct(score.alias("score"), (-F.col(order)).alias("order")))


def _winner(df: DataFrame, keys: Sequence[str], by, value: Column) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(by(F.struct(*rest), value).alias("_row"))
    return out.select(*keys, *(F.col("_row")[c].alias(c) for c in rest)).select(*df.columns)


def fallback_join(df: DataFrame, chain: Sequence[tuple[str, DataFrame, Sequence[str]]], value: str) -> DataFrame:
    """value from the first table of the chain that has a row for its keys; ``origin`` names it.

    chain: (name, table with the keys and value, keys). Each table has one row for each key.
    """
    found, names = [], []
    for i, (name, table, keys) in enumerate(chain):
        column = f"_value{i}"
        df = df.join(table.select(*keys, F.col(value).alias(column)), list(keys), "left")
        found.append(F.col(column))
        names.append(F.when(F.col(column).isNotNull(), name))
    return df.select(*[c for c in df.columns if not c.startswith("_value")], F.coalesce(*found).alias(value), F.coalesce(*names).alias("origin"))


def zip_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: str, right_order: str, ordinal: str = "ordinal") -> DataFrame:
    """The n-th row of left with the n-th of right for each key."""
    number = lambda df, order: df.withColumn(ordinal, F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    return number(left, left_order).join(number(right, right_order), [*keys, ordinal], "left")


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, values: Sequence[str], before: bool = True, tie: str | None = None) -> DataFrame:
    """For each left row the values of the nearest right row at or before it (or at or after it), of equals the one of the least tie: one shuffle, one sort."""
    _free(left, "_at", "_kind", "_tie", "_mark", "_found", *(f"_r_{v}" for v in values))
    kind = F.lit(0).alias("_kind")
    names = {v: f"_r_{v}" for v in values}
    rows = left.select(*left.columns, F.col(left_at).alias("_at"), kind, *(F.lit(None).cast(right.schema[v].dataType).alias(n) for v, n in names.items()))
    told = F.col(tie) if tie else F.lit(0)
    marks = right.select(*keys, F.col(right_at).alias("_at"), F.lit(-1 if before else 1).alias("_kind"), told.alias("_tie"), *(F.col(v).alias(n) for v, n in names.items()))
    both = rows.unionByName(marks.withColumn("_mark", F.lit(True)), allowMissingColumns=True)
    order = ("_at", "_kind", F.desc("_tie")) if before else (F.desc("_at"), F.desc("_kind"), F.desc("_tie"))  # the frame runs from the far end, so each row is added once
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    value = F.when(F.col("_mark"), F.struct(*(F.col(n).alias(v) for v, n in names.items())))
    out = both.withColumn("_found", F.last(value, ignorenulls=True).over(frame)).where("_kind = 0")
    return out.select(*left.columns, *(F.col("_found")[v].alias(names[v][3:] if v not in left.columns else f"{v}_found") for v in values))


def islands(df: DataFrame, keys: Sequence[str], order: str, *same: str, name: str = "island") -> DataFrame:
    """Numbers the runs of neighbouring rows with equal values of ``same``, from 1."""
    _free(df, "_new", name)
    w = Window.partitionBy(*keys).orderBy(order)
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    first = F.row_number().over(w) == 1
    return df.withColumn("_new", F.when(changed | first, 1).otherwise(0)).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def collapse_repeats(df: DataFrame, keys: Sequence[str], order: str, value: str, only: str | None = None) -> DataFrame:
    """Drops rows that repeat the value of the row before; with only, of that value alone."""
    _free(df, "_again")
    w = Window.partitionBy(*keys).orderBy(order)
    again = F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1)
    if only is not None:
        again = again & (F.col(value) == only)
    return df.withColumn("_again", again).where("not _again").drop("_again")


def running_cap(df: DataFrame, keys: Sequence[str], order: str, size: Column, most_rows: int, most_size: int) -> DataFrame:
    """Rows in order as long as their number and total size stay within bounds."""
    _free(df, "_n", "_total", "running_total")
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_total", F.sum(size).over(w))
    return out.where((F.col("_n") <= most_rows) & (F.col("_total") <= most_size)).drop("_n").withColumnRenamed("_total", "running_total")


def count_by(df: DataFrame, *keys: Column, unknown: str = "unknown", name: str = "n") -> DataFrame:
    """How many rows each key has; null and empty keys are unknown."""
    return df.groupBy(*(F.coalesce(F.nullif(k.cast("string"), F.lit("")), F.lit(unknown)).alias(f"key{i or ''}") for i, k in enumerate(keys))).agg(F.count(F.lit(1)).alias(name))


def within(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, end: str, bucket: int | None = None) -> DataFrame:
    """Points inside spans of the same key, null bounds matching none.

    With a bucket, about as wide as spans are, key and bucket of at are joined, so that of a key's points and spans only neighbours
    meet; a span is repeated for each bucket that it reaches into. Columns of both sides but the keys must differ.
    """
    on = list(keys)
    _free(points, *(c for c in spans.columns if c not in on), "_bucket")
    if bucket:
        name = "_bucket"
        points = points.withColumn(name, F.floor(F.col(at) / bucket))
        spans = spans.where(F.col(start) <= F.col(end)).withColumn(name, F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
        on = [*on, name]
    out = points.join(spans, on).where(F.col(at).between(F.col(start), F.col(end)))
    return out.drop("_bucket") if bucket else out


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], distance: Column, tie: Column, values: Sequence[str], of: Sequence[str]) -> DataFrame:
    """For each left row, named by ``of``, the values of the right row of its key at the least distance."""
    _free(left, *(c for c in right.columns if c not in keys), "_best")
    best = F.min_by(F.struct(*values), F.struct(distance, tie))
    return left.join(right, list(keys)).groupBy(*of).agg(best.alias("_best")).select(*of, *(F.col("_best")[v].alias(v) for v in values))
