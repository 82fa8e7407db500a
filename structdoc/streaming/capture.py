"""Capture as streams: requests met with their ends, quiet periods, and the state of a rolling capture."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def timed(df: DataFrame, column: str = "ts", late: str = "10 minutes") -> DataFrame:
    """With an event time that watermarks take, and the watermark."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def correlate(received: DataFrame, finished: DataFrame, key: str, within: str, received_at: str = "received_at", finished_at: str = "finished_at") -> DataFrame:
    """Responses with the ends of their loading, by request id and at most ``within`` later. Both sides need watermarks."""
    a, b = received.alias("a"), finished.withColumnRenamed(key, "_key").alias("b")
    met = (F.col(f"a.{key}") == F.col("b._key")) & (F.col(finished_at) >= F.col(received_at)) & (F.col(finished_at) <= F.col(received_at) + F.expr(f"INTERVAL {within}"))
    return a.join(b, met).drop("_key")


def correlate_all(received: DataFrame, finished: DataFrame, key: str, within: str, received_at: str = "received_at", finished_at: str = "finished_at") -> DataFrame:
    """Responses with the ends of their loading like correlate(), and those of either side that met none: with ``outcome``, met, no_end or no_response.

    On streams both sides need watermarks: a row that meets nothing is reported, and leaves the state, when the watermark has passed the time in which it could. A response that met
    an end isn't reported again; one that met several is there with each. Rows with a null key or time meet nothing; on tables they are reported, a stream drops rows without a time. Columns of both sides but the key must differ.
    """
    other = f"{key}_of_end"
    a, b = received, finished.withColumnRenamed(key, other)
    met = (F.col(key) == F.col(other)) & (F.col(finished_at) >= F.col(received_at)) & (F.col(finished_at) <= F.col(received_at) + F.expr(f"INTERVAL {within}"))
    both = a.join(b, met, "full_outer")
    outcome = F.when(F.col(received_at).isNotNull() & F.col(finished_at).isNotNull(), "met").when(F.col(received_at).isNotNull() | F.col(key).isNotNull(), "no_end").otherwise("no_response")
    rest = [c for c in both.columns if c not in (key, other)]
    return both.select(F.coalesce(key, other).alias(key), *rest, outcome.alias("outcome"))


def quiet_sessions(df: DataFrame, keys: list[str], at: str, quiet: str, longest: str | None = None) -> DataFrame:
    """Sessions that end after a quiet period: keys, start, end, n, and with a longest time whether it stopped them. Works on streams with a watermark and on tables.

    A session that goes on past the longest time ends there; n counts its events up to then.
    """
    w = F.session_window(at, quiet).alias("w")
    if longest is None:
        out = df.groupBy(*keys, w).agg(F.count(F.lit(1)).alias("n"))
        return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    out = df.groupBy(*keys, w).agg(F.collect_list(F.col(at)).alias("_times"))
    stop = F.col("w.start") + F.expr(f"INTERVAL {longest}")
    kept = F.size(F.filter("_times", lambda t: t <= stop)).cast("long")
    return out.select(*keys, F.col("w.start").alias("start"), F.least(F.col("w.end"), stop).alias("end"), kept.alias("n"), (F.col("w.end") > stop).alias("stopped"))


STATE = "value double, seq long, seen long"


def _keep_best(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    value, seq, seen = state.get if state.exists else (float("-inf"), -1, 0)
    for pdf in batches:
        seen += len(pdf)
        for v, s in zip(pdf["value"], pdf["seq"], strict=True):
            if v > value or (v == value and s < seq):
                value, seq = float(v), int(s)
    state.update((value, seq, seen))
    yield pd.DataFrame({"key": [key[0]], "value": [value], "seq": [seq], "seen": [seen]})


def rolling_best(items: DataFrame) -> DataFrame:
    """Of a stream items(key string, value double, seq long) the best item of each key so far, in update mode: a larger value replaces the one held, the first of equals stays."""
    return items.groupBy("key").applyInPandasWithState(_keep_best, "key string, value double, seq long, seen long", STATE, "update", GroupStateTimeout.NoTimeout)
