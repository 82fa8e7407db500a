"""Rolling capture: a page is observed in passes, what is seen is kept by the rules of its kind, and the capture stops when passes add nothing.

A pass is a stretch of event time. Its observations are applied in the order of their numbers once the watermark has left it, so rows
that come late, but not too late, count like the others. A capture stops after ``stable`` passes in a row that changed nothing, and then gives its items;
what a page shows later is no longer looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What is known of an item besides its page, kind and key.
VALUES = "seq long, round long, area double, anchored boolean, referenced boolean, text string, top double"
ITEMS = "page string, kind string, key string, place int, " + VALUES + ", stopped_round long"
FIELDS = [x.split()[0] for x in VALUES.split(", ")]


def replaces(kind: str, new: tuple, held: tuple | None) -> bool:
    """Whether an observation, in the order of FIELDS, takes the place of the item held.

    Media: a larger area, or the first text next to it. Code: another text. Formulas: the first reference. Other kinds: never.
    """
    if held is None:
        return True
    if kind == "media":
        return new[2] > held[2] or (new[3] and not held[3])
    if kind == "code":
        return new[5] != held[5]
    return kind == "formula" and new[4] and not held[4]


def observed(df: DataFrame, every: str) -> DataFrame:
    """Observations in the columns that a capture takes, with the pass of each; rows without a time, kind or key are left out."""
    length = F.expr(f"CAST(INTERVAL {every} AS INTERVAL SECOND)").cast("long") * 1_000_000
    return df.where("at is not null and kind is not null and key is not null").select(
        F.col("page").cast("string").alias("page"),
        "kind",
        F.col("key").cast("string").alias("key"),
        F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"),
        F.floor(F.unix_micros("at") / length).cast("long").alias("round"),
        F.coalesce(F.col("area").cast("double"), F.lit(0.0)).alias("area"),
        F.coalesce("anchored", F.lit(False)).alias("anchored"),
        F.coalesce("referenced", F.lit(False)).alias("referenced"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("top").cast("double"), F.lit(0.0)).alias("top"),
        "at",
    )


class Capture(StatefulProcessor):
    """The state of a page: observations of open passes, items held, and how far the capture is. A timer waits for the end of each pass."""

    def __init__(self, pass_ms: int, stable: int):
        self.pass_ms, self.stable = pass_ms, stable

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "round long, seq long, kind string, key string", VALUES)
        self.items = handle.getMapState("items", "kind string, key string", VALUES)
        self.progress = handle.getValueState("progress", "changed long, stopped boolean")  # the last pass that changed something

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        stopped = self.progress.exists() and self.progress.get()[1]
        passes = set()
        for frame in rows:
            if stopped:
                continue
            values = frame[FIELDS].astype({"seq": int, "round": int, "area": float, "anchored": bool, "referenced": bool, "top": float})
            for kind, name, value in zip(frame["kind"], frame["key"], values.itertuples(index=False, name=None), strict=True):
                at = (value[1], value[0], kind, name)
                if not self.pending.containsKey(at) or tuple(self.pending.getValue(at)) < value:
                    self.pending.updateValue(at, value)
                passes.add(value[1])
        for p in passes:
            self.handle.registerTimer((p + 1) * self.pass_ms)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs() // self.pass_ms - 1
        changed, stopped = self.progress.get() if self.progress.exists() else (None, False)
        if stopped:
            return
        if changed is not None and now > changed + self.stable:
            yield self._stop(key, changed)  # the watermark has jumped over the pass in which it stopped
        elif self._apply(now):
            self._changed(now)
        elif changed is not None and now == changed + self.stable:
            yield self._stop(key, changed)

    def _apply(self, now: int) -> bool:
        """Applies the observations of a pass in their order; whether an item changed."""
        own = sorted(((tuple(k), tuple(v)) for k, v in self.pending.iterator() if k[0] == now), key=lambda x: x[0])
        changed = False
        for at, value in own:
            held = tuple(self.items.getValue(at[2:])) if self.items.containsKey(at[2:]) else None
            if replaces(at[2], value, held):
                self.items.updateValue(at[2:], value)
                changed = True
            self.pending.removeKey(at)
        return changed

    def _changed(self, now: int) -> None:
        self.progress.update((now, False))
        self.handle.registerTimer((now + self.stable + 1) * self.pass_ms)

    def _stop(self, key, changed: int) -> pd.DataFrame:
        held = sorted(((tuple(k), tuple(v)) for k, v in self.items.iterator()), key=lambda x: (x[0][0], x[1][-1], x[1][0], x[0][1]))
        self.items.clear()
        self.pending.clear()
        self.progress.update((changed, True))
        out, last, place = [], None, 0
        for (kind, name), value in held:
            place = place + 1 if kind == last else 1
            last = kind
            out.append((key[0], kind, name, place, *value, changed + self.stable))
        return pd.DataFrame(out, columns=["page", "kind", "key", "place", *FIELDS, "stopped_round"]).astype({"place": "int32"})

    def close(self) -> None:
        pass


def rolling_capture(observations: DataFrame, every: str = "1 minute", stable: int = 2, late: str = "10 minutes") -> DataFrame:
    """The items of each page's capture, when it stops: a stream, in append mode, of a stream observations(page, kind, key, seq, at, area, anchored, referenced, text, top).

    Pages have state in the RocksDB provider, which spark.sql.streaming.stateStore.providerClass must name. Passes are ``every`` long; rows later than the watermark
    allows are dropped by Spark. A null page is a page of its own. Of rows that repeat a page, pass, seq, kind and key the largest counts.
    """
    timed = observed(observations.withWatermark("at", late), every)
    pass_ms = int(observations.sparkSession.sql(f"SELECT CAST(CAST(INTERVAL {every} AS INTERVAL SECOND) AS LONG) * 1000").first()[0])
    return timed.groupBy("page").transformWithStateInPandas(statefulProcessor=Capture(pass_ms, stable), outputStructType=ITEMS, outputMode="append", timeMode="eventTime")


def _changes(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of page, kind, key, pass and seq -> those that replaced what was held. Holds one item."""
    own, held, seen = None, None, None
    for batch in batches:
        keep = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:3] != own:
                own, held, seen = row[:3], None, None
            value = row[3:]
            if value[:2] != seen:  # of repeated rows the first, which is the largest
                seen = value[:2]
                if replaces(row[1], value, held):
                    held = value
                    keep.append(True)
                    continue
            keep.append(False)
        yield batch.filter(pa.array(keep, pa.bool_())).select(columns)


def captured_items(observations: DataFrame, every: str = "1 minute", stable: int = 2) -> DataFrame:
    """The rows that rolling_capture() gives when all observations have come, of a table of them: all captures have stopped.

    Items change one after the other, so an item's observations are read in their order by one task, which holds one of them; pages are spread by their items.
    """
    rows = observed(observations, every).drop("at")
    order = ["page", "kind", "key", "round", "seq"]
    rows = rows.select("page", "kind", "key", *FIELDS).repartition("page", "kind", "key")
    rows = rows.sortWithinPartitions(*order, *(F.desc(c) for c in FIELDS[2:]))
    changes = rows.mapInArrow(partial(_changes, columns=rows.columns), rows.schema)
    passes = changes.groupBy("page", "round").agg(F.count("*").alias("n"))
    following = F.lead("round").over(Window.partitionBy("page").orderBy("round"))
    stops = passes.withColumn("following", following).where(F.col("following").isNull() | (F.col("following") > F.col("round") + stable))
    stops = stops.groupBy(F.col("page").alias("of")).agg((F.min("round") + stable).alias("stopped_round"))
    held = changes.join(stops, F.col("page").eqNullSafe(F.col("of"))).where("round <= stopped_round")
    best = held.groupBy("page", "kind", "key", "stopped_round").agg(F.max(F.struct("round", "seq", *FIELDS[2:])).alias("v"))
    best = best.select("page", "kind", "key", *(F.col("v")[c].alias(c) for c in FIELDS), "stopped_round")
    place = F.row_number().over(Window.partitionBy("page", "kind").orderBy("top", "seq", "key")).cast("int")
    return best.withColumn("place", place).select(*(x.split()[0] for x in ITEMS.split(", ")))
