"""The rolling capture as a stream and as a table, against a plain loop."""

import datetime
import random

import pytest
from pyspark.sql import functions as F
from structdoc.streaming import rolling

SCHEMA = "page string, kind string, key string, seq long, at timestamp, area double, anchored boolean, referenced boolean, text string, top double, items string"
START = datetime.datetime(2024, 1, 1)


def plain(rows, minutes=1, stable=2):
    """page -> (stopped_round, {(kind, key): (seq, pass)})."""
    pages = {}
    for r in rows:
        if None not in (r[1], r[2], r[4]):
            pages.setdefault(r[0], []).append(r)
    out = {}
    for page, own in pages.items():
        passes, held, changed = {}, {}, None
        for r in own:
            passes.setdefault(int((r[4] - datetime.datetime(1970, 1, 1)).total_seconds()) // (60 * minutes), []).append(r)
        for now in range(min(passes), max(passes) + stable + 2):
            for r in sorted(passes.get(now, ()), key=lambda r: r[3] or 0):
                old = held.get((r[1], r[2]))
                area, anchored, referenced, text = r[5] or 0.0, bool(r[6]), bool(r[7]), r[8] or ""
                if old is None or (r[1] == "media" and (area > old[2] or (anchored and not old[3]))) or (r[1] == "code" and text != old[5]) or (r[1] == "formula" and referenced and not old[4]):
                    held[r[1], r[2]] = (r[3] or 0, now, area, anchored, referenced, text)
                    changed = now
            if changed is not None and now == changed + stable:
                break
        out[page] = (changed + stable, {k: v[:2] for k, v in held.items()})
    return out


def observations(seed=2):
    rng, rows = random.Random(seed), []
    for page in ("a", "b", "c", None):
        at = 0
        for i in range(120):
            at += rng.choice([1, 5, 20, 40, 40, 130])
            kind = rng.choice(["media", "media", "code", "formula", "other"])
            rows.append((page, kind, str(rng.randrange(3)), len(rows), START + datetime.timedelta(seconds=at), float(rng.randrange(20 + i)), rng.random() < 0.2, rng.random() < 0.2, rng.choice(["x", "y", None]), rng.random(), "clash"))
    rows += [rows[3], rows[3], ("a", None, "1", 900, START, 1.0, None, None, None, None, None), ("d", "media", "k", None, START, None, None, None, None, None, None), ("e", "media", "k", 1, None, 1.0, None, None, None, None, None)]
    return rows


def seen(rows):
    out = {}
    for r in rows:
        out.setdefault(r.page, (r.stopped_round, {}))[1][r.kind, r.key] = (r.seq, r["round"])
    return out


def test_table_equals_the_loop(spark):
    rows = observations()
    got = rolling.captured_items(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    want = plain(rows)
    assert seen(got) == want
    assert any(stop < max(p for _, p in held.values()) + 3 for stop, held in want.values())
    for page in {r.page for r in got}:
        for kind in {r.kind for r in got}:
            own = sorted((r.place, r.top, r.seq) for r in got if r.page == page and r.kind == kind)
            assert [x[0] for x in own] == list(range(1, len(own) + 1)) and [x[1:] for x in own] == sorted(x[1:] for x in own)
    assert rolling.captured_items(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def test_stream_with_late_rows_and_a_restart_equals_the_table(spark, tmp_path, rocksdb):
    rows = sorted((r for r in observations() if r[4] is not None), key=lambda r: r[4])
    end = (None, "other", "end", 5000, START + datetime.timedelta(days=2), 0.0, False, False, "", 0.0, "")
    late, rows = [r for i, r in enumerate(rows) if i % 9 == 4], [r for i, r in enumerate(rows) if i % 9 != 4]
    half = len(rows) // 2
    middle = rows[half][4]
    files = [rows[:half], [r for r in late if middle - datetime.timedelta(minutes=8) < r[4]] + rows[half:], [end], [(*end[:4], end[4] + datetime.timedelta(hours=2), *end[5:])]]
    counted = rows + [r for r in late if middle - datetime.timedelta(minutes=8) < r[4]]

    def run(i):
        frame = spark.createDataFrame(files[i], SCHEMA).coalesce(1)
        frame.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
        out = rolling.rolling_capture(stream, "1 minute", 2, "10 minutes")
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()

    for i in range(len(files)):  # each run goes on from the checkpoint of the one before
        run(i)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = {p: x for p, x in plain(counted).items()}
    assert seen(got.collect()) == want
    table = rolling.captured_items(spark.createDataFrame(counted, SCHEMA))
    columns = got.columns
    assert sorted(map(repr, got.select(columns).collect())) == sorted(map(repr, table.select(columns).collect()))
    assert got.groupBy("page", "kind", "key").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
