from pyspark.sql import functions as F
from structdoc.operators import dom, lookup
from structdoc.sources.html import html_nodes, read_html
from structdoc.sources.sinks import data_urls, write_documents, write_html, write_json
from structdoc.streaming import capture

HTML = """<html><body><nav><p>skip me</p></nav><article><h2>Head <b>bold</b></h2><p>One<p>Two &amp; three<br>line
<ul><li>a<ol start=3><li>b</ol><li>c</ul><pre class="lang-js"><code>const x = 1;
</code></pre><blockquote><p>inner</p></blockquote><table><tr><th colspan=2>h</th></tr><tr><td>1<td>2</tr></table>
<figure><img src="https://pbs.twimg.com/media/A.jpg" alt="alt"><figcaption>cap</figcaption></figure><hr><script>var p = "</p>";</script></article></body></html>"""


def nodes(spark):
    return html_nodes(spark.createDataFrame([(1, HTML), (2, None), (3, "<p>unclosed")], "page_id long, html string")).persist()


def test_intervals_nest():
    rows = read_html(1, HTML)
    spans = {r[1]: (r[3], r[4]) for r in rows}
    assert all(spans[r[2]][0] < r[3] and spans[r[2]][1] > r[4] for r in rows if r[2] is not None)
    assert sorted(x for s in spans.values() for x in s) == list(range(2 * len(rows)))


def test_blocks_of_a_page(spark):
    got = dom.page_blocks(nodes(spark)).where("page_id = 1").orderBy("block_idx").collect()
    assert [r.type for r in got] == ["heading", "paragraph", "paragraph", "list", "code", "blockquote", "table", "figure", "separator"]
    assert (got[0].level, got[0].html, got[2].html, got[4].language, got[7].caption) == (2, "Head <strong>bold</strong>", "Two &amp; three<br>line", "js", "cap")


def test_lists_and_tables(spark):
    items = dom.list_items(nodes(spark)).orderBy("item_id").collect()
    assert [(r.pos, r.ordered, r.start, r.parent_item_id is not None) for r in items] == [(0, False, None, False), (0, True, 3, True), (1, False, None, False)]
    cells = dom.table_cells(nodes(spark)).orderBy("row", "column").collect()
    assert [(r.row, r.column, r.header, r.html, r.colspan) for r in cells] == [(0, 0, True, "h", 2), (1, 0, False, "1", None), (1, 1, False, "2", None)]


def test_fallbacks_and_nearest(spark):
    left = spark.createDataFrame([(1, 10), (1, 50), (2, 5)], "k int, at int")
    right = spark.createDataFrame([(1, 12, "a"), (1, 45, "b")], "k int, mark int, name string")
    best = lookup.nearest(left, right, ["k"], F.abs(F.col("at") - F.col("mark")), F.col("mark"), ["name"], ["k", "at"])
    assert sorted(map(tuple, best.collect())) == [(1, 10, "a"), (1, 50, "b")]
    out = lookup.asof(left, right.withColumnRenamed("mark", "at"), ["k"], "at", "at", ["name"])
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, 10, None), (1, 50, "b"), (2, 5, None)], key=repr)


def stream(spark, tmp_path, df, name):
    df.coalesce(1).write.parquet(str(tmp_path / name))  # files come by their times, so several could come out of order
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))


def drain(df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def test_streamed_sessions_and_correlation(spark, tmp_path):
    base = spark.sql("SELECT CAST(id AS STRING) id, timestamp'2024-01-01' + make_interval(0,0,0,0,0,0,CAST(id * 40 AS DECIMAL(18,6))) ts, id % 2 k FROM range(30)")
    late = spark.sql("SELECT 'end' id, timestamp'2024-01-03' ts, 0L k")
    events = base.unionByName(late).repartition(1).sortWithinPartitions("ts")
    batch = {tuple(r) for r in capture.quiet_sessions(events, ["k"], "ts", "100 seconds").collect()}
    streamed = drain(capture.quiet_sessions(capture.timed(stream(spark, tmp_path, events, "e")), ["k"], "ts", "100 seconds"), "sessions", "append")
    assert {tuple(r) for r in streamed.collect()} == {s for s in batch if s[2].day < 3}
    received = capture.timed(stream(spark, tmp_path, base.select("id", F.col("ts").alias("received_at")), "r"), "received_at")
    done = base.select("id", (F.col("ts") + F.expr("INTERVAL 5 seconds")).alias("finished_at")).where("id <> '3'")
    finished = capture.timed(stream(spark, tmp_path, done, "f"), "finished_at")
    assert drain(capture.correlate(received, finished, "id", "10 seconds"), "met", "append").count() == 29


def test_rolling_capture_keeps_the_best(spark, tmp_path):
    items = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 2), ("b", 2.0, 3), ("a", 3.0, 4)], "key string, value double, seq long").repartition(3)
    last = drain(capture.rolling_best(stream(spark, tmp_path, items, "i")), "rolling", "update").groupBy("key").agg(F.max_by(F.struct("value", "seq"), "seen").alias("x"))
    assert {(r.key, r.x.value, r.x.seq) for r in last.collect()} == {("a", 3.0, 2), ("b", 2.0, 3)}


def test_sinks(spark, tmp_path):
    from structdoc.plans import literals as L
    from structdoc.plans.article import parse_articles

    articles, blocks = parse_articles(*L.tables(spark))
    write_documents(articles, blocks, str(tmp_path / "d"))
    write_json(articles, blocks, str(tmp_path / "j"))
    write_html(L.render_html(spark, ""), str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "d/blocks")).count() == 26 and spark.read.json(str(tmp_path / "j")).count() == 3
    (tmp_path / "m").mkdir()
    (tmp_path / "m/x.png").write_bytes(b"abc")
    (tmp_path / "m/x.txt").write_bytes(b"abc")
    files = spark.read.format("binaryFile").load(str(tmp_path / "m"))
    assert [r.data_url for r in data_urls(files).collect()] == ["data:image/png;base64,YWJj"]


def test_what_meets_nothing_is_reported(spark, tmp_path):
    base = spark.sql("SELECT CAST(id AS STRING) id, timestamp'2024-01-01' + make_interval(0,0,0,0,0,0,CAST(id * 40 AS DECIMAL(18,6))) received_at FROM range(30)")
    done = base.select("id", (F.col("received_at") + F.expr("INTERVAL 5 seconds")).alias("finished_at")).where("id <> '3'")
    done = done.unionByName(spark.sql("SELECT 'stray' id, timestamp'2024-01-01 00:07:00' finished_at")).unionByName(spark.sql("SELECT '9' id, timestamp'2024-01-01 00:06:03' finished_at"))  # 9 ends twice
    late = [("end", "2024-01-03"), ("last", "2024-01-05")]  # both sides go on, so that the watermark passes
    told = lambda name: spark.createDataFrame(late, "id string, t string").select("id", F.col("t").cast("timestamp").alias(name))
    want = {(str(i), "met" if i != 3 else "no_end") for i in range(30)} | {("stray", "no_response")}
    table = capture.correlate_all(base, done, "id", "10 seconds")
    assert {(r.id, r.outcome) for r in table.collect()} == want and table.count() == 32
    received = capture.timed(stream(spark, tmp_path, base.unionByName(told("received_at")).repartition(1).sortWithinPartitions("received_at"), "ra"), "received_at")
    finished = capture.timed(stream(spark, tmp_path, done.unionByName(told("finished_at")).repartition(1).sortWithinPartitions("finished_at"), "fa"), "finished_at")
    got = drain(capture.correlate_all(received, finished, "id", "10 seconds"), "outcomes", "append").collect()
    assert {(r.id, r.outcome) for r in got if r.id not in ("end", "last")} == want
    assert sum(r.id == "9" for r in got) == 2 and sum(r.id == "3" for r in got) == 1
    empty = capture.correlate_all(base.limit(0), done.limit(0), "id", "10 seconds")
    nulls = spark.sql("SELECT CAST(NULL AS STRING) id, timestamp'2024-01-01' received_at")
    assert empty.count() == 0 and [r.outcome for r in capture.correlate_all(nulls, done.limit(0), "id", "10 seconds").collect()] == ["no_end"]
