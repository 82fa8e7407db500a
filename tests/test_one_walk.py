"""Payloads and pages are read once, and only for what a query asks."""

import re

import __spark_entry__
from structdoc.sources.payloads import json_objects

SF = "/root/testdata/sf0.001"
BODY = '{"id":"a","content_state":{"blocks":[{"text":"t"}]},"x":{"type":"photo","media_url":"https://a.example/b.jpg","n":[1,true,null,{"y":"{\\"z\\":1.5}"}]}}'


def test_asked_columns_are_those_of_the_whole_walk(spark):
    payloads = spark.createDataFrame([(1, 0, BODY), (2, 0, None), (3, 0, "[]")], "capture_id long, payload_idx int, body string")
    whole = json_objects(payloads)
    for name in whole.columns:
        assert json_objects(payloads, ("seq", name)).collect() == whole.select(*dict.fromkeys(c for c in whole.columns if c in ("seq", name))).collect()
    held = whole.where("size(media_urls) > 0").select("seq", "path").collect()
    assert held and json_objects(payloads, ("seq", "path"), having="media_urls").collect() == held


def test_formulas_take_one_walk(spark):
    plan = __spark_entry__.queries()["formula_index"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_pages_are_read_once(spark):
    plan = __spark_entry__.queries()["page_titles"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" in plan


ODD = (
    '{"²":{"id":"s"},"3":{"id":"n"},"screen_name":"h","name":"N","core":{"user_results":{"result":{"legacy":{"name":"A","screen_name":"b"}}}},"rest_id":"7","full_text":"x","created_at":"2024-01-01",'
    '"m":{"__typename":"Photo","url":"https://pbs.twimg.com/media/a.jpg","sizes":{"large":{"w":3}}},"f":{"kind":"LaTeX","value":"a_1"},"tex":{"display":"b^2"},"g":{"latex":"c"},"plain":[[],{"text":"no","n":[1,{}]}],'
    '"body":"{\\"blocks\\":[{\\"text\\":\\"t\\",\\"depth\\":2,\\"data\\":{\\"id\\":3}}],\\"title\\":\\"In a string\\"}","title":"Title","content_state":{"blocks":[{"text":"u","inline_style_ranges":[{"offset":-1,"length":true,"style":"x"}]}]}}'
)


def test_what_tells_nothing_changes_no_article(spark):
    from structdoc.operators import metadata

    payloads = spark.createDataFrame([(1, 0, BODY), (2, 0, ODD), (3, 0, None)], "capture_id long, payload_idx int, body string")
    whole, told = json_objects(payloads), json_objects(payloads, metadata.COLUMNS, names=metadata.FIELDS, keep=metadata.tells)
    assert 0 < told.count() < whole.count() and "keys" not in told.columns
    expected = spark.createDataFrame([(1, "a"), (2, "7"), (3, None)], "capture_id long, expected_id string")
    urls = spark.createDataFrame([(1, None), (2, "https://x.com/h/article/7"), (3, "")], "capture_id long, article_url string")
    finders = (
        lambda o: metadata.best_article(o, expected).select("capture_id", "path", "title", "score", "content_state"), lambda o: metadata.author(o, urls), lambda o: metadata.post_metadata(o, expected),
        metadata.media_index, metadata.post_index, metadata.formula_index,
    )
    for find in finders:
        rows = sorted(map(repr, find(whole).collect()))
        assert rows and sorted(map(repr, find(told).collect())) == rows


def test_large_inputs_have_parts_of_bounded_size(spark, tmp_path):
    from structdoc.plans import tables

    spark.range(2000).selectExpr("id AS doc_id", "repeat(md5(CAST(id AS STRING)), 20) AS text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    size = sum(p.stat().st_size for p in tmp_path.rglob("*.parquet") if p.is_file())
    assert tables.parts(spark, str(tmp_path), "documents", most=size // 40) in (40, 41)
    assert tables.parts(spark, str(tmp_path), "documents") == spark.sparkContext.defaultParallelism
    assert tables.fine(spark, str(tmp_path), "documents", most=size // 40).rdd.getNumPartitions() in (40, 41)


def test_contained_blocks_pass_in_order_without_groups(spark):
    from structdoc.operators.blocks import drop_contained

    long = "abcdefghij" * 3
    texts = [(d, n, "paragraph", t) for d in (1, 2) for n, t in enumerate((long, f"{long}{d}", f"x{long}", "short", "short", *(f"{n}" * 25 for n in range(5)), long))] + [(1, 20, "list", long), (1, 21, "paragraph", f"{long}z")]
    blocks = spark.createDataFrame(texts[::-1], "doc_id long, block_idx int, type string, text string").selectExpr("*", "CAST(NULL AS STRING) AS html")
    found = drop_contained(blocks)
    assert found.columns == blocks.columns
    assert sorted((r.doc_id, r.block_idx) for r in found.collect()) == [*((1, n) for n in (0, 3, 4, 5, 6, 7, 8, 9, 10, 20)), *((2, n) for n in (0, 3, 4, 5, 6, 7, 8, 9, 10))]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "Join" not in plan


def test_elements_have_only_what_is_written(spark):
    from structdoc.sources.html import html_nodes

    pages = spark.createDataFrame([(1, "<body><p>a <b>b</b></p><ul><li>c<ul><li>d</li></ul></li></ul></body>"), (2, None)], "page_id long, html string")
    whole = html_nodes(pages)
    for written in ((), ("text",), ("html",)):
        bare = [c for c in whole.columns if c in written or c not in ("text", "html")]
        some = html_nodes(pages, written)
        assert some.select(*bare).collect() == whole.select(*bare).collect()
        assert some.select(*(c for c in ("text", "html") if c not in written)).distinct().count() == (1 if len(written) < 2 else 0)


def test_markdown_lines_are_placed_once(spark):
    plan = __spark_entry__.queries()["markdown_blocks"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" in plan


def test_blocks_are_read_once_for_completeness(spark):
    from structdoc.operators import blocks as B

    rows = [(1, 0, "paragraph", "The following code:", None), (1, 1, "code", None, "x"), (1, 2, "paragraph", "The following code:", None), (2, 0, "heading", "<b>following code</b>:", None), (None, 0, "paragraph", "following code", None)]
    blocks = spark.createDataFrame(rows, "doc_id long, block_idx int, type string, html string, text string")
    found = B.completeness(blocks, spark.createDataFrame([(2, "e")], "doc_id long, entity_reference string"))
    assert sorted((str(r.doc_id), r.blocks, r.codes, r.gaps, r.unresolved, r.status) for r in found.collect()) == [("1", 3, 1, 1, 0, "warning"), ("2", 1, 0, 1, 1, "warning"), ("None", 1, 0, 0, 0, "ok")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"LogicalRDD \[doc_id#\d+L?, block_idx", plan)) == 1


def test_only_texts_with_tags_take_the_parser(spark, monkeypatch):
    from pyspark.sql import functions as F
    from structdoc.operators import render

    texts = ["plain > text", "a &amp; b &lt;i&gt; &eacute &#x41; &bogus; &amp", "x < y", "<b>c</b> > d", "", None, " \r\n\x00>", "&lt;" * 40 + "&am"]
    parser = []
    for t in texts:
        cleaner = render._Clean()
        cleaner.feed(t or "")
        cleaner.close()
        parser.append("".join(cleaner.out) + "".join(f"</{x}>" for x in reversed(cleaner.open)))
    asked = spark.createDataFrame(list(enumerate(texts)), "i int, html string").select("i", render.sanitized(F.col("html")).alias("a"), render.sanitize("html").alias("b"))
    assert [(r.a, r.b) for r in asked.orderBy("i").collect()] == [(p, p) for p in parser]
    monkeypatch.setattr(render._Clean, "feed", None)
    assert render.clean_inline("plain > &amp; text") == "plain &gt; &amp; text"
