"""Documents of pages: elements are read and dealt out once, however oddly they are nested."""

import __spark_entry__
import pytest
from structdoc.operators import page
from structdoc.sources.html import html_nodes

SF = "/root/testdata/sf0.001"
LONG = "w " * 400


@pytest.mark.parametrize("name", ["page_documents", "page_document_blocks"])
def test_elements_are_read_and_dealt_out_once(spark, name):
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("hashpartitioning") <= 3 and "InMemoryTableScan" not in plan


def test_parts_go_with_what_they_stand_in(spark):
    html = f"""<html><head><title>A title of it</title></head><body><nav><p>skipped text</p></nav><article><p>{LONG}</p>
    <ul><li>a &amp; b<ol><li>c</li></ol></li><div><li>no item</li></div><li>d</li></ul><blockquote><p>q1<br><br><br></p><div><p>q2</p></div></blockquote><blockquote>bare</blockquote>
    <table><tr><td>1<table><tr><td>inner</td></tr></table></td><th>2</th></tr><tr><td></td></tr><td>no row</td></table><div role="paragraph">holds <p>this one</p></div>
    <figure><img src="a.jpg" alt="x"><img src="b.jpg"><figcaption>first</figcaption></figure></article></body></html>"""
    pages = spark.createDataFrame([(1, "https://x.com/u/article/1", html), (2, "https://x.com/v/article/2", None), (None, "https://x.com/w", html)], "page_id long, url string, html string")
    documents, blocks = page.page_articles(pages, html_nodes(pages))
    rows = blocks.orderBy("block_idx").collect()
    assert [(r.doc_id, r.block_idx, r.type) for r in rows] == [(1, i, t) for i, t in enumerate(["paragraph", "list", "blockquote", "blockquote", "table", "paragraph", "figure"])]
    assert [(x["depth"], x["ordered"], x["html"]) for x in rows[1]["items"]] == [(0, False, "a &amp; b"), (1, True, "c"), (0, False, "d")]
    assert rows[2].paragraphs == ["q1", "q2"] and rows[3].paragraphs == ["bare"] and [r[1:] for r in rows[4].rows] == [["2"]] and (rows[6].src, rows[6].alt, rows[6].caption) == ("a.jpg", "x", "first")
    assert sorted((str(r.doc_id), r.title, r.author_handle, r.blocks) for r in documents.collect()) == [("1", "A title of it", "u", 7), ("2", None, "v", 0), ("None", None, None, 0)]
