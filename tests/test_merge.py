"""Captured items among the blocks of pages: ties, wrong anchors, missing places, and images' addresses."""

from pyspark.sql import functions as F
from structdoc.operators import inventory, merge, page
from structdoc.sources.html import html_nodes

BLOCK = "doc_id long, block_idx int, type string, html string, text string, latex string, mathml string, src string, source_url string"
ITEM = "doc_id long, type string, html string, text string, latex string, mathml string, src string, source_url string, top double, seq int, junk string"


def block(doc, idx, text, kind="paragraph", src=None):
    return (doc, idx, kind, None, text, None, None, src, None)


def item(doc, kind, text, top, seq, src=None):
    return (doc, kind, None, text if kind == "code" else None, text if kind == "formula" else None, None, src, None, top, seq, "x")


def merged(spark, blocks, items, anchors):
    out = merge.merge_captured(spark.createDataFrame(blocks, BLOCK), spark.createDataFrame(items, ITEM).drop("junk"), spark.createDataFrame(anchors, "doc_id long, text string, top double"))
    return {d: [r.text or r.latex or r.src for r in sorted(out.collect(), key=lambda r: r.block_idx) if r.doc_id == d] for d in {b[0] for b in blocks} | {i[0] for i in items}}


def test_items_go_between_the_blocks_whose_places_are_known(spark):
    blocks = [block(1, i, t) for i, t in enumerate(["alpha one", "beta two", "gamma three", "delta four", "epsilon five"])]
    anchors = [(1, "Alpha ONE", 0.0), (1, "epsilon five", 400.0), (1, "gamma three", 9000.0), (1, "unknown", 50.0), (1, None, 1.0), (1, "beta two", None)]
    items = [item(1, "code", "x = 1", 150.0, 0), item(1, "formula", "a_1", 150.0, 1), item(1, "image", "", -50.0, 2, "https://pbs.twimg.com/media/A.jpg"), item(1, "code", "y = 2", 500.0, 3), item(1, "code", "z = 3", None, 4), item(1, "code", "x = 1", 350.0, 5)]
    got = merged(spark, blocks, items, anchors)
    assert got[1] == ["https://pbs.twimg.com/media/A.jpg", "alpha one", "beta two", "x = 1", "a_1", "gamma three", "delta four", "epsilon five", "y = 2", "z = 3"]  # gamma's place is wrong and doesn't count


def test_copies_ties_and_documents_without(spark):
    blocks = [block(1, 0, "same text here"), block(1, 1, "x = 1", "code"), block(1, 2, "tail of it"), block(2, 0, "no ties"), block(3, 0, "alone")]
    items = [item(1, "code", "x = 1", 70.0, 0), item(1, "formula", "b", 60.0, 1), item(2, "code", "late", 5.0, 1), item(2, "code", "early", 2.0, 2), item(4, "code", "only captured", 1.0, 0), item(None, "code", "no name", 1.0, 0)]
    got = merged(spark, blocks, items, [(1, "tail of it", 100.0)])
    assert got[1] == ["same text here", "x = 1", "b", "tail of it"] or got[1] == ["same text here", "b", "x = 1", "tail of it"]
    assert got[2] == ["no ties", "early", "late"] and got[3] == ["alone"] and got[4] == ["only captured"]
    assert merged(spark, blocks, [], [])[1] == ["same text here", "x = 1", "tail of it"] and merged(spark, [], [], []) == {}


def test_page_documents_take_what_was_captured(spark):
    html = "<body><article><h1>A page of some title</h1><p>First paragraph of it.</p><p>Second paragraph of it.</p></article></body>"
    pages = spark.createDataFrame([(1, "https://x.com/u/article/1", html)], "page_id long, url string, html string")
    items = spark.createDataFrame([item(1, "code", "x = 1\ny = 2", 150.0, 0)], ITEM).drop("junk")
    anchors = spark.createDataFrame([(1, "First paragraph of it.", 100.0), (1, "Second paragraph of it.", 200.0)], "doc_id long, text string, top double")
    documents, blocks = page.page_articles(pages, html_nodes(pages), items, anchors)
    assert [r.type for r in blocks.orderBy("block_idx").collect()] == ["paragraph", "code", "paragraph"] and documents.first().blocks == 3


def test_image_addresses(spark):
    html = """<picture><source srcset=""><source srcset="a.jpg 1x,b.jpg 2x"><img alt="in"></picture><img src="c.jpg" srcset=" , "><img srcset="data:x 1x" src="d.jpg"><img src="blob:e"><img>
    <img srcset="e.jpg\n2x,\tf.jpg 100w" src="g.jpg"><picture><img src="h.jpg"></picture><source srcset="stray.jpg">"""
    nodes = html_nodes(spark.createDataFrame([(1, html), (2, None), (3, "<p>none</p>")], "page_id long, html string"))
    assert [r.src for r in inventory.image_addresses(nodes).orderBy("page_id", "pre").collect()] == ["b.jpg", "c.jpg", "d.jpg", None, None, "f.jpg", "h.jpg"]
    assert inventory.image_addresses(nodes.where(F.lit(False))).count() == 0
