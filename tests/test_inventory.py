from structdoc.operators import dom
from structdoc.operators import inventory as I
from structdoc.sources.html import html_nodes

M = "https://pbs.twimg.com/media/"


def test_images(spark):
    rows = [(1, 0, f"{M}A.jpg?name=small", 300, 200, ""), (1, 1, f"{M}A.jpg?name=large", 600, 400, ""), (1, 2, f"{M}B.jpg", 100, 90, ""), (1, 3, f"{M}C.jpg", 300, 200, "UserAvatar"), (1, 4, "https://other.example/media/D.jpg", 600, 400, ""), (1, 5, f"{M}E.jpg", 4000, 100, "")]
    usable = I.usable_images(spark.createDataFrame(rows, "page_id long, seq int, src string, width int, height int, hint string"))
    assert [r.seq for r in usable.orderBy("seq").collect()] == [0, 1]
    assert [(r.seq, r.area) for r in I.largest_images(usable, ["page_id"], "seq").collect()] == [(1, 240_000)]


def test_inventory_and_anchors(spark):
    schema = "page_id long, seq int, type string, src string, width int, height int, top double, before_text string, after_text string"
    live = spark.createDataFrame([(1, 0, "image", f"{M}A.jpg?name=large", 600, 400, None, "", "")], schema)
    captured = spark.createDataFrame([(1, 5, "image", f"{M}A.jpg?name=orig", 900, 600, 500.0, "x", ""), (1, 6, "image", f"{M}B.jpg", 600, 400, 9000.0, "", "")], schema)
    bodies = spark.createDataFrame([(1, 100.0, 2000.0)], "page_id long, body_top double, body_bottom double")
    assert [(r.seq, r.score) for r in I.media_inventory(live, captured, bodies).collect()] == [(5, 350.0)]
    items = spark.createDataFrame([(1, 7, 100, 200), (1, 8, 0, 10)], "page_id long, item_id int, top int, bottom int")
    anchors = spark.createDataFrame([(1, 20, 60, "far"), (1, 70, 105, "near"), (1, 195, 230, "next"), (1, 300, 320, "later")], "page_id long, a_top int, a_bottom int, text string")
    got = {r.item_id: (r.before_text, r.after_text) for r in I.nearest_anchors(items, anchors).collect()}
    assert got == {7: ("near", "next"), 8: ("", "far")}


def test_titles_cards_polls_authors(spark):
    html = (
        '<html><head><title>Doc title / X</title><meta property="og:title" content="Meta title"></head><body><main><h1>Follow @me now please</h1>'
        '<div data-testid="User-Name"><span>A B</span><span>@ab</span></div><article><h2>Body heading</h2><p>' + "words " * 200 + "</p></article>"
        '<div data-testid="card.wrapper"><a href="https://www.a.example/x"><span>Short</span><span>A longer text than the title</span></a></div>'
        '<div data-testid="cardPoll"><span role="radio">yes</span><span role="radio">no</span><span role="radio">yes</span></div></main></body></html>'
    )
    nodes = html_nodes(spark.createDataFrame([(1, html)], "page_id long, html string")).persist()
    root = nodes.where("tag = 'article'").select("page_id", "node_id", "pre", "post")
    assert dom.article_root(nodes).count() == 1
    assert [tuple(r) for r in I.detect_title(nodes, root).collect()] == [(1, "Meta title", "meta")]
    assert {r.origin for r in I.title_candidates(nodes, root).collect()} >= {"meta", "document", "body"}
    assert [tuple(r)[2:] for r in I.link_cards(nodes).collect()] == [("https://www.a.example/x", "Short", "A longer text than the title", "a.example")]
    assert [r.options for r in I.polls(nodes).collect()] == [["yes", "no"]]
    pages = spark.createDataFrame([(1, "https://x.com/zz/status/1"), (2, "https://x.com/yy/article/2")], "page_id long, url string")
    assert sorted(tuple(r) for r in I.authors_in(nodes, pages).collect()) == [(1, "ab", "A B"), (2, "yy", "@yy")]


def test_covers_times_and_order(spark):
    images = spark.createDataFrame([(1, "a", 600, 300, 150.0), (1, "b", 300, 300, 160.0), (1, "c", 600, 300, 5000.0)], "page_id long, src string, width int, height int, top double")
    bodies = spark.createDataFrame([(1, 400.0, None, 100.0)], "page_id long, body_top double, first_media_top double, title_bottom double")
    assert [tuple(r) for r in I.detect_cover(images, bodies).collect()] == [(1, "a", 2500 - 50 + 500 + 280 + 220)]
    times = spark.createDataFrame([(1, 380.0, "n"), (1, 10.0, "f"), (1, 900.0, "below")], "page_id long, top double, datetime string")
    assert I.nearest_time(times, bodies.select("page_id", "body_top")).first().published == "n"
    df = spark.createDataFrame([("d", 100.4, 2), ("d", 99.9, 3), ("d", 5.0, 9), ("d", None, 1)], "doc_id string, top double, seq int")
    assert [r.seq for r in I.ordered(df).orderBy("block_idx").collect()] == [9, 2, 3, 1]
