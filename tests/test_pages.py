"""Documents of pages, long texts, sinks and the operators that have no query."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from structdoc.functions import code, formula, text
from structdoc.operators import blocks as B
from structdoc.operators import page
from structdoc.plans import literals as L
from structdoc.plans.article import parse_articles
from structdoc.sources.html import html_nodes, read_html
from structdoc.sources.payloads import json_objects, json_strings
from structdoc.sources.sinks import post_documents

MEGA = 1 << 20
WORST = {
    "style": "a {" + "color: red; " * (MEGA // 12) + "}",
    "open style": "a {" + "color: red; " * (MEGA // 12),
    "spaces": "x" + " " * MEGA + "x",
    "lines": "x" + "\n" * MEGA + "x",
    "breaks": "x" + "<br> " * (MEGA // 5) + "x",
    "words": "def word " * (MEGA // 9),
}


@pytest.mark.parametrize("name", sorted(WORST))
def test_long_texts_take_neither_stack_nor_squares_of_time(spark, name):
    began = time.time()
    scores = [s.alias(n) for n, s in code.language_scores(F.col("t"))]
    row = spark.createDataFrame([(WORST[name],)], "t string").select(*scores, F.length(text.tidy_breaks(F.col("t"))).alias("tidy"), F.length(text.normalize_text(F.col("t"))).alias("normal")).first()
    assert row.css == (7 if name == "style" else 0) and row.tidy <= MEGA + 2 and time.time() - began < 60


def test_breaks_are_tidied(spark):
    rows = [" <br> a<br>\n<br> <br>b <br>", "a<br><br>b", "  ", None, "<br>x y<br>z"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "t string").select(text.tidy_breaks(F.col("t"))).collect()]
    assert got == ["a<br><br>b", "a<br><br>b", "", "", "x y<br>z"]


def test_css_rules_are_seen(spark):
    rows = ["p{margin:0}", "h1 { color : red; margin: 0 auto }", "a {b}", "{a:b}", "x { a: b; c }", "no rules: here"]
    score = dict(code.language_scores(F.col("t")))["css"]
    assert [r[0] for r in spark.createDataFrame([(r,) for r in rows], "t string").select(score).collect()] == [7, 7, 0, 0, 0, 0]


def test_formulas_that_stand_twice(spark):
    rows = ["a = b a = b", "a = b\n\na = b", "x^2 + y x^2 + z", "ab ab", "abcd abcd", "\\left( x \\right) (x)", "a\nb\na\nb", "x − 1 x - 1", "", None]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "t string").select(formula.drop_repeat(F.col("t"))).collect()]
    assert got == ["a = b", "a = b", "x^2 + y x^2 + z", "ab ab", "abcd", "\\left( x \\right) (x)", "a\nb", "x − 1", "", None]


def test_the_first_formula_of_several(spark):
    rows = [([None, "", "plain", "\\frac{a}{b}"],), ([],), (None,), (["abcdefgh12", "<math><mi>x</mi></math>"],)]
    got = spark.createDataFrame(rows, "s array<string>").select(formula.first_formula(F.col("s")).alias("f")).select("f.*").collect()
    assert [tuple(r) for r in got] == [("plain", None), (None, None), (None, None), (None, "<math><mi>x</mi></math>")]


def test_sources_under_other_keys(spark):
    from structdoc.sources.payloads import formula_sources

    data = [{"formula": {"latex": "x_1"}}, {"latex": "y_1", "formula": {"latex": "x_1"}}, {"data": {"value": {"deep": 1}, "text": "z_1"}}]
    got = spark.createDataFrame([(formula_sources(d),) for d in data], "sources array<string>").select(formula.first_formula(F.col("sources")).alias("f")).select("f.latex").collect()
    assert [r[0] for r in got] == ["x_1", "y_1", "z_1"]


def test_lists_and_quotes_of_articles_stay(spark):
    blocks = parse_articles(*L.tables(spark))[1].where("doc_id = 1")
    kept = B.drop_copies(blocks)
    assert kept.count() == blocks.count() and kept.where("type = 'list'").count() == 2
    twice = blocks.unionByName(blocks.withColumn("block_idx", F.col("block_idx") + 100))
    assert B.drop_copies(twice).where("type = 'list'").count() == 2


def test_runs_of_bullets_become_lists(spark):
    rows = [(1, i, "paragraph", h, None) for i, h in enumerate(["• a", "• <b>b</b>", "x", "1. c", "- d", "- e"])]
    grouped = B.group_pseudo_lists(spark.createDataFrame(rows, "doc_id long, block_idx int, type string, html string, items array<struct<item:int,depth:int,ordered:boolean,html:string>>").withColumn("text", F.lit(None).cast("string")))
    got = [(r.block_idx, r.type, [i.html for i in r["items"] or []]) for r in grouped.orderBy("block_idx").collect()]
    assert got == [(0, "list", ["a", "b"]), (2, "paragraph", []), (3, "paragraph", []), (4, "list", ["d", "e"])]


def test_links_keep_their_targets():
    html = '<p>a <a href="https://t.example/?a=1&amp;b=2">l</a> <a href="javascript:x">m</a> <a href="/n">n</a> <a>o</a></p>'
    assert read_html(1, html)[0][10] == 'a <a href="https://t.example/?a=1&amp;b=2">l</a> <a>m</a> <a href="/n">n</a> <a>o</a>'


def test_nested_text_is_written_once():
    deep = "<span>" * 300 + "x" * 1000 + "</span>" * 300
    rows = read_html(1, deep)
    assert len(rows) == 300 and all(r[8] == "x" * 1000 for r in rows) and all(r[9] == 1000 for r in rows)
    assert read_html(1, "<li>a<ul><li>b<ol><li>c</ol>d</li></ul>e</li>")[0][8] == "ae" and [r[8] for r in read_html(1, "<li>a<ul><li>b<ol><li>c</ol>d</li></ul>e</li>") if r[6] == "li"] == ["ae", "bd", "c"]


def test_page_roots_and_posts(spark):
    html = '<body><article id="a"><a href="/u/status/5">x</a></article><article id="b"><time>t<a href="/u/status/5">y</a></time></article><article id="c"></article></body>'
    nodes = html_nodes(spark.createDataFrame([(1, html), (2, html), (3, "<p>none</p>")], "page_id long, html string"))
    posts = spark.createDataFrame([(1, "5"), (2, "6")], "page_id long, post_id string")
    got = {r.page_id: r.node_id for r in page.post_root(nodes, posts).collect()}
    ids = {r.id: r.node_id for r in nodes.where("tag = 'article' AND page_id = 1").select(F.try_element_at("attrs", F.lit("id")).alias("id"), "node_id").collect()}
    assert got[2] == ids["a"] and got[1] in (ids["a"], ids["b"]) and 3 not in got


def test_supplements_lie_near_the_body(spark):
    html = "<body><article><p>x</p></article><pre>near</pre><pre>far</pre></body>"
    nodes = html_nodes(spark.createDataFrame([(1, html)], "page_id long, html string")).withColumn("top", F.when(F.col("text") == "near", 1000).when(F.col("text") == "far", 5000).otherwise(500))
    root = nodes.where("tag = 'article'").withColumn("bottom", F.lit(900))
    assert [r.text for r in page.supplemental_blocks(nodes, root).collect()] == ["near"]


def test_captures_that_failed_take_the_page(spark):
    articles = spark.createDataFrame([(1, True, "a", "u", 0), (2, False, None, "u", 0), (3, True, "c", "u", 2), (4, False, None, "u", 0)], "doc_id long, ok boolean, title string, url string, unresolved int")
    blocks = spark.createDataFrame([(1, 0, "paragraph"), (3, 0, "formula")], "doc_id long, block_idx int, type string")
    documents = spark.createDataFrame([(2, "p2", "v", 1), (3, "p3", "v", 1), (4, "p4", "v", 0)], "doc_id long, title string, url string, blocks long")
    of_pages = spark.createDataFrame([(2, 0, "heading"), (3, 0, "paragraph")], "doc_id long, block_idx int, type string")
    docs, rows = page.with_page_fallback(articles, blocks, documents, of_pages)
    assert sorted((r.doc_id, r.ok, r.title, r.acquisition_method) for r in docs.collect()) == [(1, True, "a", "structured"), (2, True, "p2", "page"), (3, True, "p3", "page"), (4, False, None, "structured")]
    assert sorted(map(tuple, rows.collect())) == [(1, 0, "paragraph"), (2, 0, "heading"), (3, 0, "paragraph")]


def test_formula_counts(spark):
    blocks = spark.createDataFrame([(1, "formula", "x", None), (1, "formula", None, "<math><mi>x</mi></math>"), (1, "formula", None, "<math></math>"), (2, "paragraph", None, None)], "doc_id long, type string, latex string, mathml string")
    open_ = spark.createDataFrame([(1, "k"), (3, "k")], "doc_id long, entity_reference string")
    assert sorted(map(tuple, B.formula_counts(blocks, open_).collect())) == [(1, 1, 2, 2, 1), (3, 0, 0, 0, 1)]


def test_strings_that_look_like_json(spark):
    body = json.dumps({"a": '{"x": 1}', "b": "plain", "c": {"d": "[1]", "core": {"e": 1}}})
    got = json_strings(json_objects(spark.createDataFrame([(1, 0, body)], "capture_id long, payload_idx int, body string"))).collect()
    assert sorted((r.path, r.length) for r in got) == [("a", 8), ("c.d", 3)]


def test_documents_are_posted(spark):
    seen = []

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(204)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    df = spark.createDataFrame([(i, [i]) for i in range(5)], "doc_id long, parts array<int>")
    assert post_documents(df, f"http://127.0.0.1:{server.server_port}/") == 5
    server.shutdown()
    assert sorted(x["doc_id"] for x in seen) == list(range(5)) and all(x["parts"] == [x["doc_id"]] for x in seen)
    assert post_documents(df.where("false"), "http://127.0.0.1:1/") == 0


def elements(spark, *pages):
    from structdoc.sources.html import html_nodes

    return html_nodes(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string"))


def test_the_post_is_where_a_link_holds_a_time(spark):
    html = '<main><article><a href="/u/status/5">reply</a><time>1</time></article><article><a href="/u/status/5"><time>2</time></a><p>x</p><time>3</time></article></main>'
    nodes = elements(spark, html, html.replace("status/5", "status/6"), "<article><p>no link</p></article>", "<p>none</p>")
    posts = spark.createDataFrame([(i, "5") for i in range(4)], "page_id long, post_id string")
    found = page.post_root(nodes, posts).join(nodes.where("tag = 'article'").select("page_id", "node_id", F.row_number().over(Window.partitionBy("page_id").orderBy("pre")).alias("n")), ["page_id", "node_id"])
    assert {r.page_id: r.n for r in found.collect()} == {0: 2, 1: 1, 2: 1}


def test_hints_of_linked_articles(spark):
    link = '<a href="https://x.com/u/article/7?s=1">{}</a>'
    card = '<div data-testid="card.wrapper"><span>{}</span>' + link.format("<span>x.com/u and more</span>") + "</div>"
    pages = [
        link.format("<span>More info</span><h3>ab</h3><span>https://t.example/abcdef</span>"), link.format("<h3>A long enough heading</h3><span>some other words that are long</span>"),
        link.format("<span>Read more</span>"), card.format("The card's own title"), link.format("<span>eight ch</span><span>nine char</span>"), "<a href='/other'>A plausible title here</a>",
    ]
    got = {r.page_id: (r.url, r.title_hint) for r in page.linked_article(elements(spark, *pages)).collect()}
    assert {k: v[1] for k, v in got.items()} == {0: "More infoabhttps://t.example/abcdef", 1: "A long enough heading", 2: None, 3: "The card's own title", 4: "eight chnine char"}  # 0 and 4: the whole link's text
    assert {v[0] for v in got.values()} == {"https://x.com/u/article/7"}


def test_formula_sources_at_any_depth():
    from structdoc.sources.payloads import formula_sources

    assert formula_sources({"text": "t", "content": {"value": {"latex": "deep", "mathml": "<math/>"}}, "tex": "own", "formula": {"tex": "last"}, "data": " "}) == ["own", "t", "<math/>", "deep", "last"]
    assert formula_sources({}) == [] and formula_sources({"content": [1], "value": 3, "latex": None}) == []
    deep = {"latex": "x"}
    for _ in range(50_000):
        deep = {"data": deep}
    assert formula_sources(deep) == ["x"]
