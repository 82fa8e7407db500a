"""Queries over captures and pages that are built from whole tables, so that every row's result is known.

``captures`` wraps each document as an article in a payload: a block for each line, and entities with an image, a formula, a post and
a link. ``rich_pages`` makes an HTML page of each document with every kind of block that pages have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from structdoc.functions import code, formula, text, urls
from structdoc.operators import blocks as B
from structdoc.operators import dom, inventory, markdown, metadata, page, render
from structdoc.plans.article import parse_articles
from structdoc.plans.tables import fine, parts, table
from structdoc.sources.html import html_nodes
from structdoc.sources.payloads import candidate_responses, json_objects, json_strings

RANGES = "array<struct<offset:int,length:int,key:string>>"
PLACE = ("capture_id", "payload_idx", "seq", "depth", "in_string")
STYLES = "array<struct<offset:int,length:int,style:string>>"


def _quoted(c: Column) -> Column:
    """A text as a JSON string."""
    listed = F.to_json(F.array(c))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _filled(pattern: str, **values: Column) -> Column:
    """A pattern with each <name> replaced by a column."""
    out = F.lit(pattern)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"<{name}>"), value.cast("string"))
    return out


STATE = '{"blocks":<blocks>,"entityMap":{"0":{"type":"MEDIA","data":{"media_items":[{"media_id":"m<id>"}]}},"1":{"type":"LATEX","data":{"content":{"value":{"data":{"latex":"$$x_<ten> = <lang>$$"}}}}},"2":{"type":"TWEET","data":{"post_id":"p<id>"}},"3":{"type":"LINK","data":{"url":"https://www.site.example/a?d=<id>","title":"Site"}}}}'
USER = '{"user_results":{"result":{"legacy":{"name":"<name>","screen_name":"<handle>"}}}}'
POST = '"post":{"rest_id":"p<id>","full_text":"Quoted <post> & <id>","created_at":"Thu Oct 11 08:00:00 +0000 2018","core":<poster>},'
ARTICLE = (
    '{"rest_id":"<id>"<title>,"cover_media":{"media_id":"m<id>"},"content_state":<state>,"media_entities":[{"id_str":"m<id>","type":"photo","media_url_https":"https://pbs.twimg.com/media/D<id>.jpg",'
    '"original_info":{"width":800,"height":600}}],"formula_store":{"stored-<id>":{"entityKey":"stored-<id>","type":"LATEX","latex":"a_1 ∼ b<three>"}}}'
)
BODY = '{"data":{<post>"tweetResult":{"result":{"rest_id":"<id>","created_at":"Wed Oct 10 20:19:24 +0000 2018","lang":"<lang>","core":<user>,"article":{"article_results":{"result":<article>}}}}}}'


def captures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(payloads, captures): every document as an article; every eleventh has no title, every second its state as a string and its post in the payload."""
    docs = fine(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("xx")).alias("lang"), F.coalesce("source", F.lit("s")).alias("source"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))
    i = F.col("doc_id")
    none = F.array().cast(RANGES)
    plain = F.array().cast(STYLES)

    def block(key: Column, kind: Column, line: Column, depth: Column, ranges: Column = none, styles: Column = plain) -> Column:
        return F.struct(key.alias("key"), kind.alias("type"), line.alias("text"), depth.cast("int").alias("depth"), ranges.alias("entity_ranges"), styles.alias("inline_style_ranges"))

    styles = F.from_json(F.lit('[{"offset":0,"length":3,"style":"Bold"},{"offset":2,"length":3,"style":"ITALIC"},{"offset":4,"length":-1,"style":"CODE"}]'), STYLES)
    link = F.from_json(F.lit('[{"offset":3,"length":4,"key":"3"}]'), RANGES)
    kind = lambda n: F.when(n == 0, "header-one").when(n % 7 == 3, "blockquote").when((n % 7).isin(4, 5), "ordered-list-item").otherwise("unstyled")
    of_lines = F.transform("lines", lambda x, n: block(F.concat(F.lit("b"), n.cast("string")), kind(n), x, F.when(n % 7 == 5, 1).otherwise(0), F.when(n % 7 == 6, link).otherwise(none), F.when(n % 7 == 2, styles).when(n % 7 == 6, styles).otherwise(plain)))
    atomic = [block(F.lit(f"e{k}"), F.lit("atomic"), F.lit(" "), F.lit(0), F.array(F.struct(F.lit(0).alias("offset"), F.lit(1).alias("length"), F.lit(str(k)).alias("key"))).cast(RANGES)) for k in range(4)]
    tail = F.when(i % 5 == 0, F.array(block(F.lit("t"), F.lit("unstyled"), F.lit("The following code:"), F.lit(0)))).otherwise(F.slice(F.array(atomic[0]), 1, 0))
    blocks = F.to_json(F.concat(of_lines, F.array(*atomic), tail))
    state = F.replace(_filled(STATE.replace("<blocks>", "\x01"), id=i, ten=i % 10, lang=F.col("lang")), F.lit("\x01"), blocks)
    handle = F.concat(F.lit("u"), (i % 97).cast("string"))
    user = _filled(USER, name=F.concat(F.lit("Name "), F.col("source")), handle=handle)
    poster = _filled(USER, name=F.lit("C D"), handle=F.concat(F.lit("c"), (i % 5).cast("string")))
    title = F.when(i % 11 == 0, "").otherwise(F.concat(F.lit(',"title":'), _quoted(_filled("  Title of <id>   in <lang>", id=i, lang=F.col("lang")))))
    article = F.replace(_filled(ARTICLE.replace("<state>", "\x01"), id=i, three=i % 3, title=title), F.lit("\x01"), F.when(i % 2 == 0, _quoted(state)).otherwise(state))
    post = F.when(i % 2 == 0, _filled(POST, id=i, poster=poster)).otherwise("")
    body = F.replace(F.replace(_filled(BODY.replace("<post>", "\x02").replace("<article>", "\x01"), id=i, lang=F.col("lang"), user=user), F.lit("\x02"), post), F.lit("\x01"), article)
    payloads = docs.select(i.alias("capture_id"), F.lit(0).alias("payload_idx"), body.alias("body"))
    return payloads, docs.select(i.alias("capture_id"), _filled("https://x.com/<handle>/article/<id>?s=1", handle=handle, id=i).alias("article_url"), i.cast("string").alias("expected_id"))


def payload_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_objects(captures(spark, sf_dir)[0], ("capture_id", "path", "depth", "in_string"))


def payload_json_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of payloads that hold JSON as text: the states of every second capture."""
    return json_strings(json_objects(captures(spark, sf_dir)[0], ("capture_id", "payload_idx", "seq", "path", "fields"))).select("capture_id", "path")


def article_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    payloads, known = captures(spark, sf_dir)
    return metadata.article_candidates(json_objects(payloads, ("capture_id", "path", "fields", "ids", "content_state"), having="content_state"), known.select("capture_id", "expected_id")).select("capture_id", "path", "title", "score")


def media_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.media_index(json_objects(captures(spark, sf_dir)[0], (*PLACE, "fields", "ids", "media_urls"), having="media_urls")).select("capture_id", "ref_key", "url", "width", "height", "type")


def formula_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.formula_index(json_objects(captures(spark, sf_dir)[0], (*PLACE, "path", "fields"))).select("capture_id", "ref_key", "latex", "ordinal")


def post_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.post_index(json_objects(captures(spark, sf_dir)[0], (*PLACE, "fields"))).select("capture_id", "post_id", "text", "author_name", "author_handle", "created_at")


def _parsed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return parse_articles(*captures(spark, sf_dir), parts=parts(spark, sf_dir, "documents"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _parsed(spark, sf_dir)[0]
    return found.select("doc_id", "ok", "title", "author_name", "author_handle", "published", F.unix_micros("published_at").alias("published_at"), "lang", "cover_image", "url", "score")


def article_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _parsed(spark, sf_dir)[1]
    content = F.coalesce("html", "text", "latex", F.array_join("paragraphs", " "), F.array_join(F.transform("items", lambda x: x["html"]), "|"))
    return blocks.select("doc_id", F.col("block_idx").cast("long").alias("block_idx"), "type", "level", F.md5(content.cast("binary")).alias("content_md5"), "src", "url", "resolution_source")


def draft_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = render.list_adjacency(_parsed(spark, sf_dir)[1])
    return found.select("doc_id", F.col("block_idx").cast("long").alias("block_idx"), "item_id", "parent_item_id", "depth", "ordered", F.md5(F.col("html").cast("binary")).alias("html_md5"))


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _parsed(spark, sf_dir)[1]
    return B.completeness(blocks, spark.createDataFrame([], "doc_id long, entity_reference string"))


def render_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = render.render_documents(*_parsed(spark, sf_dir))
    return found.select("doc_id", "filename", F.md5(F.col("html").cast("binary")).alias("html_md5"))


PAGE = (
    '<!DOCTYPE html><html><head><title>Page of <name></title><meta property="og:image" content="https://pbs.twimg.com/media/C<id>.jpg"></head><body><nav><a href="/x">menu</a></nav>'
    '<article><h1>Page of <name></h1><time datetime="2024-01-0<nine>">d</time><div data-testid="User-Name"><span>Name N<seven></span><span>@user<seven></span></div>'
    '<p>First <c> <a href="https://t.example/<id>?a=1&amp;b=2">link</a></p><h2>Part <id></h2><ul><li>one<ul><li>in <id></li></ul></li><li>two</li></ul>'
    '<pre class="language-py">x = <id></pre><pre>y = 2</pre><blockquote><p>q1</p><p>q2 <id></p></blockquote>'
    '<table><tr><th>a</th><th colspan="2">b</th></tr><tr><td>1</td><td>t<id></td></tr><tr></tr></table>'
    '<figure><img src="https://pbs.twimg.com/media/F<id>.jpg" alt="pic"><figcaption>cap</figcaption></figure><figure><img src="https://pbs.twimg.com/media/C<id>.jpg"></figure>'
    '<hr><hr><p>First <c> <a href="https://t.example/<id>?a=1&amp;b=2">link</a></p><p>1. alpha <id></p><p>2. beta</p>'
    '<video poster="https://pbs.twimg.com/media/V<id>.jpg"></video>'
    '<article data-embedded="true"><span>@emb<five></span><time datetime="2023-05-05">t</time><p>embedded <id></p><a href="https://x.com/e/status/<id>">l</a><img src="i1"><img src="i2"><img src="i3"><img src="i4"><img src="i5"></article>'
    '<div data-testid="card.wrapper"><a href="https://www.card.example/<id>"><span>Card title <id></span><span>A longer description of card <id></span></a></div>'
    '<div data-testid="cardPoll"><div role="radio"><span role="radio">yes</span></div><div role="radio"><span role="radio">no <id></span></div></div>'
    '<a href="https://x.com/u/article/<id>?s=2"><h3>Linked <name></h3></a></article></body></html>'
)


def rich_pages(spark: SparkSession, sf_dir: str, read=None) -> DataFrame:
    """A page for each document: page_id, url, html. read: how the documents are read, in fine parts unless told."""
    letters = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z ]", ""), " +", " "))
    i, c = F.col("doc_id"), F.coalesce(F.nullif(letters, F.lit("")), F.lit("empty"))
    name = F.concat(F.lit("text "), i.cast("string"), F.lit(" in "), F.coalesce("lang", F.lit("xx")))
    html = _filled(PAGE, id=i, name=name, c=c, nine=1 + i % 9, seven=i % 7, five=i % 5)
    return (read or fine)(spark, sf_dir, "documents").select(i.alias("page_id"), _filled("https://x.com/user<seven>/article/<id>?x=1", seven=i % 7, id=i).alias("url"), html.alias("html"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_nodes(rich_pages(spark, sf_dir)).persist()  # read several times


def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = rich_pages(spark, sf_dir, table)
    return page.page_articles(pages, html_nodes(pages))[0].withColumn("blocks", F.col("blocks").cast("long"))


def page_document_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = rich_pages(spark, sf_dir, table)
    blocks = page.page_articles(pages, html_nodes(pages))[1]
    content = F.coalesce("html", "text", F.array_join("paragraphs", "|"), F.array_join(F.transform("items", lambda x: F.concat(x["depth"].cast("string"), x["html"])), "|"), F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), "|"))
    return blocks.select("doc_id", F.col("block_idx").cast("long").alias("block_idx"), "type", "level", content.alias("content"), "src", "caption")


def page_linked_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page.linked_article(_nodes(spark, sf_dir))


def page_post_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    posts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.col("doc_id").cast("string").alias("post_id"))
    return page.post_root(nodes, posts).select("page_id", F.lit(True).alias("found"))


def page_embedded_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = page.embedded_posts(html_nodes(rich_pages(spark, sf_dir), ("text",)))  # read once
    return found.select("page_id", "author_handle", "published", "text", "url", F.array_join("images", ",").alias("images"))


def page_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page.media_elements(_nodes(spark, sf_dir)).select("page_id", "poster", "kind", "url")


def page_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.link_cards(_nodes(spark, sf_dir)).select("page_id", "url", "title", "description", "hostname")


def page_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.polls(_nodes(spark, sf_dir)).select("page_id", F.array_join("options", "|").alias("options"))


def page_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = rich_pages(spark, sf_dir)
    return inventory.authors_in(html_nodes(pages).persist(), pages)


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    return inventory.detect_title(nodes, page.page_root(nodes))


def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom.table_cells(_nodes(spark, sf_dir)).select("page_id", "row", "column", "header", "html", "colspan")


def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many elements of each kind stand in each page's root after suppression."""
    nodes = html_nodes(rich_pages(spark, sf_dir), ()).persist()  # no texts
    return dom.classified(nodes, page.page_root(nodes)).groupBy("page_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def blocks_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of documents as blocks: doc_id, block_idx, line."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("block_idx", "line"))
    return lines


def block_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as paragraphs, lists and separators, without copies."""
    n = F.col("block_idx") % 4
    null = F.lit(None).cast("string")
    kind = F.when(n == 1, "list").when(n == 3, "separator").otherwise("paragraph")
    shaped = blocks_of_lines(spark, sf_dir).select(
        "doc_id", "block_idx", kind.alias("type"), F.when(kind == "paragraph", text.escape_html(F.col("line"))).alias("html"), null.alias("text"), null.alias("latex"), null.alias("mathml"), null.alias("src"), null.alias("source_url"),
        F.when(kind == "list", F.array(F.struct(text.escape_html(F.col("line")).alias("html")))).alias("items"),
    )
    return B.drop_copies(shaped).select("doc_id", F.col("block_idx").cast("long").alias("block_idx"), "type")


def block_code_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as code of two languages and paragraphs, neighbouring code of one language merged."""
    n = F.col("block_idx")
    is_code = n % 5 != 4
    shaped = blocks_of_lines(spark, sf_dir).select(
        "doc_id", "block_idx", F.when(is_code, "code").otherwise("paragraph").alias("type"), F.when(is_code, F.col("line")).alias("text"),
        F.when(is_code, F.when(n % 5 < 3, "py").otherwise("js")).alias("language"), F.lit(1).alias("line_count"),
    )
    merged = B.merge_code(shaped)
    return merged.select("doc_id", F.col("block_idx").cast("long").alias("block_idx"), "type", "language", F.md5(F.col("text").cast("binary")).alias("text_md5"), "line_count")


def block_pseudo_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of which some are numbered and some bulleted, grouped as lists."""
    n = F.col("block_idx") % 6
    start = F.when(n < 2, "1. x").when(n < 4, "• y").otherwise("z")
    shaped = blocks_of_lines(spark, sf_dir).select("doc_id", "block_idx", F.lit("paragraph").alias("type"), F.concat(start, F.col("block_idx").cast("string")).alias("html"), F.lit(None).cast("string").alias("text"))
    return B.pseudo_lists(shaped).select("doc_id", F.col("block_idx").cast("long").alias("block_idx"), "ordered", F.array_join("items", "|").alias("items"))


def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters of each line as Markdown of a kind that goes by its place, as blocks."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.col("line"), "[^A-Za-z ]", ""), " +", " "))
    words = F.coalesce(F.nullif(clean, F.lit("")), F.lit("x"))
    n = F.col("block_idx") % 6
    shaped = [F.concat(F.lit("## "), words), F.concat(F.lit("> "), words), F.concat(F.lit("- "), words), F.concat(F.lit("**"), words, F.lit("** `c`")), F.concat(F.lit("```sql\n"), words, F.lit("\n```")), F.concat(F.lit("a | b\n-- | ---\n1 | "), words)]
    line = F.coalesce(*(F.when(n == k, s) for k, s in enumerate(shaped)))
    line = F.when(n == 5, F.replace(line, F.lit("-- |"), F.lit("--- |"))).otherwise(line)
    source = blocks_of_lines(spark, sf_dir).select("doc_id", F.struct("block_idx", line.alias("line")).alias("x")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n\n").alias("source"))
    found = markdown.markdown_blocks(source, "doc_id", "source")
    content = F.coalesce("html", "text", F.array_join("paragraphs", "|"), F.array_join(F.transform("items", lambda x: x["html"]), "|"), F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), "|"))
    return found.select("doc_id", F.col("block_idx").cast("long").alias("block_idx"), "type", "level", content.alias("content"), "language")


def formula_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas of six shapes that go by the part's number, in their normal form."""
    k = F.col("p_partkey")
    shapes = ["$$a_<k> = b$$", "\\boldsymbolS = <k>\n\\boldsymbolS = <k>", "\U0001d400 − π<k>", "<math><mi>x</mi><mn><k></mn></math> tail", "abcdefgh<k>", "x^<k> + y x^<k> + y"]
    source = F.coalesce(*(F.when(k % 6 == n, _filled(s, k=k)) for n, s in enumerate(shapes)))
    found = table(spark, sf_dir, "part").select("p_partkey", formula.formula_source(source, F.lit(False)).alias("f"))
    return found.select("p_partkey", "f.latex", "f.mathml")


LABELS = [
    ("python3", "x"), ("language-js (node)", ""), ("C++", ""), ("shell", ""), ("", "def f(x):\n    return x"), ("", "const f = (x) => x;"), ("", '{"a": [1]}'), ("", "SELECT a FROM t WHERE b"),
    ("", "just words"), ("lang-rs,ignore", "y"), ("YML", ""), ("unknown9", "#include <stdio.h>"),
]


def code_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and texts of code that go by the part's number: the named, the detected and the shown language."""
    n = F.col("p_partkey") % len(LABELS)
    label, body = (F.coalesce(*(F.when(n == k, pair[side]) for k, pair in enumerate(LABELS))) for side in (0, 1))
    language = code.resolve_language(label, body)
    return table(spark, sf_dir, "part").select("p_partkey", code.normalize_language(label).alias("named"), code.detect_language(body).alias("detected"), language.alias("language"), code.display_name(language, label).alias("display"))


def clean_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of six shapes around the letters of a customer's name."""
    name, n = F.col("c_name"), F.col("c_custkey") % 6
    shapes = ["A B on X: <n> / X", "<n> here @ab more", "<n> by A B", "<n> Someone · Jan 5, 2024", "<n> 12K 3K", "<n> Follow me"]
    title = F.coalesce(*(F.when(n == k, F.replace(F.lit(s), F.lit("<n>"), name)) for k, s in enumerate(shapes)))
    cleaned = text.clean_title(title, F.when(n == 1, "ab").otherwise(""), F.when(n == 2, "A B").otherwise(""))
    return table(spark, sf_dir, "customer").select("c_custkey", cleaned.alias("title"))


def text_typography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponents, entities and MathML around a customer's key."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        text.math_typography(_filled("x^<k> <code>a^2</code> (b)^{n+<k>} <b>c^d</b> ^e", k=k).cast("string")).alias("math"),
        text.text_content(_filled("<p>a&eacute;&#8364;&amp;lt;</p><k>", k=k)).alias("content"),
        text.mathml_text(_filled("<math><mi>x</mi>\n <mn><k></mn><annotation>y</annotation></math>", k=k)).alias("mathml"),
        text.tidy_breaks(_filled(" <br><k><br> <br><br>z<br> ", k=k)).alias("breaks"),
    )


def sanitize_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escaped lines in markup that is allowed, that isn't, and that is dropped with its content."""
    line = text.escape_html(F.coalesce("text", F.lit("")))
    html = F.concat(F.lit('<p onclick="x">'), line, F.lit(' <b class="c">b</b><script>x</script><a href="javascript:1">c</a><a href="https://d.example">d'))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(render.sanitize(html).cast("binary")).alias("clean_md5"))


def media_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of images in several sizes: allowed or not, in the largest size, their key and score."""
    k = F.col("l_partkey")
    host = F.when(F.col("l_linenumber") == 7, "evil.example").otherwise("pbs.twimg.com")
    size = F.when(F.col("l_linenumber") % 2 == 0, "small").otherwise("large")
    url = F.col("url")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", _filled("https://<host>/media/P<k>.png?name=<size>", host=host, k=k, size=size).alias("url"))
    return rows.select("l_orderkey", "l_linenumber", urls.is_media_url(url).alias("allowed"), urls.media_url(url).alias("orig"), urls.media_key(url).alias("media_key"), urls.media_url_score(url).cast("long").alias("score"))


def images_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an order's images those of usable size, of equal addresses in several sizes the largest."""
    lines = table(spark, sf_dir, "lineitem")
    src = _filled("https://pbs.twimg.com/media/P<k>.jpg?name=s<n>", k=F.col("l_suppkey") % 3, n=F.col("l_linenumber"))
    images = lines.select("l_orderkey", F.col("l_linenumber").alias("seq"), src.alias("src"), (F.col("l_quantity") * 20).cast("int").alias("width"), (F.col("l_partkey") % 500 + 1).cast("int").alias("height"), F.when(F.col("l_linenumber") == 5, "avatar").otherwise("").alias("hint"))
    found = inventory.largest_images(inventory.usable_images(images), ["l_orderkey"], "seq")
    return found.select("l_orderkey", F.col("seq").cast("long").alias("seq"), "media_key", F.col("area").cast("long").alias("area"))


def _geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as boxes on the page of their order: page_id, item_id, top, bottom, distinct in both."""
    top = (F.col("l_partkey") * 7 + F.col("l_suppkey") * 3) % 2000 * 8 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").cast("long").alias("item_id"), top.cast("long").alias("top"), (top + 40).cast("long").alias("bottom"), "l_suppkey")


def anchors_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the even lines of an order the texts of odd ones nearest above and below."""
    boxes = _geometry(spark, sf_dir)
    anchors = boxes.where("item_id % 2 = 1").select("page_id", F.col("top").alias("a_top"), F.col("bottom").alias("a_bottom"), F.col("item_id").cast("string").alias("text"))
    return inventory.nearest_anchors(boxes.where("item_id % 2 = 0").select("page_id", "item_id", "top", "bottom"), anchors)


def media_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live images (even lines) and captured ones (odd) near the body, the best of each address."""
    boxes = _geometry(spark, sf_dir)
    src = _filled("https://pbs.twimg.com/media/P<k>.jpg?format=jpg&name=s<n>", k=F.col("l_suppkey") % 2, n=F.col("item_id"))
    images = boxes.select("page_id", F.col("item_id").alias("seq"), F.lit("image").alias("type"), src.alias("src"), (F.col("item_id") * 300).cast("int").alias("width"), F.lit(100).alias("height"), "top", F.lit("").alias("before_text"), F.when(F.col("item_id") % 3 == 0, "t").otherwise("").alias("after_text"))
    bodies = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), F.lit(4000).cast("long").alias("body_top"), F.lit(9000).cast("long").alias("body_bottom"))
    found = inventory.media_inventory(images.where("seq % 2 = 0"), images.where("seq % 2 = 1"), bodies)
    return found.select("page_id", "seq", "media_key", F.round("score", 3).alias("score"))


def cover_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _geometry(spark, sf_dir)
    images = boxes.select("page_id", F.concat(F.lit("i"), F.col("item_id").cast("string")).alias("src"), (F.col("item_id") * 200).alias("width"), F.lit(300).alias("height"), "top")
    bodies = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), F.lit(5000).alias("body_top"), F.lit(12000.0).alias("first_media_top"), F.lit(1000).alias("title_bottom"))
    return inventory.detect_cover(images, bodies).select("page_id", "src", F.col("score").cast("long").alias("score"))


def time_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _geometry(spark, sf_dir)
    bodies = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), F.lit(6000).alias("body_top"))
    return inventory.nearest_time(boxes.select("page_id", "top", F.concat(F.lit("t"), F.col("item_id").cast("string")).alias("datetime")), bodies)


def blocks_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = inventory.ordered(_geometry(spark, sf_dir), key="page_id", seq="item_id")
    return placed.select("page_id", "item_id", F.col("block_idx").cast("long").alias("block_idx"))


def captured_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured code (even lines) and formulas (odd) near the body."""
    boxes = _geometry(spark, sf_dir)
    code_rows = boxes.where("item_id % 2 = 0").select("page_id", F.col("item_id").alias("seq"), F.repeat(F.lit("x"), F.col("item_id").cast("int")).alias("text"), "top")
    formulas = boxes.where("item_id % 2 = 1").select("page_id", F.col("item_id").alias("seq"), F.when(F.col("item_id") != 3, F.lit("a")).alias("latex"), F.lit("").alias("mathml"), "top")
    bodies = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), F.lit(4000).alias("body_top"), F.lit(9000).alias("body_bottom"))
    return page.captured_blocks(code_rows, formulas, bodies).select("page_id", "seq", "type")


def capture_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as responses of a service: those that can hold articles, decoded, within the bounds of a capture."""
    kind = F.col("event_type")
    url = F.when(kind == "view", "https://api.x.com/graphql/a").when(kind == "click", "https://x.com/i/api/b").when(kind == "error", "https://evil.example/graphql").otherwise("https://x.com/plain")
    is_base64 = kind == "click"
    body = F.when(is_base64, F.base64(F.col("props").cast("binary"))).otherwise(F.col("props"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("capture_id"), F.col("event_id").alias("payload_idx"), url.alias("url"), F.when(kind == "signup", "application/json").otherwise("text/plain").alias("mime"), body.alias("body"), is_base64.alias("base64"))
    return candidate_responses(rows).select("capture_id", "payload_idx", F.md5(F.col("body").cast("binary")).alias("body_md5"))


def stopped_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of six quiet hours that are stopped after half a day."""
    from structdoc.streaming.capture import quiet_sessions

    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = quiet_sessions(events, ["user_id"], "ts", "6 hours", longest="12 hours")
    return found.select("user_id", F.unix_micros("start").alias("start"), "n", "stopped")
