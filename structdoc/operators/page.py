"""Documents of rendered pages: roots, linked articles, embedded posts and media, and the blocks put together.

Null attributes and texts match no rule; elements of pages that repeat a page_id can't be told apart; empty tables give empty
results. Columns that start with an underscore are used inside and don't come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structdoc.functions import text as T
from structdoc.functions import urls as U
from structdoc.functions.code import page_language
from structdoc.operators import blocks as B
from structdoc.operators import dom, inventory, lookup, merge

# Distances, sizes and scores that decide results.
SUPPLEMENT_ABOVE, SUPPLEMENT_BELOW = 300, 600
CAPTURE_ABOVE, CAPTURE_BELOW, CAPTURE_CHARS = 1000, 1800, 4
EMBEDDED_IMAGES = 4
POST_TITLE = 90
TITLE_CHARS, TITLE_TAGS = 8, ("h1", "h2", "h3", "strong", "span", "div")
NO_TITLE = r"(?i)^https?://|^x\.com\b|^twitter\.com\b|^(?:show more|read more|article|long post)$"
ARTICLE_PATH, POST_PATH = r"/article/\d+", r"/status/(\d+)"


def card_title_score(is_link: Column, is_heading: Column, chars: Column, children: Column, size: Column, weight: Column) -> Column:
    """How likely an element of a link card is its title; size and weight of its letters may be null, as they come from a browser."""
    shown = F.when(size.isNotNull(), 12 * F.least(size, F.lit(36))).otherwise(0) + F.when(weight.isNotNull(), (weight - 400) / 2).otherwise(0)
    return F.when(is_link, 80).otherwise(0) + F.when(is_heading, 600).otherwise(0) + shown + F.when(chars.between(18, 180), 180).otherwise(0) - F.when(children > 8, 240).otherwise(0)


def linked_article(nodes: DataFrame) -> DataFrame:
    """The first link of each page to an article: page_id, url without query and fragment, title_hint.

    The hint is the best title among the texts of the card around the link, or of the link itself: cleaned, of TITLE_CHARS letters or more, no address and none of
    the phrases that every card has. Of equal scores the longer text counts, then the earlier.
    """
    is_link = (F.col("tag") == "a") & F.coalesce(dom.attr("href").rlike(ARTICLE_PATH), F.lit(False))
    first = lookup.top_k(nodes.where(is_link), ["page_id"], [F.col("pre")], 1).select("page_id", F.col("node_id").alias("link_id"), F.col("pre").alias("_pre"), F.col("post").alias("_post"), U.without_query(dom.attr("href")).alias("url"))
    is_card = F.coalesce(dom.attr("data-testid") == "card.wrapper", F.lit(False))
    cards = nodes.where(is_card).select("page_id", "pre", F.col("pre").alias("_card_pre"), F.col("post").alias("_card_post"))
    scope = lookup.asof(first.withColumnRenamed("_pre", "at"), cards, ["page_id"], "at", "pre", ["_card_pre", "_card_post"]).withColumnRenamed("at", "_pre")
    around = F.coalesce(F.col("_card_post") > F.col("_post"), F.lit(False))
    scope = scope.select("page_id", "link_id", F.when(around, F.col("_card_pre")).otherwise(F.col("_pre")).alias("_from"), F.when(around, F.col("_card_post")).otherwise(F.col("_post")).alias("_to"))
    children = nodes.groupBy("page_id", F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("_children"))
    said = T.clean_title(F.col("text"), F.lit(""), F.lit(""))
    texts = nodes.where(F.col("tag").isin(*TITLE_TAGS, "a")).join(scope, "page_id").where(F.col("pre").between(F.col("_from"), F.col("_to")) & ((F.col("tag") != "a") | (F.col("node_id") == F.col("link_id"))))
    texts = texts.withColumn("_text", said).where(T.is_plausible_title(F.col("_text")) & (F.length("_text") >= TITLE_CHARS) & ~F.col("_text").rlike(NO_TITLE))
    none = F.lit(None).cast("double")
    texts = texts.join(children, ["page_id", "node_id"], "left").withColumn("_score", card_title_score(F.col("tag") == "a", F.col("tag").isin("h1", "h2", "h3"), F.length("_text"), F.coalesce("_children", F.lit(0)), none, none))
    best = lookup.top_k(texts, ["page_id", "link_id"], [F.desc("_score"), F.desc(F.length("_text")), F.asc("pre")], 1).select("page_id", "link_id", F.col("_text").alias("title_hint"))
    return first.join(best, ["page_id", "link_id"], "left").select("page_id", "url", "title_hint")


def post_root(nodes: DataFrame, posts: DataFrame) -> DataFrame:
    """The article element of each page's post: that with a time inside a link to the post, else with a link to it, else the first. posts: page_id, post_id."""
    held = dom.owner_of(nodes, F.col("tag") == "article", "article_id").where("article_id IS NOT NULL")
    link = F.when(F.col("tag") == "a", F.nullif(F.regexp_extract(dom.attr("href"), POST_PATH, 1), F.lit("")))
    met = held.join(posts.select("page_id", "post_id"), "page_id", "left").withColumn("_hit", F.coalesce(link == F.col("post_id"), F.lit(False)))
    linked = dom.owner_of(met, F.col("_hit"), "_link")
    timed = (F.col("tag") == "time") & F.col("_link").isNotNull()
    ranked = linked.groupBy("page_id", "article_id").agg(F.max(F.when(timed, 2).when(F.col("_hit"), 1).otherwise(0)).alias("_hits"), F.min("pre").alias("pre"))
    best = lookup.top_k(ranked, ["page_id"], [F.desc("_hits"), F.asc("pre")], 1).select("page_id", F.col("article_id").alias("node_id"))
    return best.join(nodes.select("page_id", "node_id", "pre", "post"), ["page_id", "node_id"])


def supplemental_blocks(nodes: DataFrame, root: DataFrame) -> DataFrame:
    """Code elements outside the root whose top, from a browser, lies near it. nodes and root with top; root with bottom."""
    bounds = root.select("page_id", F.col("pre").alias("_pre"), F.col("post").alias("_post"), F.col("top").alias("_top"), F.col("bottom").alias("_bottom"))
    found = nodes.where(dom.kind() == "code").join(bounds, "page_id").where("pre < _pre OR post > _post")
    return found.where(F.col("top").between(F.col("_top") - SUPPLEMENT_ABOVE, F.col("_bottom") + SUPPLEMENT_BELOW)).drop("_pre", "_post", "_top", "_bottom")


def captured_blocks(code: DataFrame, formulas: DataFrame, bodies: DataFrame) -> DataFrame:
    """Code and formulas captured while the page was scrolled, near the body: page_id, type, text, latex, mathml, top, seq.

    code: page_id, seq, text, top; formulas: page_id, seq, latex, mathml, top; bodies: page_id, body_top, body_bottom. Without a top nothing is near.
    """
    rows = code.where(F.length("text") >= CAPTURE_CHARS).select("page_id", F.lit("code").alias("type"), "text", F.lit(None).cast("string").alias("latex"), F.lit(None).cast("string").alias("mathml"), "top", "seq")
    shown = formulas.where(F.coalesce(F.nullif("latex", F.lit("")), F.nullif("mathml", F.lit(""))).isNotNull())
    rows = rows.unionByName(shown.select("page_id", F.lit("formula").alias("type"), F.lit(None).cast("string").alias("text"), "latex", "mathml", "top", "seq"))
    near = F.col("top").between(F.col("body_top") - CAPTURE_ABOVE, F.col("body_bottom") + CAPTURE_BELOW)
    return rows.join(bodies.select("page_id", "body_top", "body_bottom"), "page_id").where(near).drop("body_top", "body_bottom")


def embedded_posts(nodes: DataFrame) -> DataFrame:
    """Posts inside an article: page_id, post_node, author_handle, published, text, url, and the first images.

    A nested article element, or one marked as embedded, is a post; its author is the first @handle, its date the first time.
    """
    is_post = dom.kind() == "embedded_post"
    held = dom.owner_of(nodes, is_post, "post_node").where("post_node IS NOT NULL AND post_node <> node_id")
    text = T.normalize_text(F.col("text"))
    handle = F.nullif(F.regexp_extract(text, r"^@([A-Za-z0-9_]{1,15})$", 1), F.lit(""))
    first = lambda value: F.min_by(value, F.when(value.isNotNull(), F.col("pre")))
    is_body = F.col("tag").isin("p", "blockquote") & (text != "")
    link = F.when(F.col("tag") == "a", F.when(dom.attr("href").rlike(POST_PATH), dom.attr("href")))
    image = F.when((F.col("tag") == "img") & dom.attr("src").isNotNull(), F.struct("pre", dom.attr("src").alias("src")))
    parts = F.transform(F.array_sort(F.collect_list(F.when(is_body, F.struct("pre", text.alias("text"))))), lambda x: x["text"])
    out = held.groupBy("page_id", "post_node").agg(
        first(handle).alias("author_handle"), first(F.when(F.col("tag") == "time", dom.attr("datetime"))).alias("published"),
        F.array_join(parts, "\n").alias("text"), first(link).alias("url"),
        F.transform(F.slice(F.array_sort(F.collect_list(image)), 1, EMBEDDED_IMAGES), lambda x: x["src"]).alias("images"),
    )
    return out.where("author_handle IS NOT NULL OR published IS NOT NULL OR text <> ''")


def media_elements(nodes: DataFrame) -> DataFrame:
    """Videos of pages: page_id, node_id, poster, kind (gif or video), url of the status link around or nearest before; those with neither go."""
    is_media = dom.kind() == "media"
    outer = dom.owner_of(nodes, is_media, "media_id")
    poster = F.coalesce(dom.attr("poster"), F.when(F.col("tag") == "img", dom.attr("src")))
    hinted = F.lower(F.coalesce(dom.hint(), F.lit(""))).rlike(r"\bgif\b|tweet_video")
    found = outer.where("media_id IS NOT NULL").groupBy("page_id", F.col("media_id").alias("node_id")).agg(
        F.min_by(poster, F.when(poster.isNotNull(), F.col("pre"))).alias("poster"), F.max(F.when(hinted, 1).otherwise(0)).alias("_gif"), F.min("pre").alias("pre")
    )
    links = nodes.where((F.col("tag") == "a") & F.coalesce(dom.attr("href").rlike(POST_PATH), F.lit(False))).select("page_id", "pre", dom.attr("href").alias("url"))
    met = lookup.asof(found, links, ["page_id"], "pre", "pre", ["url"]).where("poster IS NOT NULL OR url IS NOT NULL")
    return met.select("page_id", "node_id", "poster", F.when(F.col("_gif") == 1, "gif").otherwise("video").alias("kind"), "url")


def page_root(nodes: DataFrame) -> DataFrame:
    """The best article element of each page, else its body: page_id, node_id, pre, post."""
    best = dom.article_root(nodes).withColumn("_order", F.lit(0))
    body = nodes.where("tag = 'body'").select("page_id", "node_id", "pre", "post", F.lit(1).alias("_order"))
    return lookup.top_k(best.unionByName(body), ["page_id"], [F.col("_order"), F.col("pre")], 1).drop("_order")


#: What a row stands for: the start of an element, its end, or an item or a cell with the element around it.
START, END, PART = 0, 1, 2
#: What tags count for or against the article-like elements around them; see dom.body_scores.
WEIGHTS = ((90, ("p",)), (160, ("h1", "h2", "h3", "h4")), (55, ("img",)), (-45, ("button",)), (-900, ("nav", "aside")))
#: What rows are, as bits of one number, so that they stay narrow.
FLAGS = ("end", "part", "item", "cell", "skipped", "root", "heads", "names", "cover", "list", "ordered", "quote", "figure", "row", "line", "image", "caption", "body", "time", "meta", "text", "owner")
_TEXTS = ("heading", "paragraph")


def _on(*tags: str) -> Column:
    return F.col("tag").isin(*tags)


def _has(name: str, *values: str) -> Column:
    return F.coalesce(dom.attr(name).isin(*values), F.lit(False))


def _bits(**of: Column) -> Column:
    return sum((F.when(which, 1 << FLAGS.index(name)).otherwise(0) for name, which in of.items()), F.lit(0))


def _is(*flags: str) -> Column:
    return F.col("flags").bitwiseAND(sum(1 << FLAGS.index(name) for name in flags)) != 0


def _text() -> Column:
    """The text of a row: where only markup is kept, that without its tags and escapes, which are those that sources.html writes."""
    bare = F.regexp_replace(F.replace("told.html", F.lit("<br>"), F.lit("\n")), "<[^>]+>", "")
    for name, letter in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        bare = F.replace(bare, F.lit(f"&{name};"), F.lit(letter))
    return F.coalesce("told.text", bare)


def _told(nodes: DataFrame) -> DataFrame:
    """Of elements only what documents are made of: of a text one form, of attributes those that are read, and no elements that tell nothing.

    Elements whose inside is counted have a second row for their end, items and cells one that goes with the element around them.
    """
    known = nodes.where("page_id IS NOT NULL").withColumn("kind", dom.kind())
    kind = F.coalesce("kind", F.lit(""))
    is_part, is_text, heads = _on("li", "td", "th"), kind.isin(*_TEXTS), _on("h1", "h2", "h3") | _has("role", "heading")
    shown, drawn = is_text | (kind == "blockquote"), F.col("kind").isNotNull() | _on("img")
    written, origin = shown | is_part | _on("p"), inventory.title_origin()
    parts = {"item": _on("li"), "cell": _on("td", "th")}
    own = parts | {
        "skipped": dom.is_skipped(), "root": _on("article", "main", "section") | _has("role", "document"), "heads": heads, "names": _has("data-testid", "User-Name"), "cover": _on("meta") & _has("property", "og:image"),
        "list": _on("ul", "ol"), "ordered": _on("ol"), "quote": _on("blockquote"), "figure": _on("figure"), "row": _on("tr"), "line": _on("p"), "image": _on("img"), "caption": _on("figcaption", "cite"), "body": _on("body"), "time": _on("time"),
        "meta": _on("meta"), "text": is_text, "owner": kind.isin(*dom.OWNERS),
    }
    rows = known.select(
        "page_id", "node_id", "parent_id", "pre", "post", "depth", "table_id", "text_chars", "kind", origin.alias("origin"), _bits(**own).alias("own"), _bits(part=is_part, **parts).alias("parts"), shown.alias("shown"),
        sum((F.when(_on(*tags), n).otherwise(0) for n, tags in WEIGHTS), F.lit(0)).alias("weight"), F.when(kind == "heading", dom.heading_level()).alias("level"),
        (~is_text | T.is_useful_text(T.normalize_text(F.when(is_text, F.col("text"))))).alias("useful"), F.when(written, F.col("html")).alias("html"),
        F.when(kind == "code", page_language(F.coalesce(dom.attr("class"), F.lit("")), F.coalesce("text", F.lit("")))).alias("language"),
        F.when(~written | F.col("html").isNull() | (kind == "code") | (is_part & (heads | origin.isNotNull())), F.col("text")).alias("text"),
        F.when(drawn, dom.attr("src")).alias("src"), F.when(drawn, dom.attr("alt")).alias("alt"), F.when(_on("meta"), dom.attr("content")).when(_on("time"), dom.attr("datetime")).alias("value"),
    )
    held = lambda *names: F.col("own").bitwiseAND(sum(1 << FLAGS.index(n) for n in names)) != 0
    more = lambda which, event: F.when(which, F.array(F.lit(event))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("event", F.explode(F.concat(F.array(F.lit(START)), more(held("root", "text"), END), more(F.col("parts") != 0, PART))))
    says = F.coalesce("kind", "origin", "text", "html", "value").isNotNull()
    tells = says | held("skipped", "root", "heads", "names", "cover", "body", "row") | (F.col("weight") != 0)
    rows = rows.where(tells | (F.col("event") < START))  # names the event, so that it stays behind what it reads instead of being worked out twice
    starts = F.col("event") == START
    html = F.when(~starts | F.col("shown") | (F.col("parts") == 0), F.col("html"))
    told = F.struct(*(F.when(starts, F.col(c)).alias(c) for c in ("kind", "level", "text", "language", "src", "alt", "origin", "value", "useful")), html.alias("html"))
    return rows.select(
        "page_id", "node_id", F.when(~starts | held("caption"), F.col("parent_id")).alias("parent_id"), F.when(F.col("event") == END, F.col("post")).otherwise(F.col("pre")).alias("at"), "post", F.col("depth").cast("int").alias("depth"),
        F.when(F.col("event") == PART, F.col("table_id")).alias("table_id"), F.when(starts & held("root"), F.col("text_chars")).alias("chars"), F.when(starts, F.col("weight")).otherwise(0).alias("weight"),
        F.when(starts, F.col("own")).when(F.col("event") == PART, F.col("parts")).otherwise(_bits(end=F.lit(True))).alias("flags"), F.when(says & (F.col("event") != END), told).alias("told"),
    )


def _placed(nodes: DataFrame) -> DataFrame:
    """Rows of _told() with what they stand in: one shuffle, two sorts.

    What stands in what is found by running values over a page's starts and ends, what an element holds by their growth between the two.
    """
    w = Window.partitionBy("page_id").orderBy("at", _is("part"))
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    owners = ("list", "quote", "figure", "names")
    reached = lambda which, frame: F.max(F.when(which, F.col("post"))).over(frame)
    first = lambda name: _is(name) & F.coalesce(reached(_is(name), before) < F.col("post"), F.lit(True))
    rows = _told(nodes).withColumns(
        {"nth": F.row_number().over(w), "shut": F.coalesce(reached(_is("skipped"), upto) >= F.col("post"), F.lit(False)), "weighed": F.sum("weight").over(upto)} | {f"_{k}": first(k) for k in owners}
    )
    held = {k: F.last(F.when(F.col(f"_{k}"), F.struct("node_id", "post", "depth")), ignorenulls=True).over(upto) for k in owners}
    rows = rows.withColumns({"marked": F.sum(F.when(_is("text", "owner") & ~F.col("shut"), 1).otherwise(0)).over(upto), **held})
    around = {k: F.when(F.col(f"{k}.post") >= F.col("post"), F.col(k)) for k in owners}
    rows = rows.select(
        "page_id", "node_id", "parent_id", F.col("at").alias("pre"), "post", "table_id", "chars", "flags", "told", (F.col("nth") == 1).alias("leads"), "shut", "weighed", "marked", F.when(_is("part"), F.col("parent_id")).otherwise(F.col("node_id")).alias("key"),
        F.when(_is("item"), around["list"]["node_id"]).when(_is("line"), around["quote"]["node_id"]).when(_is("image"), around["figure"]["node_id"]).alias("owner"),
        F.when(_is("item"), F.floor((F.col("depth") - 1 - around["list"]["depth"]) / 2).cast("int")).alias("depth"), F.coalesce(around["names"]["node_id"] != F.col("node_id"), F.lit(False)).alias("named"),
    )
    own, page = Window.partitionBy("page_id", "key"), Window.partitionBy("page_id")
    grown = lambda c: F.max(F.when(_is("end"), F.col(c))).over(own) - F.max(F.when(~_is("end", "part"), F.col(c))).over(own)
    outer = F.max(F.when(_is("list", "row"), F.col("flags"))).over(own)
    rows = rows.withColumns({"score": F.col("chars") + grown("weighed"), "holds": F.coalesce(grown("marked") > 0, F.lit(False)), "outer": outer}).where(~_is("end")).drop("chars", "weighed", "marked")
    rank = lambda order, score: F.struct(F.lit(order).alias("order"), score.cast("long").alias("score"), (-F.col("pre")).alias("first"), "post")
    root = F.max(F.when(F.col("score") > dom.LEAST_SCORE, rank(1, F.col("score"))).when(_is("body"), rank(0, F.lit(0)))).over(page)
    rows = rows.withColumn("root", root).withColumn("inside", F.coalesce((F.col("pre") > -F.col("root.first")) & (F.col("post") < F.col("root.post")), F.lit(False))).drop("root", "score")
    rows = rows.withColumn("found", F.col("told.kind").isNotNull() & ~F.col("shut") & F.col("inside")).drop("shut")
    ordered = Window.partitionBy("page_id").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    owned = F.coalesce(reached(F.col("found") & _is("owner"), ordered) > F.col("post"), F.lit(False))
    is_block = F.col("found") & ~owned & ~(_is("text") & F.col("holds")) & F.col("told.useful")
    return rows.withColumn("is_block", F.coalesce(is_block, F.lit(False))).drop("found", "holds", "key", "post")


def page_rows(nodes: DataFrame) -> DataFrame:
    """A row for each block of pages, with the items of lists, the paragraphs of quotes and the rows of tables, and one of null type for each page: doc_id, block_idx, ...

    block_idx goes up in document order; _title and _cover_image are the page's, and _facts, in rows without a type, all that is known of it. Blocks that a page has
    are those of dom.page_blocks. A part, such as an item, goes with the outermost list, quote or figure that it stands in, a cell with its row, and rows with their table.
    """
    outer = lambda name: F.coalesce(F.col("outer").bitwiseAND(1 << FLAGS.index(name)) != 0, F.lit(False))
    role = (
        F.when(F.col("leads"), "page").when(F.col("is_block"), "block").when(_is("part") & _is("item") & outer("list") & F.col("owner").isNotNull(), "item").when(_is("part") & _is("cell") & outer("row") & F.col("table_id").isNotNull(), "cell")
        .when(_is("line") & F.col("owner").isNotNull(), "line").when(_is("image") & F.col("owner").isNotNull(), "picture").when(_is("caption") & F.col("parent_id").isNotNull(), "caption")
    )
    # what tells of the page: titles outside the root, the first heading in it, and the first cover, date, handle and name
    titled, said = ~F.col("inside") & F.col("told.origin").isNotNull(), F.col("told.value")
    rows = _placed(nodes).withColumns({"role": role, "raw": F.when(titled | (_is("heads") & F.col("inside")), T.normalize_text(F.when(_is("meta"), said).otherwise(_text()))), "name": F.when(F.col("named"), T.collapse(_text()))})
    handle, name = inventory.named("name")
    at = lambda which, value: F.when(which, F.struct("pre", value.alias("value")))
    first = {"head": at(_is("heads") & F.col("inside"), F.col("raw")), "cover_image": at(_is("cover"), said), "published": at(_is("time") & said.isNotNull(), said), "seen": at(handle.isNotNull(), handle), "name": at(name.isNotNull(), name)}

    def title(which: Column, origin: Column, raw: Column, pre: Column) -> Column:
        text = T.clean_title(F.when(which, raw), F.lit(""), F.lit(""))
        return F.when(which & T.is_plausible_title(text), F.struct(inventory.title_score(origin, raw).alias("score"), F.length(text).alias("chars"), (-pre).alias("first"), text.alias("text")))

    as_ = lambda role, value: F.when(F.col("role") == role, value)
    unit = F.coalesce(as_("block", F.col("node_id")), F.when(F.col("role").isin("item", "line", "picture"), F.col("owner")), F.when(F.col("role").isin("cell", "caption"), F.col("parent_id")), F.lit(-1))
    html = T.tidy_breaks(F.col("told.html"))
    code = F.regexp_replace(F.regexp_replace(F.coalesce("told.text", F.lit("")), r"[ \t]+\n", "\n"), r"^\n+|\n+$", "")
    told = {
        "page": F.lit(True), "block": F.struct("pre", "told.kind", "told.level", F.when(F.col("told.kind").isin(*_TEXTS, "blockquote"), html).alias("html"), F.when(F.col("told.kind") == "code", code).alias("text"), "told.language", "told.src", "told.alt"),
        "item": F.struct("pre", "depth", outer("ordered").alias("ordered"), F.col("told.html").alias("html")), "line": F.struct("pre", html.alias("html")), "cell": F.struct("pre", html.alias("html"), "table_id"),
        "picture": F.struct("pre", "told.src", "told.alt"), "caption": F.struct("pre", T.collapse(_text()).alias("text")),
    }
    each = rows.select("page_id", unit.alias("unit"), *(as_(k, v).alias(k) for k, v in told.items()), title(titled, F.col("told.origin"), F.col("raw"), F.col("pre")).alias("title"), *(v.alias(f"_{k}") for k, v in first.items()))
    one = {"page": F.max, "block": F.max, "picture": F.min, "title": F.max, **{f"_{k}": F.min for k in first}}
    listed = lambda c: F.array_sort(F.collect_list(c))
    full = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    units = each.groupBy("page_id", "unit").agg(*(f(k).alias(k) for k, f in one.items()), F.min("caption").alias("caption"), *(listed(k).alias(k) for k in ("item", "line", "cell")))
    table = F.when(F.col("block").isNull(), F.get("cell", F.lit(0))["table_id"])
    row = F.when(table.isNotNull() & F.exists("cell", lambda c: c["html"] != ""), F.struct(F.get("cell", F.lit(0))["pre"].alias("pre"), F.transform("cell", lambda c: c["html"]).alias("cells")))
    units = units.select("page_id", F.coalesce(table, "unit").alias("unit"), *one, F.when(table.isNull(), F.col("caption")).alias("caption"), full("item"), full("line"), row.alias("row"))
    met = units.groupBy("page_id", "unit").agg(*(f(k).alias(k) for k, f in one.items()), F.min("caption").alias("caption"), F.max("item").alias("item"), F.max("line").alias("line"), listed("row").alias("row"))
    page = Window.partitionBy("page_id")
    met = met.withColumns({k: one[k](k).over(page) for k in one if k not in ("page", "block", "picture")}).where("block IS NOT NULL OR page")
    head = title(F.col("_head").isNotNull(), F.lit("body"), F.col("_head.value"), F.col("_head.pre"))
    facts = {"title": F.greatest("title", head)["text"]} | {k: F.col(f"_{k}.value") for k in first if k != "head"}
    met = met.select("page_id", "page", "block", "picture", "caption", "item", "line", "row", F.struct(*(v.alias(k) for k, v in facts.items())).alias("facts"))
    kind, null = F.col("block.kind"), F.lit(None).cast("string")
    numbered = F.transform("item", lambda x, i: F.struct(i.alias("item"), x["depth"].alias("depth"), x["ordered"].alias("ordered"), x["html"].alias("html")))
    paragraphs = F.coalesce(F.transform("line", lambda x: x["html"]), F.array_compact(F.array(F.nullif("block.html", F.lit("")))))
    return met.select(
        F.col("page_id").alias("doc_id"), F.coalesce("block.pre", F.lit(-1)).alias("block_idx"), kind.alias("type"), "block.level", F.when(kind.isin(*_TEXTS), F.col("block.html")).alias("html"),
        "block.text", "block.language", F.when(kind == "code", F.size(F.split("block.text", "\n"))).alias("line_count"), F.coalesce("block.src", "picture.src").alias("src"), null.alias("source_url"),
        F.when(kind.isNotNull(), F.coalesce("block.alt", "picture.alt", F.lit(""))).alias("alt"), F.col("caption.text").alias("caption"), null.alias("latex"), null.alias("mathml"), F.when(kind == "blockquote", paragraphs).alias("paragraphs"),
        F.when((kind == "table") & (F.size("row") > 0), F.transform("row", lambda r: r["cells"])).alias("rows"), F.when(kind == "list", numbered).alias("items"),
        F.when(kind.isNotNull(), F.col("facts.title")).alias("_title"), F.when(kind.isNotNull(), F.col("facts.cover_image")).alias("_cover_image"), F.when(kind.isNull(), F.col("facts")).alias("_facts"),
    )


def page_articles(pages: DataFrame, nodes: DataFrame, captured: DataFrame | None = None, anchors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, blocks) of pages(page_id, url, html) and their elements.

    What was captured while a page was scrolled, with the texts seen beside it, takes its place among the blocks (merge.merge_captured).

    Blocks are those in the page's root without the heading that is the title and without its cover, without copies,
    neighbouring code as one, runs of bulleted paragraphs as lists, and numbered anew. documents: doc_id, type, title, url, author_handle,
    author_name, published, cover_image, blocks. A page without elements has no title and no blocks. Elements are dealt out by pages once, and without
    what was captured they are read once; a row without a type then goes with each page's blocks and carries what is known of the page.
    """
    found = page_rows(nodes)
    if captured is not None:
        known = found.where("type IS NULL")
        blocks = found.where("type IS NOT NULL").withColumn("block_idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("block_idx")) - 1).drop("_title", "_cover_image", "_facts")
        named = known.select("doc_id", F.col("_facts.title").alias("_title"), F.col("_facts.cover_image").alias("_cover_image"), F.lit(None).cast(known.schema["_facts"].dataType).alias("_facts"))
        told = pages.select(F.col("page_id").alias("doc_id")).join(named, "doc_id", "left")
        found = merge.merge_captured(blocks, captured, anchors).drop("captured").join(told, "doc_id").unionByName(known)
    is_title = (F.col("type") == "heading") & (T.canonical_text(T.strip_tags_tight(F.col("html"))) == T.canonical_text(F.col("_title")))
    is_cover = F.col("type").isin("image", "figure") & (U.media_key(F.col("src")) == U.media_key(F.col("_cover_image")))
    found = found.where(~F.coalesce(is_title | is_cover, F.lit(False))).drop("_title", "_cover_image")
    found = B.group_pseudo_lists(B.merge_code(B.drop_copies(found), same_language=False))
    sizes = found.groupBy("doc_id").agg(F.max("_facts").alias("_facts"), F.count("type").alias("blocks"), F.min_by(T.strip_tags_tight(F.col("html")), F.when(F.col("type") == "paragraph", F.col("block_idx"))).alias("_first"))
    met = pages.select(F.col("page_id").alias("doc_id"), "url").join(sizes, "doc_id", "left")
    handle, name = inventory.author_of(F.when(F.col("doc_id").isNotNull(), F.col("url")), F.col("_facts.seen"), F.col("_facts.name"))
    kind = U.page_kind(F.col("url"))
    shown, title = T.normalize_text(F.col("_first")), F.col("_facts.title")
    post = F.when(F.length(shown) > POST_TITLE, F.concat(F.substring(shown, 1, POST_TITLE), F.lit("…"))).otherwise(F.nullif(shown, F.lit("")))
    documents = met.select(
        "doc_id", kind.alias("type"), F.when(kind == "post", F.coalesce(post, title)).otherwise(title).alias("title"), F.coalesce(F.nullif(U.article_url(F.col("url")), F.lit("")), U.without_query(F.col("url"))).alias("url"),
        handle.alias("author_handle"), name.alias("author_name"), "_facts.published", "_facts.cover_image", F.coalesce("blocks", F.lit(0)).alias("blocks"),
    )
    blocks = found.where("type IS NOT NULL").drop("_facts")
    return documents, blocks.withColumn("block_idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("block_idx")) - 1)


def with_page_fallback(articles: DataFrame, blocks: DataFrame, documents: DataFrame, page_blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Articles of captures, and for those that failed or left media and formulas unresolved the page's document: with acquisition_method.

    articles(doc_id, ok, title, url, unresolved), documents and page_blocks of page_articles(). A failed capture without a page stays as it is.
    """
    weak = articles.where(~F.col("ok") | (F.coalesce("unresolved", F.lit(0)) > 0)).select("doc_id")
    pages = documents.join(weak, "doc_id", "left_semi").where("blocks > 0")
    kept = articles.join(pages.select("doc_id"), "doc_id", "left_anti")
    out = kept.select("doc_id", "ok", "title", "url", F.lit("structured").alias("acquisition_method"))
    out = out.unionByName(pages.select("doc_id", F.lit(True).alias("ok"), "title", "url", F.lit("page").alias("acquisition_method")))
    shared = [c for c in blocks.columns if c in page_blocks.columns]
    of_pages = page_blocks.join(pages.select("doc_id"), "doc_id", "left_semi").select(*shared)
    return out, blocks.join(pages.select("doc_id"), "doc_id", "left_anti").select(*shared).unionByName(of_pages)
