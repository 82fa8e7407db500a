"""Blocks from HTML elements: classification, suppression by containment, extraction in document order.

Elements are those of sources.html.html_nodes. Null attributes match no rule, null texts count as empty; document order has no ties
within a page, but elements of pages that repeat a page_id can't be told apart. Empty tables give empty results. Windows hold one page in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structdoc.functions import text as T
from structdoc.functions.code import page_language
from structdoc.operators import lookup

# Hints in names and classes, and kinds of blocks.
SKIP_TAGS = ("button", "nav", "aside", "form")
SKIP_ROLES = ("navigation", "menu", "dialog")
SKIP_TESTIDS = ("User-Name", "reply", "retweet", "like", "bookmark", "caret")
SKIP_HINT = r"(?i)\b(toolbar|menu|navigation|reaction|engagement|follow-button|tweet-actions)\b"
CODE_HINT, QUOTE_HINT = r"\b(?:code-?block|codeblock|syntax-?highlight)\b", r"\b(?:block-?quote|pull-?quote)\b"
OWNERS = ("embedded_post", "link_card", "table", "figure", "media", "list", "code", "blockquote")
LEAST_SCORE = 700
HEADING_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6")


def attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def hint() -> Column:
    return T.dom_hint(attr("id"), attr("class"), attr("data-testid"), attr("role"), attr("aria-label"), attr("data-type"))


def kind() -> Column:
    """The kind of block that an element is by its tag and attributes; null for others."""
    named = F.lower(F.coalesce(hint(), F.lit("")))
    return (
        F.when((F.col("tag") == "article") & (F.col("depth") > 0) & F.coalesce(attr("data-embedded"), F.lit("")).isin("true", "post"), "embedded_post")
        .when(named.contains("card.wrapper") | named.contains("link-card"), "link_card")
        .when(F.col("tag") == "table", "table")
        .when(F.col("tag") == "figure", "figure")
        .when(F.col("tag").isin("video") | named.contains("videoplayer") | named.contains("videocomponent"), "media")
        .when((F.col("tag") == "img") & F.coalesce(attr("src"), attr("srcset")).isNotNull(), "image")
        .when(F.col("tag") == "hr", "separator")
        .when(F.col("tag").isin("ul", "ol"), "list")
        .when((F.col("tag") == "pre") | ((F.col("tag") != "code") & (named.rlike(CODE_HINT) | F.coalesce(attr("data-language"), attr("data-lang")).isNotNull())), "code")
        .when((F.col("tag") == "blockquote") | named.rlike(QUOTE_HINT), "blockquote")
        .when(F.col("tag").isin(*HEADING_TAGS) | (attr("role") == "heading"), "heading")
        .when((F.col("tag") == "p") | (attr("data-block") == "true") | (attr("role") == "paragraph"), "paragraph")
    )


def is_skipped() -> Column:
    """Elements whose subtrees are of no interest: controls, navigation, what is hidden."""
    return F.coalesce(
        F.col("tag").isin(*SKIP_TAGS) | (attr("aria-hidden") == "true") | attr("hidden").isNotNull() | attr("role").isin(*SKIP_ROLES) | attr("data-testid").isin(*SKIP_TESTIDS) | hint().rlike(SKIP_HINT) | F.coalesce(attr("style").rlike(r"(?i)display:\s*none|visibility:\s*hidden|opacity:\s*0(?:\.0+)?\s*(?:;|$)"), F.lit(False)),
        F.lit(False),
    )


def _reach(which: Column, frame) -> Column:
    """Up to where the elements so marked reach that started in the frame: as elements are nested, one that reaches past another holds it."""
    return F.max(F.when(which, F.col("post"))).over(frame)


def _orders() -> tuple:
    """Windows over a page's elements: in document order those up to an element and those before it, and in reverse those behind it."""
    w, back = Window.partitionBy("page_id").orderBy("pre"), Window.partitionBy("page_id").orderBy(F.desc("pre"))
    return w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1), back.rowsBetween(Window.unboundedPreceding, -1)


def owner_of(nodes: DataFrame, which: Column, name: str) -> DataFrame:
    """nodes with the node_id of the outermost element of a kind that an element is or stands in, null for none.

    Outermost elements don't overlap, so the last one that started is the only one that can hold an element: one sort, no join.
    """
    upto, before, _ = _orders()
    which = F.coalesce(which, F.lit(False))
    starts = which & F.coalesce(_reach(which, before) < F.col("post"), F.lit(True))
    held = F.last(F.when(F.col("_starts"), F.struct("node_id", "post")), ignorenulls=True).over(upto)
    out = nodes.withColumn("_starts", starts).withColumn("_held", held)
    return out.withColumn(name, F.when(F.col("_held.post") >= F.col("post"), F.col("_held.node_id"))).drop("_starts", "_held")


def inside(rows: DataFrame, root: DataFrame) -> DataFrame:
    """Rows strictly inside the root of their page; root has a row for each page."""
    r = root.select("page_id", F.col("pre").alias("r_pre"), F.col("post").alias("r_post"))
    return rows.join(r, "page_id").where("pre > r_pre AND post < r_post").drop("r_pre", "r_post")


def body_scores(nodes: DataFrame) -> DataFrame:
    """A score for each article-like element: text, paragraphs, headings and images for it, buttons and navigation against.

    What an element holds is the difference of running counts at its end and at its start, so pages of any size take one sort.
    """
    kinds = {"paragraphs": ("p",), "headings": ("h1", "h2", "h3", "h4"), "images": ("img",), "buttons": ("button",), "navs": ("nav", "aside")}
    is_root = F.col("tag").isin("article", "main", "section") | F.coalesce(attr("role") == "document", F.lit(False))
    counted = F.col("tag").isin(*(t for tags in kinds.values() for t in tags))
    seen = nodes.where(is_root | counted).select("page_id", "tag", "node_id", "pre", "post", "text_chars", is_root.alias("is_root"))
    starts = seen.select("page_id", F.col("pre").alias("at"), "tag", F.when(F.col("is_root"), F.struct("node_id", "text_chars", F.col("pre").alias("r_pre"))).alias("root"))
    ends = seen.where("is_root").select("page_id", F.col("post").alias("at"), F.lit("").alias("tag"), F.struct("node_id", "text_chars", F.col("pre").alias("r_pre")).alias("root"))
    w = Window.partitionBy("page_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    running = {name: F.sum(F.when(F.col("tag").isin(*tags), 1).otherwise(0)).over(w) for name, tags in kinds.items()}
    marks = starts.unionByName(ends).withColumns(running).where("root IS NOT NULL")
    grown = [(F.max(name) - F.min(name)).alias(name) for name in kinds]
    counts = marks.groupBy("page_id", F.col("root.node_id").alias("root_id"), F.col("root.r_pre").alias("r_pre"), F.col("root.text_chars").alias("text_chars")).agg(*grown)
    return counts.withColumn("score", F.expr("text_chars + 90 * paragraphs + 160 * headings + 55 * images - 45 * buttons - 900 * navs"))


def article_root(nodes: DataFrame, least: int = LEAST_SCORE) -> DataFrame:
    """The element with the highest score above ``least`` for each page."""
    best = lookup.keep_best(body_scores(nodes).where(F.col("score") > least), ["page_id"], F.col("score"), "r_pre")
    return best.select("page_id", F.col("root_id").alias("node_id")).join(nodes, ["page_id", "node_id"]).select("page_id", "node_id", "pre", "post")


def classified(nodes: DataFrame, root: DataFrame | None = None) -> DataFrame:
    """Elements with their kinds: those in the root, outside skipped subtrees and owners, of text only the innermost.

    All are running maxima over a page's elements in document order: one shuffle and one sort, however many elements a page has.
    """
    upto, before, after = _orders()
    known = nodes.withColumn("kind", kind()).withColumn("_shut", F.coalesce(_reach(is_skipped(), upto) >= F.col("post"), F.lit(False)))
    found = known.where("kind IS NOT NULL AND NOT _shut").drop("_shut")
    if root is not None:
        found = inside(found, root)
    is_owner = F.col("kind").isin(*OWNERS)
    found = found.withColumn("_owned", F.coalesce(_reach(is_owner, before) > F.col("post"), F.lit(False))).where("NOT _owned").drop("_owned")
    is_text = F.col("kind").isin("heading", "paragraph")
    following = F.last(F.when(is_text | is_owner, F.col("post")), ignorenulls=True).over(after)
    held = F.coalesce(following < F.col("post"), F.lit(False))  # the next block starts before this one ends
    return found.withColumn("_holds", is_text & held).where("NOT _holds").drop("_holds")


def heading_level() -> Column:
    digit = F.regexp_extract("tag", r"^h([1-6])$", 1)
    level = F.coalesce(F.try_to_number(F.nullif(digit, F.lit("")), F.lit("9")).cast("int"), F.coalesce(attr("aria-level"), F.lit("2")).try_cast("int"))
    return F.when(F.col("kind") == "heading", F.least(F.lit(4), F.greatest(F.lit(2), level)))


def list_items(nodes: DataFrame) -> DataFrame:
    """Items of lists as rows: their list, the item that holds the list, depth, position and own text without nested lists."""
    lists = nodes.where(F.col("tag").isin("ul", "ol")).select("page_id", F.col("node_id").alias("list_id"), F.col("parent_id").alias("holder"), (F.col("tag") == "ol").alias("ordered"), attr("start").try_cast("int").alias("start"))
    items = nodes.where("tag = 'li'").select("page_id", F.col("node_id").alias("item_id"), F.col("parent_id").alias("list_id"), "pre", "text", "html")
    met = items.join(lists, ["page_id", "list_id"])
    position = F.row_number().over(Window.partitionBy("page_id", "list_id").orderBy("pre")) - 1
    holders = items.select("page_id", F.col("item_id").alias("holder"), F.lit(True).alias("nested"))
    out = met.withColumn("pos", position).join(holders, ["page_id", "holder"], "left")
    return out.select("page_id", "list_id", "item_id", F.when(F.col("nested"), F.col("holder")).alias("parent_item_id"), "ordered", "start", "pos", T.collapse(F.col("text")).alias("text"))


def table_cells(nodes: DataFrame) -> DataFrame:
    """Cells of tables as rows with their places, header flags and spans."""
    cells = nodes.where(F.col("tag").isin("td", "th")).select("page_id", F.col("parent_id").alias("row_id"), "pre", (F.col("tag") == "th").alias("header"), T.tidy_breaks(F.col("html")).alias("html"), attr("colspan").try_cast("int").alias("colspan"), attr("rowspan").try_cast("int").alias("rowspan"))
    own = nodes.where("tag = 'tr' AND table_id IS NOT NULL").select("page_id", F.col("node_id").alias("row_id"), F.col("pre").alias("row_pre"), "table_id")
    place = F.dense_rank().over(Window.partitionBy("page_id", "table_id").orderBy("row_pre")) - 1
    column = F.row_number().over(Window.partitionBy("page_id", "row_id").orderBy("pre")) - 1
    return cells.join(own, ["page_id", "row_id"]).select("page_id", "table_id", place.alias("row"), column.alias("column"), "header", "html", F.when(F.col("colspan") > 0, F.col("colspan")).alias("colspan"), F.when(F.col("rowspan") > 0, F.col("rowspan")).alias("rowspan"))


def page_blocks(nodes: DataFrame, root: DataFrame | None = None, keep: str | None = None) -> DataFrame:
    """Blocks of pages in document order: page_id, block_idx, type, level, html, text, language, src, alt, caption, and one more column of nodes if asked.

    A figure has the source and text of its first image.
    """
    found = classified(nodes, root)
    captions = nodes.where("tag IN ('figcaption', 'cite')").select("page_id", F.col("parent_id").alias("node_id"), T.collapse(F.col("text")).alias("caption"))
    captions = captions.groupBy("page_id", "node_id").agg(F.first("caption").alias("caption"))
    found = found.join(captions, ["page_id", "node_id"], "left")
    shown = owner_of(nodes, F.col("tag") == "figure", "figure_id").where("tag = 'img' AND figure_id IS NOT NULL")
    pictures = shown.groupBy("page_id", F.col("figure_id").alias("node_id")).agg(F.min_by(F.struct(attr("src").alias("src"), attr("alt").alias("alt")), "pre").alias("picture"))
    found = found.join(pictures, ["page_id", "node_id"], "left")
    text = F.when(F.col("kind") == "code", F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t]+\n", "\n"), r"^\n+|\n+$", "")).otherwise(T.normalize_text(F.col("text")))
    out = found.select(
        "page_id", "pre", F.col("kind").alias("type"), heading_level().alias("level"), T.tidy_breaks(F.col("html")).alias("html"), text.alias("text"),
        F.when(F.col("kind") == "code", page_language(F.coalesce(attr("class"), F.lit("")), F.coalesce("text", F.lit("")))).alias("language"),
        F.coalesce(attr("src"), F.col("picture.src")).alias("src"), F.coalesce(attr("alt"), F.col("picture.alt"), F.lit("")).alias("alt"), "caption", *([keep] if keep else []),
    )
    out = out.where(~F.col("type").isin("heading", "paragraph") | T.is_useful_text(F.col("text")))
    position = F.row_number().over(Window.partitionBy("page_id").orderBy("pre")) - 1
    return out.withColumn("block_idx", position).drop("pre")
