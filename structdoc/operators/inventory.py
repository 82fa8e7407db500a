"""Media, titles, covers, cards and polls of pages, as filters, scores and nearest matches.

Positions (top, bottom) come from a browser and may be null; rules by position then don't apply. Of equal scores the least sequence, or place, wins;
null addresses are no media; rows that repeat count once where the best is kept. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structdoc.functions import text as T
from structdoc.functions import urls as U
from structdoc.operators import dom, lookup

# Sizes, distances and scores that decide results.
LEAST_WIDTH, LEAST_HEIGHT, LEAST_AREA, SMALL_AREA = 150, 80, 32_000, 250_000
LEAST_RATIO, MOST_RATIO = 0.08, 12
SMALL_HINT = r"(?i)avatar|emoji|badge|icon|profile|UserAvatar"
ENGAGEMENT = r"(?i)@[A-Za-z0-9_]+|\bFollow\b|\bReply\b|\bRepost\b"
TITLE_SCORES = {"explicit": 1500, "h1": 1300, "heading": 900, "meta": 700, "document": 520, "body": 120}
SLACK = 8


def last_candidate(srcset: Column) -> Column:
    """The address of the last candidate of a srcset, which is the largest where they are written in order; null without any."""
    candidates = F.filter(F.transform(F.split(srcset, ","), lambda c: T.strip(c)), lambda c: c != "")
    return F.nullif(F.element_at(F.split(F.try_element_at(candidates, F.lit(-1)), r"\s"), 1), F.lit(""))


def image_addresses(nodes: DataFrame) -> DataFrame:
    """The images of pages with the address that they show: page_id, node_id, pre, src, alt.

    The last candidate of the image's srcset counts, or without one of that of the first source with a srcset in the picture around it, then src; addresses that hold the
    data themselves don't count, and src is null if no other is left. A page without images has no rows.
    """
    outer = dom.owner_of(nodes, F.col("tag") == "picture", "picture_id")
    told = F.when(F.col("tag") == "source", F.nullif(dom.attr("srcset"), F.lit("")))
    sources = outer.where(told.isNotNull() & F.col("picture_id").isNotNull()).groupBy("page_id", "picture_id").agg(F.min_by(told, "pre").alias("_around"))
    images = outer.where("tag = 'img'").join(sources, ["page_id", "picture_id"], "left")
    srcset = F.coalesce(F.nullif(dom.attr("srcset"), F.lit("")), F.col("_around"))
    outside = lambda c: F.when(~c.rlike("^(?:data|blob):") & (c != ""), c)
    return images.select("page_id", "node_id", "pre", F.coalesce(outside(last_candidate(srcset)), outside(dom.attr("src"))).alias("src"), dom.attr("alt").alias("alt"))


def usable_images(images: DataFrame) -> DataFrame:
    """Images with an allowed address that aren't too small, too narrow or likely avatars. images: src, width, height, hint, ..."""
    src = U.media_url(F.col("src"), "large", fill_format=False)
    area, ratio = F.col("width") * F.col("height"), F.col("width") / F.col("height")
    sized = (F.col("width") > 0) & (F.col("height") > 0)
    good = (F.col("width") >= LEAST_WIDTH) & (F.col("height") >= LEAST_HEIGHT) & (area >= LEAST_AREA) & ratio.between(LEAST_RATIO, MOST_RATIO)
    small = F.coalesce(F.col("hint").rlike(SMALL_HINT), F.lit(False)) & (F.coalesce(area, F.lit(0)) < SMALL_AREA)
    return images.withColumn("src", src).withColumn("area", F.coalesce(area, F.lit(0))).where(F.col("src").isNotNull() & (~F.coalesce(sized, F.lit(False)) | good) & ~small)


def largest_images(images: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of images that differ in size only, the largest, the first of equals."""
    keyed = images.withColumn("media_key", U.media_key(F.col("src")))
    return lookup.keep_best(keyed, [*keys, "media_key"], F.col("area"), order)


def media_score(live: Column, top: Column, anchored: Column, kind: Column, width: Column, body_top: Column, body_bottom: Column) -> Column:
    yes = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    near = (top >= body_top - 400) & (top <= body_bottom + 400)
    return yes(live, 200) + yes(top.isNotNull(), 100) + yes(anchored, 60) + F.when(kind == "image", F.least(F.coalesce(width, F.lit(0)), F.lit(2000)) / 10).otherwise(0) + yes(near, 100)


def media_inventory(live: DataFrame, captured: DataFrame, bodies: DataFrame, reach: tuple[int, int] = (1600, 2200)) -> DataFrame:
    """Live and captured media near the body, one for each address without size: the best by score, the first of equals.

    Both: page_id, seq, type, src, width, height, top, before_text, after_text; bodies: page_id, body_top, body_bottom.
    """
    both = live.withColumn("live", F.lit(True)).unionByName(captured.withColumn("live", F.lit(False)), allowMissingColumns=True)
    met = both.join(bodies, "page_id").where(F.col("top").isNull() | F.col("top").between(F.col("body_top") - reach[0], F.col("body_bottom") + reach[1]))
    anchored = F.coalesce(F.nullif("before_text", F.lit("")), F.nullif("after_text", F.lit(""))).isNotNull()
    score = media_score(F.col("live"), F.col("top"), anchored, F.col("type"), F.col("width"), F.col("body_top"), F.col("body_bottom"))
    keyed = met.withColumn("media_key", U.media_key(F.col("src"))).where("media_key <> ''").withColumn("score", score)
    return lookup.keep_best(keyed, ["page_id", "media_key"], F.col("score"), "seq")


def nearest_anchors(items: DataFrame, anchors: DataFrame) -> DataFrame:
    """The texts nearest above and below each item. items: page_id, item_id, top, bottom; anchors: page_id, a_top, a_bottom, text."""
    asked = items.select("page_id", "item_id", (F.col("top") + SLACK).alias("upto"), (F.col("bottom") - SLACK).alias("since"))
    texts = anchors.select("page_id", "a_top", "a_bottom", F.col("text").alias("before_text"), F.col("text").alias("after_text"))
    above = lookup.asof(asked, texts, ["page_id"], "upto", "a_bottom", ["before_text"], tie="a_top")
    met = lookup.asof(above, texts, ["page_id"], "since", "a_top", ["after_text"], before=False)
    return met.select("page_id", "item_id", F.coalesce("before_text", F.lit("")).alias("before_text"), F.coalesce("after_text", F.lit("")).alias("after_text"))


def title_origin() -> Column:
    """Why an element can be its page's title; null for others."""
    testid = F.coalesce(dom.attr("data-testid"), F.lit(""))
    return (
        F.when(testid.rlike("(?i)articletitle"), "explicit")
        .when(F.col("tag") == "h1", "h1")
        .when((dom.attr("role") == "heading") & (dom.attr("aria-level") == "1"), "heading")
        .when((F.col("tag") == "meta") & F.coalesce(dom.attr("property"), dom.attr("name"), F.lit("")).isin("og:title", "twitter:title"), "meta")
        .when(F.col("tag") == "title", "document")
    )


def title_score(origin: Column, raw: Column) -> Column:
    """How likely a text of an origin is the title."""
    base = F.lit(0)
    for name, score in TITLE_SCORES.items():
        base = F.when(origin == name, score).otherwise(base)
    return base - F.when(origin.isin("explicit", "h1", "heading") & raw.rlike(ENGAGEMENT), 1200).otherwise(0)


def title_candidates(nodes: DataFrame, root: DataFrame) -> DataFrame:
    """Titles of pages with scores: page_id, text, score, origin, pre. Headings in the body count least."""
    raw = T.normalize_text(F.when(F.col("tag") == "meta", dom.attr("content")).otherwise(F.col("text")))
    headings = nodes.where(F.col("tag").isin("h1", "h2", "h3") | (dom.attr("role") == "heading"))
    body = lookup.top_k(dom.inside(headings, root), ["page_id"], [F.col("pre")], 1).select("page_id", "pre", F.lit("body").alias("origin"), T.normalize_text(F.col("text")).alias("raw"))
    outside = nodes.join(dom.inside(nodes, root).select("page_id", "node_id"), ["page_id", "node_id"], "left_anti")
    found = outside.select("page_id", "pre", title_origin().alias("origin"), raw.alias("raw")).where("origin IS NOT NULL").unionByName(body)
    text = T.clean_title(F.col("raw"), F.lit(""), F.lit(""))
    return found.select("page_id", text.alias("text"), title_score(F.col("origin"), F.col("raw")).alias("score"), "origin", "pre").where(T.is_plausible_title(F.col("text")))


def detect_title(nodes: DataFrame, root: DataFrame) -> DataFrame:
    """The best title of each page: by score, then length, then place."""
    best = lookup.top_k(title_candidates(nodes, root), ["page_id"], [F.desc("score"), F.desc(F.length("text")), F.asc("pre")], 1)
    return best.select("page_id", F.col("text").alias("title"), "origin")


def cover_score(top: Column, title_bottom: Column, body_top: Column, width: Column, height: Column) -> Column:
    ratio = F.when((width > 0) & (height > 0), width / height).otherwise(1.0)
    return 2500 - F.greatest(F.lit(0), top - title_bottom) + F.when(ratio.between(1.25, 4.8), 500).otherwise(0) + F.when(width >= 480, 280).otherwise(0) + F.when(top <= body_top + 180, 220).otherwise(0)


def detect_cover(images: DataFrame, bodies: DataFrame) -> DataFrame:
    """The cover of each page among its images(page_id, src, width, height, top). bodies: page_id, body_top, first_media_top, title_bottom."""
    met = images.join(bodies, "page_id").where((F.col("top") >= F.col("title_bottom") - 100) & (F.col("top") <= F.col("body_top") + 900))
    met = met.where((F.col("top") < F.coalesce("first_media_top", F.lit(float("inf"))) + 2) | (F.col("top") < F.col("body_top")))
    scored = met.withColumn("score", cover_score(F.col("top"), F.col("title_bottom"), F.col("body_top"), F.col("width"), F.col("height")))
    return lookup.top_k(scored, ["page_id"], [F.desc("score"), F.asc("top"), F.asc("src")], 1).select("page_id", "src", "score")


def nearest_time(times: DataFrame, bodies: DataFrame) -> DataFrame:
    """The date nearest to the body's top, up to 180 below it. times: page_id, top, datetime; bodies: page_id, body_top."""
    met = times.join(bodies, "page_id").where(F.col("top") <= F.col("body_top") + 180)
    return met.groupBy("page_id").agg(F.min_by("datetime", F.struct(F.abs(F.col("body_top") - F.col("top")), F.col("top"))).alias("published"))


def link_cards(nodes: DataFrame) -> DataFrame:
    """Cards that link elsewhere: address, title, description and host, from the distinct texts inside them."""
    met = dom.owner_of(nodes, F.lower(F.coalesce(dom.attr("data-testid"), F.lit(""))).rlike(r"card\.?wrapper"), "card_id").where("card_id IS NOT NULL")
    href = F.min_by(F.when(F.col("tag") == "a", dom.attr("href")), F.when((F.col("tag") == "a") & dom.attr("href").isNotNull(), F.col("pre")))
    label = F.when(F.col("tag").isin("span", "p", "label"), T.normalize_text(F.col("text")))
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.length(label).between(2, 300), F.struct("pre", label.alias("text"))))), lambda x: x["text"])
    own = met.groupBy("page_id", "card_id").agg(href.alias("url"), F.array_distinct(texts).alias("texts"), F.min_by(F.when(F.col("tag") == "a", T.normalize_text(F.col("text"))), F.when(F.col("tag") == "a", F.col("pre"))).alias("anchor"))
    title = F.coalesce(F.get(F.filter("texts", lambda t: F.length(t) <= 160), F.lit(0)), F.nullif("anchor", F.lit("")), F.col("url"))
    out = own.where("url IS NOT NULL").withColumn("title", title)
    longer = F.get(F.filter("texts", lambda t: (t != F.col("title")) & (F.length(t) > F.length("title"))), F.lit(0))
    return out.select("page_id", "card_id", "url", "title", longer.alias("description"), U.hostname(F.col("url")).alias("hostname"))


def polls(nodes: DataFrame) -> DataFrame:
    """Polls with their distinct options in order."""
    boxes = dom.owner_of(nodes, F.coalesce(dom.attr("data-testid"), F.lit("")).rlike("(?i)poll"), "poll_id")
    option = (dom.attr("role") == "radio") | F.coalesce(dom.attr("data-testid"), F.lit("")).rlike("choice|option")
    met = boxes.where(F.coalesce(option, F.lit(False))).where("poll_id <> node_id AND text IS NOT NULL")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pre", T.normalize_text(F.col("text")).alias("text")))), lambda x: x["text"])
    return met.groupBy("page_id", "poll_id").agg(F.filter(F.array_distinct(texts), lambda t: t != "").alias("options"))


def named(text: str) -> tuple[Column, Column]:
    """The handle, without its sign, and the name that a text in a name block can be; null for other texts."""
    handle = F.regexp_extract(text, r"^@([A-Za-z0-9_]{1,15})$", 1)
    return F.when(handle != "", handle), F.when((handle == "") & ~F.col(text).rlike("(?i)^follow") & (F.col(text) != ""), F.col(text))


def author_of(url: Column, seen: Column, name: Column) -> tuple[Column, Column]:
    """Handle and name of a page's author: the handle seen, else the address's first step; the name seen, else the handle."""
    step = F.nullif(F.nullif(F.regexp_extract(U.path(url), "^/([A-Za-z0-9_]{1,15})(?:/|$)", 1), F.lit("")), F.lit("i"))
    handle = F.coalesce(seen, step)
    return handle, F.coalesce(name, F.concat(F.lit("@"), handle))


def authors_in(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Handle and name of each page: the first @handle in a name block, else the address's first step. pages: page_id, url."""
    blocks = dom.owner_of(nodes, F.coalesce(dom.attr("data-testid"), F.lit("")) == "User-Name", "block_id")
    met = blocks.where("block_id <> node_id AND text IS NOT NULL").withColumn("t", T.collapse(F.col("text")))
    first = met.groupBy("page_id").agg(*(F.min_by(c, F.when(c.isNotNull(), F.col("pre"))).alias(k) for k, c in zip(("seen", "name"), named("t"), strict=True)))
    handle, name = author_of(F.col("url"), F.col("seen"), F.col("name"))
    return pages.join(first, "page_id", "left").select("page_id", handle.alias("handle"), name.alias("name"))


def ordered(blocks: DataFrame, key: str = "doc_id", top: str = "top", seq: str = "seq") -> DataFrame:
    """Blocks numbered by their place on the page in steps of two pixels, then by sequence: a total order."""
    position = F.row_number().over(Window.partitionBy(key).orderBy(F.asc_nulls_last(F.round(F.col(top) / 2)), F.col(seq))) - 1
    return blocks.withColumn("block_idx", position)
