"""Blocks of a page and what was captured of it while it was scrolled, in one order.

Blocks of a page have an order in the document, captured items a place on the screen. What is known in both, blocks that show an anchor's text or are
captured themselves, ties the two orders together; other items get a number between the blocks that these are by their distances. Null
texts, tops and keys tie nothing; a document without ties has its captured items behind its blocks, by their tops. Repeated anchors count once;
of blocks of one text the first is meant. Empty tables add nothing. Columns that start with an underscore are used inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structdoc.functions import text as T
from structdoc.operators import blocks as B
from structdoc.operators import lookup

#: Letters of a text that an anchor holds.
ANCHOR_CHARS = 240


def anchor_key(text: Column) -> Column:
    """What an anchor's text and a block's have in common; null for empty ones."""
    return F.nullif(T.canonical_text(F.substring(T.normalize_text(T.strip_tags_tight(text)), 1, ANCHOR_CHARS)), F.lit(""))


def ties(blocks: DataFrame, captured: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc_id, block_idx, top): blocks whose place on the screen is known. One that a later block stands above is left out, so that both orders agree."""
    kinds = {f.name: f.dataType for f in blocks.schema}
    keyed = blocks.withColumn("_key", B.block_key(kinds.get("items"), "paragraphs" in kinds))
    shown = keyed.where(F.col("type").isin("paragraph", "heading", "blockquote", "list")).select("doc_id", "block_idx", anchor_key(F.coalesce("html", "text")).alias("_key"))
    others = keyed.where(F.col("type").isin("code", "formula", "image", "media")).select("doc_id", "block_idx", "_key")
    places = anchors.select("doc_id", anchor_key(F.col("text")).alias("_key"), "top").unionByName(captured.select("doc_id", B.block_key().alias("_key"), "top"))
    first = shown.unionByName(others).where("_key is not null").groupBy("doc_id", "_key").agg(F.min("block_idx").alias("block_idx"))
    met = first.join(places.where("_key is not null and top is not null").groupBy("doc_id", "_key").agg(F.min("top").alias("top")), ["doc_id", "_key"])
    met = met.groupBy("doc_id", "block_idx").agg(F.min("top").alias("top"))
    following = Window.partitionBy("doc_id").orderBy(F.desc("block_idx")).rowsBetween(Window.unboundedPreceding, -1)
    return met.withColumn("_least", F.min("top").over(following)).where("_least is null or top <= _least").drop("_least")


def placed(captured: DataFrame, tied: DataFrame) -> DataFrame:
    """captured with a position among the numbers of blocks, null where a document has no ties."""
    marks = tied.select("doc_id", F.col("block_idx").alias("_idx"), F.col("top").alias("_t"), "top")
    columns = captured.columns
    above = lookup.asof(captured, marks.select("doc_id", F.col("_idx").alias("_idx0"), F.col("_t").alias("_t0"), "top", (-F.col("_idx")).alias("_later")), ["doc_id"], "top", "top", ["_idx0", "_t0"], tie="_later")
    both = lookup.asof(above, marks.select("doc_id", F.col("_idx").alias("_idx1"), F.col("_t").alias("_t1"), "top"), ["doc_id"], "top", "top", ["_idx1", "_t1"], before=False, tie="_idx1")
    share = (F.col("top") - F.col("_t0")) / F.nullif(F.col("_t1") - F.col("_t0"), F.lit(0.0))
    between = F.col("_idx0") + F.coalesce((F.col("_idx1") - F.col("_idx0")) * share, F.lit(0.5))
    position = F.when(F.col("top").isNull(), None).when(F.col("_idx0").isNotNull() & F.col("_idx1").isNotNull(), between)
    position = position.when(F.col("_idx0").isNotNull(), F.col("_idx0") + 0.5).when(F.col("_idx1").isNotNull(), F.col("_idx1") - 0.5)
    return both.select(*columns, position.alias("position"))


def merge_captured(blocks: DataFrame, captured: DataFrame, anchors: DataFrame) -> DataFrame:
    """blocks(doc_id, block_idx, type, ...) with the rows of captured(doc_id, type, html, text, latex, mathml, src, source_url, top, seq) among them, without copies, numbered anew, and captured (boolean).

    anchors(doc_id, text, top): texts seen on the screen.
    """
    captured = captured.withColumn("top", F.col("top").cast("double"))
    anchors = anchors.withColumn("top", F.col("top").cast("double"))
    items = placed(captured, ties(blocks, captured, anchors))
    own = blocks.withColumn("position", F.col("block_idx").cast("double")).withColumn("captured", F.lit(False))
    rows = own.unionByName(items.withColumn("captured", F.lit(True)).withColumnRenamed("top", "_top").withColumnRenamed("seq", "_seq"), allowMissingColumns=True)
    order = Window.partitionBy("doc_id").orderBy(F.asc_nulls_last("position"), "captured", "_top", "_seq")
    numbered = rows.withColumn("block_idx", F.row_number().over(order) - 1).drop("position", "_top", "_seq")
    kept = B.drop_copies(numbered)
    return kept.withColumn("block_idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("block_idx")) - 1).select(*blocks.columns, "captured")
