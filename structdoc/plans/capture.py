"""Queries over captures made of the tables events and pages, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from structdoc.operators import inventory, merge
from structdoc.plans import pages
from structdoc.plans.sql import ORACLES as PAGE_SQL
from structdoc.plans.sql import canonical, normalize, tight
from structdoc.plans.tables import table
from structdoc.sources.html import html_nodes
from structdoc.streaming import rolling
from structdoc.streaming.capture import correlate_all


def observations(events: DataFrame) -> DataFrame:
    """Each event as an observation of its user's page: views and signups of media, clicks and errors of code, purchases of formulas."""
    kind = F.when(F.col("event_type").isin("view", "signup"), "media").when(F.col("event_type").isin("click", "error"), "code").when(F.col("event_type") == "purchase", "formula")
    return events.select(
        F.col("user_id").alias("page"),
        kind.alias("kind"),
        F.pmod("event_id", F.lit(3)).alias("key"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("at"),
        F.floor(F.col("value") / 10).cast("double").alias("area"),
        (F.col("event_type") == "signup").alias("anchored"),
        (F.get_json_object("props", "$.k").cast("long") > 50).alias("referenced"),
        F.col("event_type").alias("text"),
        F.col("value").alias("top"),
    )


def rolling_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a rolling capture of each user's page holds when two passes of six hours changed nothing."""
    return rolling.captured_items(observations(table(spark, sf_dir, "events")), every="6 hours", stable=2)


def merged_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks, captured, anchors) of pages: the places of some of a page's blocks are known, one kind of them wrongly, and three items are captured of every page."""
    blocks = pages.page_dom_blocks(spark, sf_dir).select(F.col("page_id").alias("doc_id"), "block_idx", "type", F.lit(None).cast("string").alias("html"), "text", F.lit(None).cast("string").alias("latex"), F.lit(None).cast("string").alias("mathml"), F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("source_url"))
    i, at = F.col("doc_id"), F.col("block_idx")
    anchors = blocks.where((at % 3 == 1) | (at % 11 == 6)).select("doc_id", "text", F.when(at % 11 == 6, at * 100 - 350).otherwise(at * 100 + i % 50).alias("top"))
    items = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("seq"))
    kind = F.element_at(F.array(F.lit("image"), F.lit("code"), F.lit("formula")), F.col("seq") + 1)
    only = lambda k, value: F.when(F.col("seq") == k, value)
    captured = items.select(
        "doc_id", kind.alias("type"), F.lit(None).cast("string").alias("html"), only(1, F.concat(F.lit("x = "), i)).alias("text"), only(2, F.concat(F.lit("a_"), i)).alias("latex"), F.lit(None).cast("string").alias("mathml"),
        only(0, F.concat(F.lit("https://pbs.twimg.com/media/I"), i, F.lit(".jpg"))).alias("src"), F.lit(None).cast("string").alias("source_url"), F.when((i % 13 != 0) | (F.col("seq") != 1), (i * 37 + F.col("seq") * 411) % 1500).alias("top"), "seq",
    )
    return blocks, captured, anchors


def page_merged_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of pages with captured media, code and formulas at their places."""
    merged = merge.merge_captured(*merged_inputs(spark, sf_dir))
    return merged.select(F.col("doc_id").alias("page_id"), F.col("block_idx").cast("long").alias("block_idx"), "type", F.coalesce("text", "latex", "src").alias("content"), "captured")


def request_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each view with the user's purchases within an hour after it, and the views and purchases that met none, by the operator that streams of requests use too."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    views = events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("received_at"))
    bought = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("finished_at"))
    return correlate_all(views, bought, "user_id", "1 hour").select("user_id", "view_id", "purchase_id", "outcome")


IMAGES = (
    '<p><img src="https://a.example/<id>/<k>/<chars>.jpg"></p>',
    '<img src="https://a.example/small.jpg" srcset="x1.jpg 1x, https://a.example/<id>/<k>-<chars>.jpg 2x , ">',
    '<picture><source media="m"><source srcset="https://a.example/p/<id>/<k>.jpg 400w"><source srcset="other.jpg"><img src="data:x" alt="<chars>"></picture>',
    '<img src="data:image/gif;base64,x"><img src="blob:y" srcset="data:z 1x">',
)


def image_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addresses of the images of pages that have one for each line of a document, written in four ways."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))

    def image(line, k):
        form = F.element_at(F.array(*map(F.lit, IMAGES)), (k % 4 + 1).cast("int"))
        return F.replace(F.replace(F.replace(form, F.lit("<id>"), F.col("page_id").cast("string")), F.lit("<k>"), k.cast("string")), F.lit("<chars>"), F.length(line).cast("string"))

    nodes = html_nodes(lines.select("page_id", F.array_join(F.transform("lines", image), "").alias("html")))
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("pre")) - 1
    return inventory.image_addresses(nodes).select("page_id", number.cast("long").alias("n"), "src", "alt")


QUERIES = {f.__name__: f for f in (rolling_items, page_merged_blocks, request_outcomes, image_sources)}

ORACLES = {
    "rolling_items": """
        WITH RECURSIVE o AS (
            SELECT user_id::VARCHAR AS page, CASE WHEN event_type IN ('view', 'signup') THEN 'media' WHEN event_type IN ('click', 'error') THEN 'code' WHEN event_type = 'purchase' THEN 'formula' END AS kind,
                   (event_id % 3)::VARCHAR AS key, event_id AS seq, epoch_us(ts) // 21600000000 AS round, floor(value / 10)::DOUBLE AS area, event_type = 'signup' AS anchored,
                   (props::JSON->>'k')::BIGINT > 50 AS referenced, event_type AS text, value AS top FROM events),
        n AS (SELECT *, row_number() OVER (PARTITION BY page, kind, key ORDER BY round, seq) AS i FROM o WHERE kind IS NOT NULL),
        s AS (
            SELECT n.*, true AS changed, area AS held_area, anchored AS held_anchored, referenced AS held_referenced, text AS held_text FROM n WHERE i = 1
            UNION ALL
            SELECT x.*, r, CASE WHEN r THEN x.area ELSE held_area END, CASE WHEN r THEN x.anchored ELSE held_anchored END, CASE WHEN r THEN x.referenced ELSE held_referenced END, CASE WHEN r THEN x.text ELSE held_text END
            FROM (SELECT n AS x, held_area, held_anchored, held_referenced, held_text,
                         CASE n.kind WHEN 'media' THEN n.area > held_area OR (n.anchored AND NOT held_anchored) WHEN 'code' THEN n.text <> held_text ELSE n.referenced AND NOT held_referenced END AS r
                  FROM s JOIN n ON n.page = s.page AND n.kind = s.kind AND n.key = s.key AND n.i = s.i + 1)),
        c AS (SELECT * FROM s WHERE changed),
        p AS (SELECT page, round, lead(round) OVER (PARTITION BY page ORDER BY round) AS following FROM (SELECT DISTINCT page, round FROM c)),
        t AS (SELECT page, min(round) + 2 AS stopped_round FROM p WHERE following IS NULL OR following > round + 2 GROUP BY page),
        b AS (SELECT c.*, stopped_round FROM c JOIN t USING (page) WHERE round <= stopped_round QUALIFY row_number() OVER (PARTITION BY page, kind, key ORDER BY i DESC) = 1)
        SELECT page, kind, key, row_number() OVER (PARTITION BY page, kind ORDER BY top, seq, key)::INTEGER AS place, seq, round::BIGINT AS round, area, anchored, referenced, text, top, stopped_round::BIGINT AS stopped_round FROM b
    """,
    "page_merged_blocks": f"""
        WITH b AS (SELECT page_id AS i, block_idx AS ix, type, text, {canonical(tight("text"))} AS key, nullif({canonical("substr(" + normalize(tight("text")) + ", 1, 240)")}, '') AS anchor FROM ({PAGE_SQL["page_blocks_native"]})),
        f AS (SELECT i, anchor, min(ix) AS ix FROM b WHERE anchor IS NOT NULL GROUP BY ALL),
        a AS (SELECT i, anchor, min(CASE WHEN ix % 11 = 6 THEN ix * 100 - 350 ELSE ix * 100 + i % 50 END)::DOUBLE AS top FROM b WHERE ix % 3 = 1 OR ix % 11 = 6 GROUP BY ALL),
        m AS (SELECT i, ix, top, min(top) OVER (PARTITION BY i ORDER BY ix DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM f JOIN a USING (i, anchor)),
        t AS (SELECT i, ix, top FROM m WHERE least IS NULL OR top <= least),
        c AS (SELECT page_id AS i, seq, ['image', 'code', 'formula'][seq + 1] AS type, CASE seq WHEN 0 THEN 'https://pbs.twimg.com/media/I' || page_id || '.jpg' WHEN 1 THEN 'x = ' || page_id ELSE 'a_' || page_id END AS text,
                     CASE WHEN page_id % 13 <> 0 OR seq <> 1 THEN (page_id * 37 + seq * 411) % 1500 END::DOUBLE AS top FROM pages, (SELECT unnest([0, 1, 2]) AS seq)),
        p AS (SELECT c.*, (SELECT max(ix) FROM t WHERE t.i = c.i AND t.top <= c.top AND t.top = (SELECT max(top) FROM t WHERE t.i = c.i AND t.top <= c.top)) AS ix0, (SELECT max(top) FROM t WHERE t.i = c.i AND t.top <= c.top) AS t0,
                     (SELECT min(ix) FROM t WHERE t.i = c.i AND t.top = (SELECT min(top) FROM t WHERE t.i = c.i AND t.top >= c.top)) AS ix1, (SELECT min(top) FROM t WHERE t.i = c.i AND t.top >= c.top) AS t1 FROM c),
        r AS (SELECT i, type, text, key, false AS captured, ix::DOUBLE AS position, NULL AS top, NULL AS seq FROM b
              UNION ALL SELECT i, type, text, NULL, true, CASE WHEN ix0 IS NOT NULL AND ix1 IS NOT NULL THEN ix0 + coalesce((ix1 - ix0) * ((top - t0) / nullif(t1 - t0, 0)), 0.5) WHEN ix0 IS NOT NULL THEN ix0 + 0.5 WHEN ix1 IS NOT NULL THEN ix1 - 0.5 END, top, seq FROM p),
        n AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY position NULLS LAST, captured, top NULLS FIRST, seq) AS n FROM r),
        k AS (SELECT * FROM n WHERE captured OR key <> '' QUALIFY captured OR row_number() OVER (PARTITION BY i, key, captured ORDER BY n) = 1)
        SELECT i AS page_id, row_number() OVER (PARTITION BY i ORDER BY n) - 1 AS block_idx, type, text AS content, captured FROM k
    """,
    "request_outcomes": """
        SELECT coalesce(v.user_id, p.user_id) AS user_id, v.event_id AS view_id, p.event_id AS purchase_id, CASE WHEN v.event_id IS NULL THEN 'no_response' WHEN p.event_id IS NULL THEN 'no_end' ELSE 'met' END AS outcome
        FROM (SELECT * FROM events WHERE event_type = 'view') v FULL OUTER JOIN (SELECT * FROM events WHERE event_type = 'purchase') p
          ON v.user_id = p.user_id AND epoch_us(p.ts) BETWEEN epoch_us(v.ts) AND epoch_us(v.ts) + 3600000000
    """,
    "image_sources": """
        WITH l AS (SELECT doc_id AS i, unnest(range(len(l))) AS k, length(unnest(l)) AS chars FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
        m AS (SELECT i, k, 0 AS part, CASE k % 4 WHEN 0 THEN 'https://a.example/' || i || '/' || k || '/' || chars || '.jpg' WHEN 1 THEN 'https://a.example/' || i || '/' || k || '-' || chars || '.jpg' WHEN 2 THEN 'https://a.example/p/' || i || '/' || k || '.jpg' END AS src,
                     CASE WHEN k % 4 = 2 THEN chars::VARCHAR END AS alt FROM l
              UNION ALL SELECT i, k, 1, NULL, NULL FROM l WHERE k % 4 = 3)
        SELECT i AS page_id, row_number() OVER (PARTITION BY i ORDER BY k, part) - 1 AS n, src, alt FROM m
    """,
}
