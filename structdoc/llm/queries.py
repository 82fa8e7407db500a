"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structdoc.llm.licenses import BASE, NOTICES, WORD, Template
from structdoc.plans.tables import table as _table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from structdoc.llm.warc import archive_pages

    return archive_pages(_table(spark, sf_dir, "pages"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from structdoc.llm.simhash import near_dedup

    return near_dedup(_table(spark, sf_dir, "documents"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from structdoc.llm.pieces import digest_pieces

    return digest_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from structdoc.llm.sharding import shard

    return shard(_table(spark, sf_dir, "documents"), n_shards=24)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from structdoc.llm.langid import identify

    return identify(_table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from structdoc.llm.exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from structdoc.llm.toxicity import score_toxicity

    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from structdoc.llm.decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from structdoc.llm.line_dedup import line_dedup

    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from structdoc.llm.substring_dedup import substring_dedup

    return substring_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from structdoc.llm.licenses import license_scan

    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("matches")


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from structdoc.llm.lexical import search

    return search(_table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from structdoc.llm.divergence import source_divergence

    return source_divergence(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_simhash, op3_pieces, op4_sharding, op5_langid, op6_exact_dedup, op7_toxicity, op8_decontaminate, op9_line_dedup, op10_substring_dedup, op11_licenses, op12_search, op13_divergence)}


def oracle_sql() -> dict[str, str]:
    return ORACLE_SQL | {"op11_licenses": _license_sql(BASE, NOTICES)}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: 32 letters of base32 from the 160 bits of a SHA-1, five at a time.
_BASE32 = """array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1)), '')"""

def _words_sql(phrase: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in phrase) + "]"


def _license_sql(base: tuple[Template, ...], notices: tuple[Template, ...], slack: int = 8, min_share: float = 0.5) -> str:
    """The places of all templates, one SELECT for each, and the digest of every document."""
    selects = []
    for k, t in enumerate((*base, *notices)):
        first, *others = t.phrases
        n, size = len(first), len(set(t.words))
        at = next(i for i in range(len(t.words)) if t.words[i : i + n] == first)
        keys = "".join(f" AND len(list_filter(range(len(around)), lambda j: around[j + 1 : j + {len(o)}] = {_words_sql(o)})) > 0" for o in others)
        low = f"greatest(0, start - {at + slack})"
        share = f"len(list_intersect({_words_sql(sorted(set(t.words)))}, around)) / {size}" if k >= len(base) else "1.0"
        selects.append(f"""SELECT row, '{t.label}' AS label, {k < len(base)} AS of_base, start, {share}::DOUBLE AS share FROM (
            SELECT row, start, ws[{low} + 1 : start - {at} + {len(t.words) + slack}] AS around FROM (
                SELECT row, ws, unnest(list_filter(range(len(ws)), lambda i: ws[i + 1 : i + {n}] = {_words_sql(first)})) AS start FROM w WHERE list_has_all(ws, {_words_sql(first)})))
            WHERE true{keys} AND {share} >= {min_share if k >= len(base) else 0}""")
    return f"""
        WITH w AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{WORD}') AS ws FROM documents),
        m AS ({" UNION ALL ".join(selects)}),
        g AS (SELECT row, count(*) FILTER (WHERE of_base) AS n_base, min(start) FILTER (WHERE of_base) AS first_word, max(start) FILTER (WHERE of_base) AS last_word,
                     string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE of_base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM m GROUP BY row)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
               coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
        FROM w LEFT JOIN g USING (row)
    """


ORACLE_SQL = {
    "op12_search": r"""
        WITH t AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents WHERE text IS NOT NULL),
        d AS (SELECT row, doc_id, ws, len(ws)::BIGINT AS n FROM t WHERE len(ws) > 0),
        c AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM d),
        f AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(ws) AS term FROM d) GROUP BY row, term),
        w AS (SELECT term, floor(1000 * ln((2 * (SELECT big_n FROM c) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f GROUP BY term),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
        s AS (SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::BIGINT AS score
              FROM q JOIN f USING (term) JOIN w USING (term) JOIN d USING (row), c GROUP BY item_id, row, doc_id),
        r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
    """.replace(r"\\", "\\"),
    "op13_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
        o AS (SELECT row, lang, source, unnest(ws) AS term FROM d),
        k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
        v AS (SELECT lang, count(*)::BIGINT AS v FROM k GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*)::BIGINT AS c FROM o JOIN k USING (lang, term) GROUP BY lang, source, term),
        n AS (SELECT lang, source, sum(c)::BIGINT AS n FROM c GROUP BY lang, source),
        p AS (SELECT lang, source, term, coalesce(c, 0) AS c, 1 + (1000000000 * (coalesce(c, 0) + 5)) // (coalesce(n, 0) + 5 * v) AS p
              FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source) LEFT JOIN c USING (lang, source, term)),
        q AS (SELECT lang, term, 1 + (1000000000 * (sum(c) + 5)) // (any_value(m) + 5 * any_value(v)) AS q FROM p JOIN v USING (lang) JOIN (SELECT lang, sum(n)::BIGINT AS m FROM n GROUP BY lang) USING (lang) GROUP BY lang, term),
        pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) s
                  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
        terms AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
        SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
        UNION ALL
        SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM terms) WHERE rank <= 50
    """,
    "op1_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_page FROM pages),
        b AS (SELECT page_id, first_page, octet_length(encode(body)) AS payload_bytes,
                     array_to_string(list_transform(string_split(sha1(body), ''), lambda c: lpad(bin(position(c IN '0123456789abcdef') - 1), 4, '0')), '') AS bits FROM p)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_page THEN first_page END AS refers_to FROM b
    """,
    "op10_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        e AS (SELECT doc_id, unnest(range(len(ws))) AS pos, unnest(ws) AS word FROM w),
        s AS (SELECT *, string_agg(word, ' ') OVER f AS win, count(*) OVER f AS n FROM e WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
        m AS (SELECT win, min(doc_id) AS first_doc FROM s WHERE n = 50 GROUP BY win),
        d AS (SELECT s.doc_id, s.pos, s.word, coalesce(m.first_doc < s.doc_id, false) AS seen FROM s LEFT JOIN m ON s.n = 50 AND s.win = m.win),
        c AS (SELECT doc_id, pos, word, max(seen::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) = 1 AS gone FROM d),
        g AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY doc_id)
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN g USING (doc_id)
    """,
    "op6_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS norm FROM documents),
        g AS (SELECT doc_id, norm, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
    """,
    "op9_line_dedup": f"""
        WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        e AS (SELECT doc_id, unnest(range(len(lines))) AS pos, unnest(lines) AS line FROM s),
        k AS (SELECT doc_id, pos, line, {_LOWER.format(r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} AS key FROM e),
        d AS (SELECT key, min(doc_id) AS first_doc, count(DISTINCT doc_id) AS n_docs FROM k WHERE length(key) >= 10 GROUP BY key),
        f AS (SELECT k.doc_id, k.pos, k.line, coalesce(d.n_docs >= 2 AND k.doc_id > d.first_doc, false) AS dropped FROM k LEFT JOIN d ON k.key = d.key)
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM f GROUP BY doc_id
    """,
}
