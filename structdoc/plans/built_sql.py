"""DuckDB SQL for the queries of ``built``: what is known of each row by the way captures and pages are made."""

from __future__ import annotations

from structdoc.plans.sql import canonical, lit, q, strip

_FIVE = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def esc(c: str) -> str:
    return lit(c, *_FIVE)


def esc3(c: str) -> str:
    return lit(c, *_FIVE[:3])


def styled(c: str, escape) -> str:
    """A line under the styles of captures: bold over the first three letters, italic over three from the third on; every seventh line, from the sixth, has a link over four from the fourth on, too."""
    segment = lambda a, n, pre, post: f"CASE WHEN length({c}) > {a} THEN '{pre}' || {escape(f'substr({c}, {a + 1}, {n})')} || '{post}' ELSE '' END"
    bold, both, em = ("<strong>", "</strong>"), ("<em><strong>", "</strong></em>"), ("<em>", "</em>")
    a = f"""<a href="https://www.site.example/a?d=' || i || '">"""
    plain = " || ".join([segment(0, 2, *bold), segment(2, 1, *both), segment(3, 2, *em), segment(5, 10**9, "", "")])
    linked = " || ".join([segment(0, 2, *bold), segment(2, 1, *both), segment(3, 2, a + em[0], em[1] + "</a>"), segment(5, 2, a, "</a>"), segment(7, 10**9, "", "")])
    return f"CASE pos % 7 WHEN 2 THEN {plain} WHEN 6 THEN {linked} ELSE {escape(c)} END"


DOCS = "SELECT doc_id AS i, coalesce(lang, 'xx') AS lang, coalesce(source, 's') AS source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents"
#: The lines of documents with their places and the kinds of block that these give.
LINES = f"""SELECT i, lang, source, len(lines) AS n, unnest(range(len(lines))) AS pos, unnest(lines) AS line FROM ({DOCS})"""
KIND = "CASE WHEN pos = 0 THEN 'heading' WHEN pos % 7 = 3 THEN 'blockquote' WHEN pos % 7 IN (4, 5) THEN 'list' ELSE 'paragraph' END"
ROOT = "data.tweetResult.result"
RESULT = f"{ROOT}.article.article_results.result"

#: Blocks of articles in order: those of lines, a list for each run of items, then those of the four entities and the tail.
BLOCKS = f"""
    WITH l AS (SELECT *, {KIND} AS kind FROM ({LINES}) WHERE i % 11 <> 0),
    items AS (SELECT i, pos - (CASE WHEN pos % 7 = 5 THEN 1 ELSE 0 END) AS pos, string_agg({esc('line')}, '|' ORDER BY pos) AS content FROM l WHERE kind = 'list' GROUP BY ALL),
    parts AS (
        SELECT i, pos, kind AS type, CASE WHEN kind = 'heading' THEN 2 END AS level, {styled('line', esc)} AS content, NULL AS src, NULL AS url, NULL AS resolution_source FROM l WHERE kind <> 'list' AND {strip('line')} <> ''
        UNION ALL SELECT i, pos, 'list', NULL, content, NULL, NULL, NULL FROM items
        UNION ALL SELECT i, len(lines), 'image', NULL, NULL, 'https://pbs.twimg.com/media/D' || i || '.jpg?format=jpg&name=orig', NULL, NULL FROM ({DOCS}) WHERE i % 11 <> 0
        UNION ALL SELECT i, len(lines) + 1, 'formula', NULL, 'x_' || (i % 10) || ' = ' || lang, NULL, NULL, 'entity-direct' FROM ({DOCS}) WHERE i % 11 <> 0
        UNION ALL SELECT i, len(lines) + 2, 'embedded_post', NULL, CASE WHEN i % 2 = 0 THEN 'Quoted &lt;post&gt; &amp; ' || i ELSE '' END, NULL,
                         'https://x.com/' || (CASE WHEN i % 2 = 0 THEN 'c' || (i % 5) ELSE 'i' END) || '/status/p' || i, NULL FROM ({DOCS}) WHERE i % 11 <> 0
        UNION ALL SELECT i, len(lines) + 3, 'link_card', NULL, NULL, NULL, 'https://www.site.example/a?d=' || i, NULL FROM ({DOCS}) WHERE i % 11 <> 0
        UNION ALL SELECT i, len(lines) + 4, 'paragraph', NULL, 'The following code:', NULL, NULL, NULL FROM ({DOCS}) WHERE i % 11 <> 0 AND i % 5 = 0
    ),
    b AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY pos) - 1 AS block_idx FROM parts)"""

#: Markup of each block of an article as it is rendered.
_PART = f"""CASE type WHEN 'heading' THEN '<h2>' || {esc3('raw')} || '</h2>' WHEN 'paragraph' THEN '<p>' || coalesce(marked, {esc3('raw')}) || '</p>' WHEN 'blockquote' THEN '<blockquote><p>' || content || '</p></blockquote>'
    WHEN 'list' THEN listed WHEN 'image' THEN '<figure><img src="' || replace(src, '&', '&amp;') || '" alt=""></figure>' WHEN 'formula' THEN '<figure><code>' || {esc('content')} || '</code></figure>'
    WHEN 'embedded_post' THEN '<aside><div>' || (CASE WHEN i % 2 = 0 THEN 'C D  @c' || (i % 5) ELSE '' END) || '</div>' || coalesce(content, '') || '<a href="' || url || '">post</a></aside>'
    WHEN 'link_card' THEN '<a href="' || url || '"><strong>Site</strong><small>site.example</small></a>' END"""

LETTERS = "coalesce(nullif(trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^A-Za-z ]', '', 'g'), ' +', ' ', 'g')), ''), 'empty')"
PAGES = f"SELECT doc_id AS i, {LETTERS} AS c, 'text ' || doc_id || ' in ' || coalesce(lang, 'xx') AS name FROM documents"
WORDS = "coalesce(nullif(trim(regexp_replace(regexp_replace(line, '[^A-Za-z ]', '', 'g'), ' +', ' ', 'g')), ''), 'x')"
BOXES = "SELECT l_orderkey AS page_id, l_linenumber::BIGINT AS item_id, ((l_partkey * 7 + l_suppkey * 3) % 2000 * 8 + l_linenumber)::BIGINT AS top, l_suppkey FROM lineitem"


def _values(*rows: tuple) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int | float) else q(v) for v in r) + ")" for r in rows)


ORACLES = {
    "payload_walk": f"""
        WITH d AS (SELECT *, CASE WHEN i % 2 = 0 THEN '{RESULT}.content_state.<json-string>' ELSE '{RESULT}.content_state' END AS s FROM ({DOCS})),
        p AS (
            SELECT i, unnest(['', 'data', 'data.tweetResult', '{ROOT}', '{ROOT}.core', '{ROOT}.core.user_results', '{ROOT}.core.user_results.result', '{ROOT}.core.user_results.result.legacy', '{ROOT}.article', '{ROOT}.article.article_results',
                '{RESULT}', '{RESULT}.cover_media', '{RESULT}.media_entities.0', '{RESULT}.media_entities.0.original_info', '{RESULT}.formula_store', '{RESULT}.formula_store.stored-' || i]) AS path, false AS in_string FROM d
            UNION ALL SELECT i, unnest(['data.post', 'data.post.core', 'data.post.core.user_results', 'data.post.core.user_results.result', 'data.post.core.user_results.result.legacy']), false FROM d WHERE i % 2 = 0
            UNION ALL SELECT i, s || unnest(['', '.entityMap', '.entityMap.0', '.entityMap.0.data', '.entityMap.0.data.media_items.0', '.entityMap.1', '.entityMap.1.data', '.entityMap.1.data.content', '.entityMap.1.data.content.value', '.entityMap.1.data.content.value.data', '.entityMap.2', '.entityMap.2.data', '.entityMap.3', '.entityMap.3.data']), i % 2 = 0 FROM d
            UNION ALL SELECT i, s || '.blocks.' || unnest(range(len(lines) + 4 + (CASE WHEN i % 5 = 0 THEN 1 ELSE 0 END))), i % 2 = 0 FROM d
            UNION ALL SELECT i, s || '.blocks.' || (len(lines) + unnest(range(4))) || '.entity_ranges.0', i % 2 = 0 FROM d
            UNION ALL SELECT i, s || '.blocks.' || pos || '.inline_style_ranges.' || unnest([0, 1, 2]), i % 2 = 0 FROM (SELECT *, unnest(range(len(lines))) AS pos FROM d) WHERE pos % 7 IN (2, 6)
            UNION ALL SELECT i, s || '.blocks.' || pos || '.entity_ranges.0', i % 2 = 0 FROM (SELECT *, unnest(range(len(lines))) AS pos FROM d) WHERE pos % 7 = 6
        )
        SELECT i AS capture_id, path, (CASE WHEN path = '' THEN 0 ELSE len(string_split(path, '.')) END)::INTEGER AS depth, in_string FROM p""",
    "payload_json_strings": f"SELECT i AS capture_id, '{RESULT}.content_state' AS path FROM ({DOCS}) WHERE i % 2 = 0",
    "article_candidates": f"SELECT i AS capture_id, '{RESULT}' AS path, 'Title of ' || i || ' in ' || lang AS title, 248 AS score FROM ({DOCS}) WHERE i % 11 <> 0",
    "media_index": f"""
        SELECT i AS capture_id, unnest(['m' || i, 'https://pbs.twimg.com/media/D' || i || '.jpg?format=jpg']) AS ref_key, 'https://pbs.twimg.com/media/D' || i || '.jpg?format=jpg&name=orig' AS url,
               800 AS width, 600 AS height, 'photo' AS type FROM ({DOCS})""",
    "formula_index": f"SELECT i AS capture_id, 'stored-' || i AS ref_key, 'a_1 \\sim  b' || (i % 3) AS latex, 0 AS ordinal FROM ({DOCS})",
    "post_index": f"""
        SELECT i AS capture_id, 'p' || i AS post_id, 'Quoted <post> & ' || i AS text, 'C D' AS author_name, 'c' || (i % 5) AS author_handle, 'Thu Oct 11 08:00:00 +0000 2018' AS created_at FROM ({DOCS}) WHERE i % 2 = 0""",
    "articles": f"""
        SELECT i AS doc_id, i % 11 <> 0 AS ok, CASE WHEN i % 11 <> 0 THEN 'Title of ' || i || ' in ' || lang END AS title, 'Name ' || source AS author_name, 'u' || (i % 97) AS author_handle,
               'Wed Oct 10 20:19:24 +0000 2018' AS published, 1539202764000000 AS published_at, lang, CASE WHEN i % 11 <> 0 THEN 'https://pbs.twimg.com/media/D' || i || '.jpg?format=jpg&name=orig' END AS cover_image,
               'https://x.com/u' || (i % 97) || '/article/' || i AS url, CASE WHEN i % 11 <> 0 THEN 248 END AS score FROM ({DOCS})""",
    "article_blocks": f"{BLOCKS} SELECT i AS doc_id, block_idx, type, level, md5(content) AS content_md5, src, url, resolution_source FROM b",
    "draft_lists": f"""{BLOCKS},
        x AS (SELECT l.*, l.pos - (CASE WHEN l.pos % 7 = 5 THEN 1 ELSE 0 END) AS first FROM l WHERE kind = 'list')
        SELECT x.i AS doc_id, b.block_idx, (x.pos - x.first)::INTEGER AS item_id, CASE WHEN x.pos > x.first THEN 0 END AS parent_item_id, (x.pos - x.first)::INTEGER AS depth, true AS ordered, md5({esc('x.line')}) AS html_md5
        FROM x JOIN b ON x.i = b.i AND x.first = b.pos""",
    "completeness": f"""{BLOCKS}
        SELECT i AS doc_id, count(*) AS blocks, count(*) FILTER (WHERE type = 'code') AS codes, count(*) FILTER (WHERE type = 'image') AS images, count(*) FILTER (WHERE type = 'formula') AS formulas,
               count(*) FILTER (WHERE type = 'table') AS tables, count(*) FILTER (WHERE type = 'list') AS lists, (i % 5 = 0)::BIGINT AS gaps, 0::BIGINT AS unresolved, CASE WHEN i % 5 = 0 THEN 'warning' ELSE 'ok' END AS status
        FROM b GROUP BY i""",
    "render_html": f"""{BLOCKS},
        r AS (SELECT i, pos - (CASE WHEN pos % 7 = 5 THEN 1 ELSE 0 END) AS pos, '<ol><li>' || {esc3('min_by(line, pos)')} || coalesce('<ol><li>' || {esc3('max(line) FILTER (WHERE pos % 7 = 5)')} || '</li></ol>', '') || '</li></ol>' AS listed FROM l WHERE kind = 'list' GROUP BY ALL),
        t AS (SELECT b.*, coalesce(l.line, b.content) AS raw, l.marked, r.listed FROM b LEFT JOIN (SELECT i, pos, line, {styled('line', esc3)} AS marked FROM l) l ON b.i = l.i AND b.pos = l.pos LEFT JOIN r ON b.i = r.i AND b.pos = r.pos),
        h AS (SELECT i, string_agg({_PART}, chr(10) ORDER BY pos) AS body FROM t GROUP BY i)
        SELECT d.i AS doc_id, 'Title of ' || d.i || ' in ' || lang AS filename,
               md5('<h1>Title of ' || d.i || ' in ' || lang || '</h1>' || chr(10) || '<p>Name ' || {esc('source')} || ' @u' || (d.i % 97) || ' October 10, 2018</p>' || chr(10) || h.body || chr(10) || '<a href="https://x.com/u' || (d.i % 97) || '/article/' || d.i || '">source</a>') AS html_md5
        FROM ({DOCS}) d JOIN h ON d.i = h.i""",
    "page_documents": f"""
        SELECT i AS doc_id, 'article' AS type, 'Page of ' || name AS title, 'https://x.com/user' || (i % 7) || '/article/' || i AS url, 'user' || (i % 7) AS author_handle, 'Name N' || (i % 7) AS author_name,
               '2024-01-0' || (1 + i % 9) AS published, 'https://pbs.twimg.com/media/C' || i || '.jpg' AS cover_image, 13::BIGINT AS blocks FROM ({PAGES})""",
    "page_linked_articles": f"SELECT i AS page_id, 'https://x.com/u/article/' || i AS url, 'Linked ' || name AS title_hint FROM ({PAGES})",
    "page_post_roots": "SELECT doc_id AS page_id, true AS found FROM documents",
    "page_embedded_posts": f"SELECT i AS page_id, 'emb' || (i % 5) AS author_handle, '2023-05-05' AS published, 'embedded ' || i AS text, 'https://x.com/e/status/' || i AS url, 'i1,i2,i3,i4' AS images FROM ({PAGES})",
    "page_media": f"SELECT i AS page_id, 'https://pbs.twimg.com/media/V' || i || '.jpg' AS poster, 'video' AS kind, NULL::VARCHAR AS url FROM ({PAGES})",
    "page_cards": f"SELECT i AS page_id, 'https://www.card.example/' || i AS url, 'Card title ' || i AS title, 'A longer description of card ' || i AS description, 'card.example' AS hostname FROM ({PAGES})",
    "page_polls": f"SELECT i AS page_id, 'yes|no ' || i AS options FROM ({PAGES})",
    "page_authors": f"SELECT i AS page_id, 'user' || (i % 7) AS handle, 'Name N' || (i % 7) AS name FROM ({PAGES})",
    "page_titles": f"SELECT i AS page_id, 'Page of ' || name AS title, 'document' AS origin FROM ({PAGES})",
    "page_tables": f"""
        SELECT i AS page_id, v.* FROM ({PAGES}), LATERAL (VALUES (0, 0, true, 'a', NULL::INTEGER), (0, 1, true, 'b', 2), (1, 0, false, '1', NULL), (1, 1, false, 't' || i, NULL)) v("row", "column", header, html, colspan)""",
    "block_copies": f"""
        WITH k AS (SELECT i, pos, CASE pos % 4 WHEN 1 THEN 'list' WHEN 3 THEN 'separator' ELSE 'paragraph' END AS type, line FROM ({LINES})),
        c AS (SELECT i, pos, type, CASE type WHEN 'separator' THEN NULL WHEN 'list' THEN 'list:' || {canonical('line')} ELSE 'text:' || {canonical('line')} END AS key FROM k),
        f AS (SELECT *, row_number() OVER (PARTITION BY i, key ORDER BY pos) AS nth FROM c WHERE key IS NULL OR NOT regexp_matches(key, '^(list|text):$')),
        s AS (SELECT i, pos, type, lag(type) OVER (PARTITION BY i ORDER BY pos) AS before FROM f WHERE key IS NULL OR nth = 1)
        SELECT i AS doc_id, pos AS block_idx, type FROM s WHERE NOT (type = 'separator' AND before IS NOT DISTINCT FROM 'separator')""",
    "block_code_runs": f"""
        WITH k AS (SELECT i, pos, line, pos // 5 AS five, CASE WHEN pos % 5 < 3 THEN 'py' WHEN pos % 5 = 3 THEN 'js' END AS lang FROM ({LINES}))
        SELECT i AS doc_id, min(pos) AS block_idx, CASE WHEN lang IS NULL THEN 'paragraph' ELSE 'code' END AS type, lang AS language, CASE WHEN lang IS NOT NULL THEN md5(string_agg(line, chr(10) ORDER BY pos)) END AS text_md5,
               CASE WHEN lang IS NOT NULL THEN count(*)::INTEGER END AS line_count FROM k GROUP BY i, five, lang""",
    "block_pseudo_lists": f"""
        WITH k AS (SELECT i, pos, pos // 6 AS six, pos % 6 // 2 AS part FROM ({LINES}) WHERE pos % 6 < 4)
        SELECT i AS doc_id, min(pos) AS block_idx, part = 0 AS ordered, string_agg((CASE WHEN part = 0 THEN 'x' ELSE 'y' END) || pos, '|' ORDER BY pos) AS items FROM k GROUP BY i, six, part HAVING count(*) >= 2""",
    "markdown_blocks": f"""
        SELECT i AS doc_id, pos AS block_idx, ['heading', 'blockquote', 'list', 'paragraph', 'code', 'table'][pos % 6 + 1] AS type, CASE WHEN pos % 6 = 0 THEN 3 END AS level,
               CASE pos % 6 WHEN 3 THEN '<strong>' || w || '</strong> <code>c</code>' WHEN 5 THEN 'a,b|1,' || w ELSE w END AS content, CASE WHEN pos % 6 = 4 THEN 'sql' END AS language FROM (SELECT *, {WORDS} AS w FROM ({LINES}))""",
    "formula_normalize": """
        SELECT p_partkey, CASE k WHEN 0 THEN 'a_' || p_partkey || ' = b' WHEN 1 THEN '\\mathbf{S} = ' || p_partkey WHEN 2 THEN 'A - \\pi ' || p_partkey WHEN 5 THEN 'x^' || p_partkey || ' + y' END AS latex,
               CASE WHEN k = 3 THEN '<math><mi>x</mi><mn>' || p_partkey || '</mn></math>' END AS mathml FROM (SELECT p_partkey, p_partkey % 6 AS k FROM part)""",
    "code_languages": "SELECT p_partkey, named, detected, language, display FROM part JOIN (VALUES "
    + _values(
        (0, "python", "", "python", "Python"), (1, "javascript", "", "javascript", "JavaScript"), (2, "cpp", "", "cpp", "C++"), (3, "bash", "", "bash", "Shell"), (4, "", "python", "python", "Python"),
        (5, "", "javascript", "javascript", "JavaScript"), (6, "", "json", "json", "JSON"), (7, "", "sql", "sql", "SQL"), (8, "", "", "", "Code"), (9, "rust", "", "rust", "Rust"), (10, "yaml", "", "yaml", "YAML"), (11, "unknown9", "cpp", "cpp", "C++"),
    )
    + ") v(k, named, detected, language, display) ON p_partkey % 12 = k",
    "clean_titles": "SELECT c_custkey, c_name || (CASE c_custkey % 6 WHEN 1 THEN ' here' WHEN 2 THEN ' by' ELSE '' END) AS title FROM customer",
    "text_typography": """
        SELECT c_custkey, 'x<sup>' || k || '</sup> <code>a^2</code> (b)<sup>n+' || k || '</sup> <b>c<sup>d</sup></b> ^e' AS math, 'aé€&lt;' || k AS content, 'x ' || k AS mathml, k || '<br><br>z' AS breaks FROM (SELECT c_custkey, c_custkey::VARCHAR AS k FROM customer)""",
    "sanitize_html": f"""SELECT doc_id, md5({esc3("coalesce(text, '')")} || ' <b>b</b><a>c</a><a href="https://d.example">d</a>') AS clean_md5 FROM documents""",
    "media_urls": """
        WITH u AS (SELECT *, CASE WHEN l_linenumber = 7 THEN 'evil.example' ELSE 'pbs.twimg.com' END AS host, CASE WHEN l_linenumber % 2 = 0 THEN 'small' ELSE 'large' END AS size FROM lineitem)
        SELECT l_orderkey, l_linenumber, host <> 'evil.example' AS allowed, CASE WHEN host <> 'evil.example' THEN 'https://pbs.twimg.com/media/P' || l_partkey || '.png?name=orig&format=png' END AS orig,
               'https://' || host || '/media/P' || l_partkey || '.png' AS media_key, (CASE WHEN size = 'large' THEN 28 ELSE 14 END)::BIGINT AS score FROM u""",
    "images_largest": """
        WITH m AS (SELECT l_orderkey, l_linenumber AS seq, l_suppkey % 3 AS k, (l_quantity * 20)::INTEGER AS w, (l_partkey % 500 + 1)::INTEGER AS h FROM lineitem),
        g AS (SELECT *, w::BIGINT * h AS area FROM m WHERE w >= 150 AND h >= 80 AND w * h >= 32000 AND w::DOUBLE / h BETWEEN 0.08 AND 12 AND NOT (seq = 5 AND w * h < 250000))
        SELECT l_orderkey, seq::BIGINT AS seq, 'https://pbs.twimg.com/media/P' || k || '.jpg' AS media_key, area FROM g QUALIFY row_number() OVER (PARTITION BY l_orderkey, k ORDER BY area DESC, seq) = 1""",
    "anchors_nearest": f"""
        WITH b AS ({BOXES}), i AS (SELECT *, row_number() OVER () AS n FROM b WHERE item_id % 2 = 0), a AS (SELECT * FROM b WHERE item_id % 2 = 1)
        SELECT page_id, item_id, coalesce((SELECT arg_max(a.item_id::VARCHAR, a.top) FROM a WHERE a.page_id = i.page_id AND a.top + 40 <= i.top + 8), '') AS before_text,
               coalesce((SELECT arg_min(a.item_id::VARCHAR, a.top) FROM a WHERE a.page_id = i.page_id AND a.top >= i.top + 40 - 8), '') AS after_text FROM i""",
    "media_inventory": f"""
        WITH s AS (SELECT *, l_suppkey % 2 AS k, (CASE WHEN item_id % 2 = 0 THEN 200 ELSE 0 END) + 100 + (CASE WHEN item_id % 3 = 0 THEN 60 ELSE 0 END) + least(item_id * 300, 2000) / 10.0 + (CASE WHEN top BETWEEN 3600 AND 9400 THEN 100 ELSE 0 END) AS score
                   FROM ({BOXES}) WHERE top BETWEEN 2400 AND 11200)
        SELECT page_id, item_id AS seq, 'https://pbs.twimg.com/media/P' || k || '.jpg?format=jpg' AS media_key, round(score, 3)::DOUBLE AS score FROM s QUALIFY row_number() OVER (PARTITION BY page_id, k ORDER BY score DESC, item_id) = 1""",
    "cover_detect": f"""
        WITH s AS (SELECT *, 2500 - greatest(0, top - 1000) + (CASE WHEN item_id * 200 / 300.0 BETWEEN 1.25 AND 4.8 THEN 500 ELSE 0 END) + (CASE WHEN item_id * 200 >= 480 THEN 280 ELSE 0 END) + (CASE WHEN top <= 5180 THEN 220 ELSE 0 END) AS score
                   FROM ({BOXES}) WHERE top BETWEEN 900 AND 5900)
        SELECT page_id, 'i' || item_id AS src, score::BIGINT AS score FROM s QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, top, item_id) = 1""",
    "time_nearest": f"SELECT page_id, 't' || item_id AS published FROM ({BOXES}) WHERE top <= 6180 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY abs(6000 - top), top) = 1",
    "blocks_in_order": f"SELECT page_id, item_id, row_number() OVER (PARTITION BY page_id ORDER BY round(top / 2.0), item_id) - 1 AS block_idx FROM ({BOXES})",
    "captured_near": f"SELECT page_id, item_id AS seq, CASE WHEN item_id % 2 = 0 THEN 'code' ELSE 'formula' END AS type FROM ({BOXES}) WHERE top BETWEEN 3000 AND 10800 AND CASE WHEN item_id % 2 = 0 THEN item_id >= 4 ELSE item_id <> 3 END",
    "capture_responses": """
        WITH k AS (SELECT user_id AS capture_id, event_id AS payload_idx, props FROM events WHERE event_type IN ('view', 'click', 'signup')),
        n AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY payload_idx) AS nth FROM k)
        SELECT capture_id, payload_idx, md5(props) AS body_md5 FROM n WHERE nth <= 48""",
    "stopped_sessions": """
        WITH e AS (SELECT user_id, epoch_us(ts) AS tm FROM events), g AS (SELECT *, CASE WHEN tm - lag(tm) OVER (PARTITION BY user_id ORDER BY tm) < 21600000000 THEN 0 ELSE 1 END AS new FROM e),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY tm ROWS UNBOUNDED PRECEDING) AS session FROM g), w AS (SELECT *, min(tm) OVER (PARTITION BY user_id, session) AS start FROM s)
        SELECT user_id, start, count(*) FILTER (WHERE tm <= start + 43200000000) AS n, max(tm) + 21600000000 > start + 43200000000 AS stopped FROM w GROUP BY user_id, session, start""",
}
ORACLES["page_document_blocks"] = f"""
    SELECT i AS doc_id, v.* FROM ({PAGES}), LATERAL (VALUES
        (0::BIGINT, 'paragraph', NULL::INTEGER, 'First ' || c || ' <a href="https://t.example/' || i || '?a=1&amp;b=2">link</a>', NULL, NULL), (1, 'heading', 2, 'Part ' || i, NULL, NULL),
        (2, 'list', NULL, '0one|1in ' || i || '|0two', NULL, NULL), (3, 'code', NULL, 'x = ' || i || chr(10) || 'y = 2', NULL, NULL), (4, 'blockquote', NULL, 'q1|q2 ' || i, NULL, NULL),
        (5, 'table', NULL, 'a,b|1,t' || i, NULL, NULL), (6, 'figure', NULL, NULL, 'https://pbs.twimg.com/media/F' || i || '.jpg', 'cap'), (7, 'separator', NULL, NULL, NULL, NULL),
        (8, 'list', NULL, '0alpha ' || i || '|0beta', NULL, NULL), (9, 'media', NULL, NULL, NULL, NULL), (10, 'embedded_post', NULL, NULL, NULL, NULL), (11, 'link_card', NULL, NULL, NULL, NULL), (12, 'heading', 3, 'Linked ' || name, NULL, NULL)
    ) v(block_idx, type, level, content, src, caption)"""

_INLINE = [
    (0, "unstyled", "𝑆<sup>2</sup> <strong>tail</strong> &amp; more", None), (1, "header-one", "A part", None), (2, "unstyled", " ", "media"), (3, "atomic", " ", "markdown"), (4, "ordered-list-item", "one", None),
    (5, "ordered-list-item", "inner", None), (6, "unordered-list-item", "two", None), (7, "atomic", " ", "latex"), (8, "atomic", " ", "latex"), (9, "atomic", " ", "latex"), (10, "atomic", " ", "tweet"),
    (11, "atomic", '<a href="https://www.site.example/a b"> </a>', "link"), (12, "unstyled", "Look at the following code:", None), (13, "horizontal-rule", "", None),
]
ORACLES["draft_inline"] = f"SELECT doc_id::BIGINT AS doc_id, raw_idx, type, html, entity_type FROM (VALUES {_values(*_INLINE)}) v(raw_idx, type, html, entity_type), (VALUES (1), (3)) d(doc_id)"
#: Of the Markdown text in ``literals`` each line's block: its kind, first and last line, and the lines that are fences or delimiters.
_PLACED = [("heading", 0, 0), ("paragraph", 2, 3), ("blockquote", 5, 9), ("code", 10, 12), ("list", 14, 19), ("table", 20, 22), ("separator", 24, 24), ("paragraph", 25, 26)]
ORACLES["line_kind_classify"] = f"""
    SELECT 1::BIGINT AS doc_id, unnest(range(first, last + 1))::INTEGER AS pos, kind, block, unnest(range(first, last + 1)) NOT IN (10, 12, 21) AS "inner"
    FROM (VALUES {_values(*((i, *x) for i, x in enumerate(_PLACED)))}) v(block, kind, first, last)"""
ORACLES["pseudo_list_groups"] = f"SELECT doc_id::BIGINT AS doc_id, block_idx, ordered, items FROM (VALUES {_values((1, 0, False, 'one|two'), (1, 3, True, 'first|second'))}) v(doc_id, block_idx, ordered, items)"
_GOOD = (
    '{"ok":true,"title":"A title","author_handle":"ab","url":"https://x.com/ab/article/55","path":"data.tweetResult.result.article.article_results.result","score":248,'
    '"types":["paragraph","heading","image","code","list","list","formula","formula","formula","embedded_post","link_card","paragraph","separator"]}'
)
_FAILED = '{"ok":false,"error":"no article with title and rich text in the payloads","url":"https://x.com/ab/article/56"}'
ORACLES["diagnostics_json"] = f"SELECT doc_id::BIGINT AS doc_id, diagnostics FROM (VALUES {_values((1, _GOOD), (2, _FAILED), (3, _GOOD))}) v(doc_id, diagnostics)"
