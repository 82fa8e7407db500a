"""DuckDB SQL that gives the rows of the registered queries."""

from __future__ import annotations

import re

from structdoc.functions.code import RULES
from structdoc.functions.formula import TEX_MARKS
from structdoc.functions.text import INTERFACE_WORDS, NAVIGATION_WORDS, PUNCTUATION_PATTERNS, SPACE, ZERO_WIDTH
from structdoc.functions.urls import SITE

SP = SPACE[1:-1].replace("\\x0b", "\\x0B")


def q(pattern: str) -> str:
    pattern = re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", pattern)
    return "'" + pattern.replace("'", "''") + "'"


def rep(c: str, pattern: str, to: str = "", flags: str = "g") -> str:
    return f"regexp_replace({c}, {q(pattern)}, {q(to)}, '{flags}')"


def lit(c: str, *pairs: tuple[str, str]) -> str:
    for old, new in pairs:
        c = f"replace({c}, {q(old)}, {q(new)})"
    return c


def strip(c: str) -> str:
    return rep(c, f"^[{SP}]+|[{SP}]+$")


def collapse(c: str) -> str:
    return strip(rep(c, f"[{SP}]+", " "))


def normalize(c: str) -> str:
    return strip(rep(rep(rep(rep(f"coalesce({c}, '')", ZERO_WIDTH), "\u00a0", " "), "[ \\t]+", " "), "\\n{3,}", "\n\n"))


def canonical(c: str) -> str:
    return rep(f"lower({normalize(c)})", f"[\\s\\p{{P}}\\p{{S}}{SP}]+")


def spaced(c: str) -> str:
    t = rep(rep(f"coalesce({c}, '')", r"(?i)<br\s*/?\s*>", " "), "<[^>]+>", " ")
    return rep(lit(t, ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")), f"[{SP}]+", " ")


def tight(c: str) -> str:
    return lit(rep(f"coalesce({c}, '')", "<[^>]+>"), ("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def visible(c: str) -> str:
    out = rep(f"coalesce({c}, '')", r"(?s)<!--.*?-->")
    for tag in ("script", "style", "noscript"):
        out = rep(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>")
    return out


def shown(c: str) -> str:
    out = visible(c)
    for tag in ("nav", "aside", "form", "button"):
        out = rep(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>")
    return out


def ex(c: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({c}, {q(pattern)}, {group})"


def host(c: str) -> str:
    return rep(f"lower({ex(c, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)')})", r"^www\.")


PATH = ex("url", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)")
CLEAN = rep("url", r"[?#].*$")
TITLE = collapse(spaced(ex(visible("html"), r"(?is)<title[^>]*>(.*?)</title>")))


def one_pattern(p: str | tuple[str, ...]) -> str:
    """A pattern of the rules for an engine that takes linear time for any."""
    whole = p if isinstance(p, str) else "|".join([f"(?:{p[0]}(?s:.*){p[1]})", *p[2:]])
    return whole.replace("*+", "*").replace("++", "+").replace("?+", "?")


SCORES = {
    name: " + ".join(f"(CASE WHEN regexp_matches(html, {q(one_pattern(p[0]))}) THEN {w} ELSE 0 END)" for n, w, *p in RULES if n == name)
    for name in ("markup", "javascript", "css", "sql")
}
LINES = "SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"
EVENTS = "SELECT *, epoch_us(ts) AS tm FROM events"
CELLS = r"list_transform(string_split(replace(regexp_replace(regexp_replace(trim(line), '^\|', ''), '\|$', ''), '\|', chr(1)), '|'), lambda c: trim(replace(c, chr(1), '|')))"
BODY = collapse(spaced(ex(visible("html"), r"(?is)<body[^>]*>(.*)</body>")))
COUNT = "len(regexp_extract_all({}, {}))"


def clean_title(c: str) -> str:
    out = strip(rep(rep(normalize(c), r"(?i)\s*[/|\x{00b7}-]\s*X\s*$"), r"(?i)^.+?\s+on X:\s*"))
    return strip(rep(out, r"(?i)\s+Follow(?:ing)?\b.*$"))


ORACLES = {
    "page_title": f"SELECT page_id, {clean_title(TITLE)} AS title, length({clean_title(TITLE)}) BETWEEN 2 AND 280 AND NOT regexp_matches({clean_title(TITLE)}, {q(f'(?i)^(?:{NAVIGATION_WORDS})$')}) AS plausible, length({TITLE}) AS raw_chars FROM pages",
    "page_parts": f"SELECT page_id, lower({ex('url', '^([A-Za-z][A-Za-z0-9+.-]*):')}) AS protocol, {host('url')} AS hostname, {PATH} AS path, {CLEAN} AS clean_url, trim(url) AS safe_url FROM pages",
    "page_router": f"""
        SELECT page_id, CASE WHEN regexp_matches({PATH}, '/article/\\d+') THEN 'article' WHEN regexp_matches({PATH}, '/status/\\d+') THEN 'post' ELSE 'other' END AS kind,
               {ex(PATH, '^/([a-z]{2})/([0-9]+)')} AS lang, {ex(PATH, '^/([a-z]{2})/([0-9]+)', 2)} AS number,
               CASE WHEN regexp_matches({PATH}, '^/[^/]+/article/[0-9]+') THEN '{SITE}/' || {ex(PATH, '^/([^/]+)/article/')} || '/article/' || {ex(PATH, '/article/([0-9]+)')} ELSE '' END AS article_url
        FROM pages""",
    "page_lang": f"""SELECT coalesce(nullif(lower({ex('html', '(?i)<html[^>]*\\blang="([^"]*)"')}), ''), 'unknown') AS lang, count(*) AS n FROM pages GROUP BY 1""",
    "page_canonical_url": f"SELECT page_id, '{SITE}/' || string_split({host('url')}, '.')[1] || '/article/' || {ex('url', '/([0-9]+)')} AS canonical_url FROM pages",
    "page_summary": f"""
        WITH t AS (SELECT page_id, {TITLE} AS title, {host('url')} AS hostname, {COUNT.format(visible('html'), q('(?i)<p[^a-z0-9_]'))} AS paragraphs, {BODY} AS body FROM pages),
        k AS (SELECT *, length(body) AS chars, md5({canonical('body')}) AS text_key FROM t)
        SELECT text_key, page_id, title, hostname, paragraphs, chars FROM k QUALIFY row_number() OVER (PARTITION BY text_key ORDER BY page_id) = 1""",
    "page_block_counts": f"""
        SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower({shown('html')}), '<(h[1-6]|p|ul|ol|table|figure|img|hr|pre|blockquote|footer|div)\\b', 1)) AS tag FROM pages) GROUP BY tag""",
    "page_blocks_native": f"""
        WITH s AS (SELECT page_id, string_split(regexp_replace({shown('html')}, '(?i)(<(?:h[1-6]|p)\\b)', chr(1) || '\\1', 'g'), chr(1)) AS l FROM pages),
        e AS (SELECT page_id, unnest(range(len(l))) AS tm, unnest(l) AS piece FROM s),
        t AS (SELECT page_id, tm, lower({ex('piece', '^<([A-Za-z0-9]+)')}) AS tag,
                     {collapse(spaced(rep('piece', '(?is)</(?:h[1-6]|p|article|body|html)' + chr(92) + 's*>.*$|<(?:footer|div)' + chr(92) + 'b.*$')))} AS text FROM e WHERE tm > 0),
        u AS (SELECT * FROM t WHERE length(text) >= 2 AND NOT regexp_matches(text, {q(f'(?i)^(?:{INTERFACE_WORDS})$')}))
        SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY tm) - 1 AS block_idx, CASE WHEN tag = 'p' THEN 'paragraph' ELSE 'heading' END AS type, text FROM u""",
    "page_body_score": f"""
        WITH a AS (SELECT page_id, {ex(visible('html'), '(?is)<article' + chr(92) + 'b[^>]*>(.*?)</article>')} AS article FROM pages),
        s AS (SELECT page_id, length({collapse(spaced('article'))}) + 90 * {COUNT.format('article', q('(?i)<p[^a-z0-9_]'))} + 160 * {COUNT.format('article', q('(?i)<h[1-4][^a-z0-9_]'))}
                     - 45 * {COUNT.format('article', q('(?i)<button[^a-z0-9_]'))} - 900 * {COUNT.format('article', q('(?i)<(?:nav|aside)[^a-z0-9_]'))} AS score FROM a)
        SELECT page_id, score FROM s WHERE score > 700""",
    "page_links": f"""
        SELECT href, count(*) AS pages, min(page_id) AS first_page
        FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all({visible('html')}, '(?i)<a\\s[^>]*href="([^"]*)"', 1))) AS href FROM pages) GROUP BY href""",
    "text_normalize": f"SELECT doc_id, length({normalize('text')}) AS chars, md5({normalize('text')}) AS md5 FROM documents",
    "text_canonical": f"SELECT doc_id, md5({canonical('text')}) AS md5 FROM documents",
    "text_useful": f"""
        SELECT CASE WHEN length(line) >= 2 AND NOT regexp_matches(line, {q(f'(?i)^(?:{INTERFACE_WORDS})$')}) THEN 'true' ELSE 'false' END AS useful, count(*) AS n FROM ({LINES}) GROUP BY 1""",
    "html_escape_decode": f"""
        SELECT page_id, md5({lit("coalesce(html, '')", ('&', '&amp;'), ('<', '&lt;'), ('>', '&gt;'), ('"', '&quot;'), ("'", '&#39;'), ('`', '&#96;'))}) AS escaped_md5,
               md5({lit(lit("coalesce(html, '')", ('&', '&amp;'), ('<', '&lt;'), ('>', '&gt;'), ('"', '&quot;'), ("'", '&#39;')), ('&amp;', '&'), ('&quot;', '"'), ('&#39;', "'"), ('&lt;', '<'), ('&gt;', '>'))}) AS decoded_md5 FROM pages""",
    "strip_html": f"SELECT page_id, md5({collapse(spaced('html'))}) AS spaced_md5, md5({tight('html')}) AS tight_md5 FROM pages",
    "filename_sanitize": "SELECT doc_id, coalesce(nullif(substring({0}, 1, 140), ''), 'document') AS filename FROM documents".format(
        rep(strip(rep(rep("coalesce(nullif(text, ''), 'document')", r'[/:*?"<>|\x00-\x1f]', " "), f"[{SP}]+", " ")), "[. ]+$")
    ),
    "doc_dedup_first": f"SELECT md5({canonical('text')}) AS text_key, min(doc_id) AS doc_id FROM documents GROUP BY 1",
    "doc_line_dedup_first": f"""
        WITH k AS (SELECT doc_id, pos, {canonical('line')} AS key FROM ({LINES})), f AS (SELECT doc_id, key, min(pos) AS pos FROM k WHERE key <> '' GROUP BY ALL)
        SELECT doc_id, count(*) AS kept_lines, sum(pos)::BIGINT AS pos_sum FROM f GROUP BY doc_id""",
    "doc_contained_dup": f"""
        WITH k AS (SELECT doc_id, pos, {canonical('line')} AS key FROM ({LINES})), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM k WHERE length(key) >= 20)
        SELECT DISTINCT a.doc_id, a.pos FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i - 6 AND a.i - 1
        WHERE least(length(a.key), length(b.key)) / greatest(length(a.key), length(b.key))::DOUBLE >= 0.62 AND (contains(a.key, b.key) OR contains(b.key, a.key))""",
    "pipe_line_split": f"SELECT doc_id, pos, len({CELLS}) AS cells, {CELLS}[1] AS first_cell, {CELLS}[-1] AS last_cell FROM ({LINES}) WHERE contains(line, '|')",
    "code_language_score": f"SELECT page_id, {', '.join(f'({v})::BIGINT AS {k}' for k, v in SCORES.items())}, {' + '.join(COUNT.format('html', q(p)) for p in PUNCTUATION_PATTERNS)} AS punctuation FROM pages",
    "tex_detect": f"SELECT doc_id FROM documents WHERE regexp_matches(text, {q(TEX_MARKS)})",
    "event_merge_runs": f"""
        WITH c AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS new FROM ({EVENTS}) WINDOW w AS (PARTITION BY user_id ORDER BY tm)),
        i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY tm ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM c)
        SELECT user_id, island, event_type, count(*) AS n, round(sum(value), 4) AS value, min(event_id) AS least_event, max(event_id) AS largest_event FROM i GROUP BY ALL""",
    "event_next_gap": f"""
        WITH n AS (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY tm) AS next_type FROM ({EVENTS}))
        SELECT event_id, next_type FROM n WHERE event_type = 'view' AND NOT coalesce(next_type IN ('click', 'purchase'), false)""",
    "conv_fallback_zip": """
        WITH a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal FROM conversations WHERE role = 'user'),
        b AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal FROM conversations WHERE role = 'assistant')
        SELECT a.conv_id, a.ordinal, a.turn AS asked, b.turn AS answered FROM a LEFT JOIN b USING (conv_id, ordinal)""",
    "count_by": "SELECT coalesce(nullif(event_type, ''), 'unknown') AS event_type, count(*) AS n FROM events GROUP BY 1",
    "count_by_unknown": "SELECT coalesce(quality::VARCHAR, 'unknown') AS quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "top1_candidate": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 10 + CASE WHEN l_returnflag = 'R' THEN 100 ELSE 0 END AS score FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_partkey * 10 + l_linenumber) = 1""",
    "topk_images": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) <= 4",
    "first_wins_index": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1",
    "last_wins_index": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
    "media_lookup_left": "SELECT o_orderkey, o_custkey AS c_custkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey",
    "post_lookup_left": "SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)",
    "fallback_coalesce_join": """
        WITH k AS (SELECT d.doc_id, lang, source, quality FROM documents d JOIN labels USING (doc_id)),
        s AS (SELECT lang, source, round(avg(quality), 6) AS value FROM k GROUP BY ALL HAVING count(*) >= 3), l AS (SELECT lang, round(avg(quality), 6) AS value FROM k GROUP BY ALL HAVING count(*) >= 3)
        SELECT d.doc_id, coalesce(o.quality::DOUBLE, s.value, l.value) AS value, CASE WHEN o.quality IS NOT NULL THEN 'own' WHEN s.value IS NOT NULL THEN 'source' WHEN l.value IS NOT NULL THEN 'lang' END AS origin
        FROM documents d LEFT JOIN labels o ON d.doc_id = o.doc_id LEFT JOIN s ON d.lang = s.lang AND d.source = s.source LEFT JOIN l ON d.lang = l.lang""",
    "semi_labeled": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "anti_labeled": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "asof_before_after": f"""
        WITH e AS ({EVENTS}), b AS (SELECT event_id, user_id, tm FROM e WHERE event_type = 'purchase')
        SELECT b.event_id, b.user_id, v.event_id AS view_id, c.event_id AS click_id FROM b
        ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'view') v ON b.user_id = v.user_id AND b.tm >= v.tm
        ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'click') c ON b.user_id = c.user_id AND b.tm <= c.tm""",
    "interval_containment": f"""
        WITH e AS ({EVENTS}) SELECT s.event_id AS signup_id, e.event_id FROM e JOIN e s ON e.user_id = s.user_id
        WHERE s.event_type = 'signup' AND e.tm BETWEEN s.tm AND s.tm + 3600000000 AND e.event_id <> s.event_id""",
    "union_keep_distinct": """
        WITH u AS (SELECT c_nationkey AS nation, c_name AS name, c_acctbal AS balance, c_custkey AS seq FROM customer UNION ALL SELECT s_nationkey, s_name, s_acctbal, s_suppkey + 1000000000000 FROM supplier)
        SELECT nation, name, balance FROM u QUALIFY row_number() OVER (PARTITION BY nation ORDER BY balance DESC, seq) = 1""",
    "running_cap": """
        WITH e AS (SELECT user_id, event_id, floor(abs(value))::BIGINT AS units FROM events),
        t AS (SELECT user_id, event_id, count(*) OVER w AS n, sum(units) OVER w AS total FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
        SELECT user_id, event_id, total::BIGINT AS running_total FROM t WHERE n <= 6 AND total <= 240""",
    "weighted_avg": "SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS discount FROM lineitem GROUP BY 1",
    "min_nearest": """
        SELECT o_custkey, o_orderkey, round(abs(o_totalprice - 150000), 2) AS distance FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY round(abs(o_totalprice - 150000), 2), o_orderkey) = 1""",
    "separator_collapse": f"""
        WITH p AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY tm) AS before FROM ({EVENTS}))
        SELECT user_id, count(*) AS n FROM p WHERE NOT (event_type = 'error' AND before IS NOT DISTINCT FROM 'error') GROUP BY 1""",
    "props_json_extract": "SELECT event_id, CASE WHEN (props::JSON->>'k')::BIGINT > 0 THEN (props::JSON->>'k')::BIGINT END AS k FROM events",
    "request_correlate": f"""
        WITH e AS ({EVENTS}) SELECT v.event_id AS view_id, p.event_id AS purchase_id FROM e v JOIN e p ON v.user_id = p.user_id
        WHERE v.event_type = 'view' AND p.event_type = 'purchase' AND p.tm BETWEEN v.tm AND v.tm + 86400000000""",
    "session_quiescence": f"""
        WITH g AS (SELECT *, CASE WHEN tm - lag(tm) OVER (PARTITION BY user_id ORDER BY tm) <= 21600000000 THEN 0 ELSE 1 END AS new FROM ({EVENTS})),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY tm ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g)
        SELECT user_id, session, count(*) AS n, min(tm) AS start, max(tm) AS "end" FROM s GROUP BY ALL""",
    "rolling_upsert": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) = 1",
}
ORACLES["page_dom_blocks"] = ORACLES["page_blocks_native"]
ORACLES["page_body_top1"] = f"SELECT page_id FROM ({ORACLES['page_body_score']})"
ORACLES["page_nested_lists"] = f"""
    WITH n AS (SELECT page_id, regexp_extract_all({visible('html')}, '(?s)<li>(.*?)</li>', 1) AS l FROM pages)
    SELECT page_id, unnest(range(len(l)))::INTEGER AS pos, {collapse(spaced('unnest(l)'))} AS text, false AS nested FROM n"""
ORACLES["session_windows"] = f"""
    WITH g AS (SELECT *, CASE WHEN tm - lag(tm) OVER (PARTITION BY user_id ORDER BY tm) < 21600000000 THEN 0 ELSE 1 END AS new FROM ({EVENTS})),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY tm ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, min(tm) AS start, count(*) AS n FROM s GROUP BY user_id, session"""
