"""HTML pages as tables: a row for each element, with the interval of its subtree."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

NODES = "page_id long, node_id int, parent_id int, pre int, post int, depth int, tag string, attrs map<string,string>, text string, text_chars int, html string, table_id int"
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: A start tag that ends open elements of these kinds, up to one of the second kinds.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
}
#: Block elements end an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
UNSEEN = frozenset("script style noscript template".split())
#: Elements whose own text and inline markup are kept; of others only the text's length is.
TEXTUAL = frozenset("title h1 h2 h3 h4 h5 h6 p li blockquote pre code td th a figcaption cite time caption summary label span".split())
WRITTEN = ("text", "html")
INLINE = {"b": "strong", "strong": "strong", "i": "em", "em": "em", "u": "u", "s": "s", "del": "s", "strike": "s", "sup": "sup", "sub": "sub", "code": "code", "a": "a"}


#: Schemes that a link in text may have; others, such as scripts, lose their target.
SCHEME = re.compile(r"\s*([A-Za-z][A-Za-z0-9+.-]*):")
LINKS = frozenset(("http", "https", "mailto"))


WORD = re.compile(r"[^\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+")


def escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#39;")


def opening(tag: str, attrs: dict[str, str]) -> str:
    """The tag of inline markup that stands for an element."""
    if INLINE[tag] == "a":
        target = attrs.get("href", "").strip()
        scheme = SCHEME.match(target)
        return f'<a href="{escaped(target)}">' if target and (not scheme or scheme[1].lower() in LINKS) else "<a>"
    return f"<{INLINE[tag]}>"


class _Reader(HTMLParser):
    """Collects elements as [parent, pre, post, depth, tag, attrs, text start, text end, markup start, markup end, characters, table, nested lists].

    Text and inline markup of a page are written once; an element keeps where in them its own begin and end.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[list] = []
        self.open: list[int] = []
        self.levels: dict[str, list[int]] = {}  # for each tag the places in open where it stands
        self.tables: list[int] = []
        self.clock = self.unseen = 0
        self.text, self.markup = [], []
        self.sizes = [0, 0, 0]  # of text, markup, and characters of text with a space for each run of blanks and tags
        self.apart = True  # whether a blank or a tag stands before what comes next

    def _write(self, text: str, markup: str) -> None:
        self.text.append(text)
        self.markup.append(markup)
        self.sizes[0] += len(text)
        self.sizes[1] += len(markup)

    def _count(self, text: str) -> None:
        words = text.split() if text.isascii() and text.isprintable() else WORD.findall(text)  # printable ASCII has no blanks but spaces
        if words:
            joined = not self.apart and text[0] == words[0][0]
            self.sizes[2] += sum(map(len, words)) + len(words) - joined
            self.apart = not text.endswith(words[-1])
        else:
            self.apart = True

    def _close(self) -> None:
        node = self.nodes[self.open.pop()]
        tag = node[4]
        self.levels[tag].pop()
        node[2], node[7], node[9], node[10] = self.clock, self.sizes[0], self.sizes[1], max(self.sizes[2] - node[10] - 1, 0)  # without the space before the first word
        self.clock += 1
        if tag in UNSEEN:
            self.unseen -= 1
        else:
            self.apart = True
        if tag in ("ul", "ol"):  # the item that holds a list doesn't have its text
            if self.levels.get("li"):
                self.nodes[self.open[self.levels["li"][-1]]][12].append((node[6], node[7], node[8], node[9]))
        if tag == "table":
            self.tables.pop()
        if tag in INLINE:
            self._write("", f"</{INLINE[tag]}>")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ENDS_P:
            self._end({"p"}, {"table", "td", "th", "button"})
        if tag in CLOSES:
            self._end(*CLOSES[tag])
        told = {k: v or "" for k, v in attrs}
        if tag in INLINE:
            self._write("", opening(tag, told))
        elif tag == "br":
            self._write("\n", "<br>")
        parent, table = self.open[-1] if self.open else None, self.tables[-1] if self.tables else None
        self.nodes.append([parent, self.clock, None, len(self.open), tag, told, self.sizes[0], None, self.sizes[1], None, self.sizes[2], table, []])
        self.clock += 1
        self.levels.setdefault(tag, []).append(len(self.open))
        self.open.append(len(self.nodes) - 1)
        if tag in UNSEEN:
            self.unseen += 1
        else:
            self.apart = True
        if tag == "table":
            self.tables.append(len(self.nodes) - 1)
        if tag in VOID:
            self._close()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _innermost(self, tags: set[str]) -> int:
        return max((self.levels[t][-1] for t in tags if self.levels.get(t)), default=-1)

    def _end(self, kinds: set[str], stops: set[str]) -> None:
        at = self._innermost(kinds)
        if at >= 0 and at >= self._innermost(stops):
            while len(self.open) > at:
                self._close()

    def handle_endtag(self, tag: str) -> None:
        if self.levels.get(tag):
            at = self.levels[tag][-1]
            while len(self.open) > at:
                self._close()

    def handle_data(self, data: str) -> None:
        if self.open and not self.unseen:
            self._write(data, escaped(data))
            self._count(data)

    def finish(self) -> list[list]:
        self.close()
        while self.open:
            self._close()
        return self.nodes


def read_html(page_id: int, html: str | None, written: tuple[str, ...] = WRITTEN) -> list[tuple]:
    reader = _Reader()
    reader.feed(html or "")
    nodes, text, markup = reader.finish(), "".join(reader.text), "".join(reader.markup)
    whole = lambda of, start, end, holes: "".join(of[a:b] for a, b in zip([start, *(e for _, e in holes)], [*(s for s, _ in holes), end], strict=True))
    texts, markups = (TEXTUAL if name in written else () for name in WRITTEN)
    return [
        (
            page_id, i, parent, pre, post, depth, tag, list(attrs.items()), whole(text, a, b, [h[:2] for h in holes]) if tag in texts else None, chars,
            whole(markup, c, d, [h[2:] for h in holes]) if tag in markups else None, table,
        )
        for i, (parent, pre, post, depth, tag, attrs, a, b, c, d, chars, table, holes) in enumerate(nodes)
    ]


_ARROW = pa.schema(
    [("page_id", pa.int64()), *((n, pa.int32()) for n in ("node_id", "parent_id", "pre", "post", "depth")), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("text_chars", pa.int32()), ("html", pa.string()), ("table_id", pa.int32())]
)


def _nodes(batches: Iterator[pa.RecordBatch], written: tuple[str, ...] = WRITTEN) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 64):
            part = batch.slice(low, 64)
            rows = [r for page_id, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for r in read_html(page_id, html, written)]
            cols = list(zip(*rows, strict=True)) or [[]] * len(_ARROW)
            yield pa.record_batch(list(map(pa.array, cols, _ARROW.types)), schema=_ARROW)


def html_nodes(pages: DataFrame, written: tuple[str, ...] = WRITTEN) -> DataFrame:
    """The elements of pages(page_id, html): a contains b when a.pre < b.pre and a.post > b.post, both of one page.

    pre and post are ticks of one clock, so the elements in a stand between a.pre and a.post in the order of pre. Textual
    elements have their text, and inline markup with link targets. text_chars is the length of all text in an element, a space for each run of blanks and tags. table_id is the innermost table around an element. A null page
    has no elements; rows that repeat a page_id give elements that can't be told apart.
    Of text and html only what is written is given, the others are null.
    """
    return pages.select("page_id", "html").mapInArrow(partial(_nodes, written=written), NODES)
