"""Texts of a megabyte that once took squares and cubes of time."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F
from structdoc.functions import code
from structdoc.functions import markdown as M
from structdoc.operators import markdown
from structdoc.sources.html import read_html
from structdoc.sources.payloads import parse_body

MEGA = 1_000_000
LINES = {"heading": "# a" + " " * MEGA + "b", "delimiter": "a | b\n" + " " * MEGA + "x", "fence": "```" + " " * MEGA + "x y", "hashes": "# " + "#" * MEGA + " a", "brackets": "[" * MEGA, "closed": "[" * MEGA + "](x", "ticks": "`" * MEGA, "stars": "*a " * (MEGA // 3), "runs": "**" * (MEGA // 2)}
CODE = {"from": "from " * (MEGA // 5), "tags": "<a\n" * (MEGA // 3), "select": "select " * (MEGA // 7)}
PAGES = {"div": "<div>" * (MEGA // 5), "ends": "<b></i>" * (MEGA // 7), "items": "<ul><li>" * (MEGA // 8), "p": "<p>" * (MEGA // 6)}
BODIES = {"open": "<script>" + "{" * MEGA + "</script>", "scripts": "<script>" * (MEGA // 8)}


@pytest.mark.parametrize("name", sorted(LINES))
def test_markdown(spark, name):
    began = time.time()
    markdown.place_lines(LINES[name].split("\n"))
    markdown.inline_html(LINES[name])
    frame = spark.createDataFrame([(LINES[name].split("\n")[0],)], "t string")
    frame.select(M.heading_text(F.col("t")), *(F.col("t").rlike(p) for p in (M.FENCE, M.HEADING, M.LIST_ITEM, M.RULE, M.DELIMITER))).collect()
    assert time.time() - began < 10


@pytest.mark.parametrize("name", sorted(CODE))
def test_code(spark, name):
    began = time.time()
    row = spark.createDataFrame([(CODE[name],)], "t string").select(code.detect_language(F.col("t")), code.block_language(F.lit(""), F.col("t")), code.page_language(F.lit(""), F.col("t"))).first()
    assert len(row) == 3 and time.time() - began < 30  # many rules, each of them once


@pytest.mark.parametrize("name", sorted(PAGES))
def test_pages(name):
    began = time.time()
    assert read_html(1, PAGES[name]) and time.time() - began < 10


@pytest.mark.parametrize("name", sorted(BODIES))
def test_bodies(name):
    began = time.time()
    assert parse_body(BODIES[name]) == [] and time.time() - began < 10


def test_headings_say_what_a_pattern_would(spark):
    pattern = re.compile(r"^\s{0,3}(#{1,4})\s+(.+?)\s*#*\s*$")
    rng = random.Random(5)
    lines = ["".join(rng.choice("# a\t") for _ in range(rng.randint(0, 9))) for _ in range(3000)] + ["# a ## ", "## b", "#c", "# ##", "#  ", "# "]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, t string").select("i", F.when(F.col("t").rlike(M.HEADING), F.concat(F.regexp_extract("t", M.HEADING, 1), F.lit("|"), M.heading_text(F.col("t")))).alias("h"))
    for r in got.collect():
        m = pattern.match(lines[r.i])
        assert (r.h is None) == (m is None), lines[r.i]
        if m and lines[r.i].strip("# \t"):
            assert r.h == f"{m[1]}|{m[2]}", lines[r.i]


def test_inline_markup():
    cases = {
        "a **b** c": "a <strong>b</strong> c", "***a***": "<em><strong>a</strong></em>", "*a **b** c*": "<em>a <strong>b</strong> c</em>", "**a _b_ c**": "<strong>a <em>b</em> c</strong>",
        "`*x*` *y*": "<code>*x*</code> <em>y</em>", "~~a~~ ~b~": "<s>a</s> ~b~", "*a\nb*": "*a\nb*", "**a\nb**": "<strong>a\nb</strong>", "__a__ _b_": "<strong>a</strong> <em>b</em>",
        "[l](https://a.example/?q=1&r=2)": '<a href="https://a.example/?q=1&amp;r=2">l</a>', '[l](https://a.example "t")': '<a href="https://a.example">l</a>', "[l](ftp://a)": "[l](ftp://a)",
        "[a *b*](http://x) *c*": '<a href="http://x">a *b*</a> <em>c</em>', "[`]`](http://x)": '<a href="http://x"><code>]</code></a>', "[[a](http://x)": '<a href="http://x">[a</a>', "[](http://x)": "[](http://x)",
        "<&>\"'": "&lt;&amp;&gt;&quot;&#39;", "a*b": "a*b", "**a*": "**a*", "": "", None: "", "**a** **b**": "<strong>a</strong> <strong>b</strong>", "*a* *b*": "<em>a</em> <em>b</em>",
    }
    assert {k: markdown.inline_html(k) for k in cases} == cases


def test_media_addresses_name_their_parts_seldom():
    from pyspark.sql import functions as F
    from structdoc.functions import urls as U

    for made, most in ((U.is_media_url, 1), (U.media_url, 16), (U.media_key, 4)):
        assert str(made(F.col("address"))).count("address") <= most
