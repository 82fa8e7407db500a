"""Queries over pages against their SQL, on pages with odd letters, blanks and references."""

import duckdb
import pytest

import __spark_entry__

BLANKS = "\u0085\u000b"
TITLES = ["Part 12 3K", "A 12 34", "News · Jan 5, 2024", f"A{BLANKS}3K\u0085", "B Followé", "C Follow us", "D on X: E / X", "Home\u0085", "t &am", "t &amp", "t &amp; u &lt;i&gt; &amp;lt; &eacute;", "t &amp&amp;"]
TEXTS = ["óif ciónFROM", "ñfrom WHEREé", "ſelect a", "x = 1\r  y;\u0085z", "\u0085  q\n  r", "{\u000b};", "éconst x éfunction", f"<svg>{BLANKS}\n<div>\u0085", "(a\u0085b)", "plain"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A page for each title and text, and articles whose text's length is near the least score for all numbers of blanks between tags."""
    pages = [f"<!DOCTYPE html><html><head><title>{t}</title></head><body><article><h1>{t}</h1><p>{x}</p></article></body></html>" for t in TITLES for x in TEXTS]
    pages += [f"<html><body><article><h1>{'t' * 30}</h1>{' ' * (n % 4)}<p><b>{'w' * (n // 2)} \n {'v' * (n - n // 2)}<br></article></body></html>" for n in range(400, 430)]
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, f"https://m.example.com/en/{i}", html) for i, html in enumerate(pages)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    return folder


def met(spark, folder, name):
    found = __spark_entry__.queries()[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet/*.parquet')")
    asked = con.execute(f"SELECT {', '.join(found.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, asked))


def test_scores_of_code_are_those_of_sql(spark, odd):
    met(spark, odd, "code_language_score")


def test_titles_are_those_of_sql(spark, odd):
    met(spark, odd, "page_title")


def test_blocks_of_elements_are_those_of_sql(spark, odd):
    met(spark, odd, "page_dom_blocks")


def test_bodies_are_those_of_sql(spark, odd):
    met(spark, odd, "page_body_top1")


def test_merged_blocks_are_those_of_sql(spark, odd):
    met(spark, odd, "page_merged_blocks")


def test_patterns_keep_backslashes(spark):
    from pyspark.sql import functions as F

    from structdoc.functions import code

    found = spark.range(1).select(code.first_rule(F.lit("\\begin{a}"), code.BLOCK_RULES).alias("a"), code.first_rule(F.lit("\\sum"), code.BLOCK_RULES).alias("b")).first()
    assert tuple(found) == ("latex", "latex")
