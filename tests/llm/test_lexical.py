"""Ranked search against scores summed document by document."""

import math
import random
import re
from collections import Counter

import numpy as np
from structdoc.llm.lexical import lengths, radix_order, search
from structdoc.llm.queries import op12_search, oracle_sql

from tests.llm.fixtures import SCHEMA, docs, empty, rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(documents, items, most=10):
    counted = [(d, Counter(terms(t))) for d, t in documents]
    big_n, big_l = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    queries = {}
    for i, t in items:
        if i is not None and t is not None:
            queries.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in queries.items():
        found = []
        for doc, c in counted:
            m = 10 + (90 * sum(c.values()) * big_n) // max(1, big_l)
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if score > 0:
                found.append((-score, doc is None, doc))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, rank, doc, -score) for rank, (score, _, doc) in enumerate(found[:most], start=1)]
    return out


ITEMS = [(1, "The river of GREEN stone"), (2, "copper walking walls"), (2, "paper signals, paper"), (3, None), (None, "river"), (4, ""), (5, "nothing of that zzz"), (6, "école É"), (7, "x12 12 34"), (1, "The river of GREEN stone")]


def compared(spark, table, **more):
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, score int")
    got = search(table, items, **more)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = brute([(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()], ITEMS)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    return want


def test_scores_ranks_ties_and_repeats(spark):
    table = docs(spark).withColumnRenamed("key", "term").withColumnRenamed("row", "item_id")
    want = compared(spark, table)
    assert {x[0] for x in want} >= {1, 2, 5, 6, 7} and 3 not in {x[0] for x in want}


def test_more_ties_than_places_and_rows_without_id(spark):
    rng = random.Random(1)
    table = rows() + [(rng.choice([None, i]), "river stone copper", None, None, 0, 1, 2, "k", "l") for i in range(3000, 3060)]
    compared(spark, spark.createDataFrame(table, SCHEMA).repartition(7))


def test_shards_and_parts_change_nothing(spark):
    compared(spark, docs(spark), shard_bytes=20, parts=7)


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search(empty(spark), items).count() == 0
    assert search(docs(spark), items.limit(0)).count() == 0


def test_radix_order_is_the_stable_order():
    rng = np.random.default_rng(3)
    for top in (1, 100, 70_000, 2**33):
        keys = rng.integers(0, top + 1, 5000)
        assert (radix_order(keys, top) == np.argsort(keys, kind="stable")).all()


def test_lengths_beyond_64_bits():
    n = np.array([0, 7, 10**9])
    assert lengths(n, 10**11, 10**13).tolist() == [10 + 90 * x * 10**11 // 10**13 for x in n.tolist()]


def test_query_equals_its_sql(spark, duck_tables):
    con, sf = duck_tables
    got = op12_search(spark, sf)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({oracle_sql()['op12_search']})").fetchall(), key=repr)
