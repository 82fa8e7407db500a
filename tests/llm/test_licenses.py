"""License scans against a scan word by word."""

import random
import re

from structdoc.llm.licenses import BASE, NOTICES, Template, license_scan
from structdoc.llm.queries import op11_licenses, oracle_sql

from tests.llm.fixtures import SCHEMA, docs, empty, rows

LINES = [
    "Released under the MIT License.", "UNDER THE mit -- license! under the MIT license", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.",
    "This work is licensed under the GNU General Public License, version 3.", "gnu general public license", "All rights reserved.", "under the mit", "cc by nc cc by nc cc by nc",
    "GNU General Public License of a year, in its version 3", "permission is hereby granted, free of charge, to any person obtaining a copy", "permission is hereby granted free of charge", "in compliance with the license",
]


def brute(text, slack=8, min_share=0.5):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    base, found = [], []
    for t in (*BASE, *NOTICES):
        first, *others = t.phrases
        at = next(i for i in range(len(t.words)) if t.words[i : i + len(first)] == first)
        for s in range(len(ws)):
            if ws[s : s + len(first)] != first:
                continue
            if t in BASE:
                base.append((t.label, s))
                found.append((t.label, s, 1.0))
                continue
            around = ws[max(0, s - at - slack) : s - at + len(t.words) + slack]
            share = len(set(t.words) & set(around)) / len(set(t.words))
            if share >= min_share and all(any(around[i : i + len(o)] == o for i in range(len(around))) for o in others):
                found.append((t.label, s, share))
    starts = [s for _, s in base]
    return (len(ws), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for x, _ in base})), ",".join(sorted({x for x, *_ in found})), max((x[2] for x in found), default=0.0), sorted(found))


def licensed(spark, seed=3):
    rng = random.Random(seed)
    out = rows()
    for i in range(60):
        text = " ".join(rng.choice([*LINES, "the", "of", "mit", "license", "apache", "nc", "river under"]) for _ in range(rng.randint(1, 12)))
        out.append((1000 + i, text, "en", "s", 0, 1, 2, "k", "l"))
    out.append((2000, "license mit the under " * 20_000 + LINES[0], "en", "s", 0, 1, 2, "k", "l"))
    return spark.createDataFrame(out, SCHEMA).repartition(5)


def test_every_row_is_scanned_like_word_by_word(spark):
    table = licensed(spark)
    clashing = table.withColumnRenamed("key", "words").withColumnRenamed("label", "held").withColumnRenamed("row", "starts0")
    got = license_scan(clashing).collect()
    want = [(r.doc_id, *brute(r.text)) for r in table.collect()]
    seen = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, sorted((m.label, m.start, m.share) for m in r.matches)) for r in got]
    assert sorted(seen, key=repr) == sorted(want, key=repr)
    assert {x for r in seen for x in r[6].split(",")} >= {"mit", "apache-2", "cc-by-nc", "gpl-3", "all-rights-reserved"}


def test_words_that_repeat_in_a_phrase(spark):
    t = Template("x", "to be or not to be")
    table = spark.createDataFrame([(1, "to be or not to be or not to be"), (2, "to be or not to"), (3, "be to to be or not to be")], "doc_id long, text string")
    got = {r.doc_id: [m.start for m in r.matches] for r in license_scan(table, (t,), ()).collect()}
    assert got == {1: [0, 4], 2: [], 3: [2]}


def test_empty_table_and_plain_documents(spark):
    assert license_scan(empty(spark)).count() == 0
    assert all(r.labels == "" and r.score == 0.0 and r.first_word is None for r in license_scan(docs(spark)).collect())


def test_no_python_runs(spark):
    plan = license_scan(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange hashpartitioning" not in plan


def test_query_equals_its_sql(spark, duck_tables):
    con, sf = duck_tables
    got = op11_licenses(spark, sf)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({oracle_sql()['op11_licenses']})").fetchall(), key=repr)
