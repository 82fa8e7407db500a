"""Source divergence against counts term by term."""

import random
import re
from collections import Counter, defaultdict

from structdoc.llm.divergence import source_divergence
from structdoc.llm.queries import op13_divergence, oracle_sql

from tests.llm.fixtures import SCHEMA, empty, rows, sentence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(documents, min_docs, top=50):
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in documents:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        df[lang].update(set(terms(text)))
        counts[lang, source].update(terms(text))
    out = []
    for lang in df:
        kept = sorted(t for t, n in df[lang].items() if n >= min_docs)
        sources = sorted(s for x, s in groups if x == lang)
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def shares(count, kept=kept):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (n + 5 * len(kept)) for t in kept}

        q, p = shares(whole), {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            own = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, i.decode(), -v, k) for part, of in (("pair", pairs), ("term", own)) for k, (v, i) in enumerate(of, start=1)]
    return out


def audited(spark, seed=5):
    rng = random.Random(seed)
    out = [(*r[:2], rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "", None]), *r[4:]) for r in rows()]
    for i in range(80):
        out.append((100 + i, sentence(rng, rng.randint(0, 40)) + rng.choice([" École naïve", " ÉCOLE x1y", "", "  strange gap"]), rng.choice(["en", "en", "de", "fr"]), rng.choice("abcdefg"), 0, 1, 2, "k", "l"))
    out.append((900, "one two", "it", "lonely", 0, 1, 2, "k", "l"))
    out.append((901, None, "en", "silent", 0, 1, 2, "k", "l"))
    return spark.createDataFrame(out, SCHEMA).repartition(5)


def compared(spark, min_docs, **more):
    table = audited(spark)
    got = source_divergence(table.withColumnRenamed("key", "term").withColumnRenamed("row", "count"), min_docs, **more)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = brute([(r.lang, r.source, r.text) for r in table.collect()], min_docs)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    return want


def test_pairs_and_terms(spark):
    want = compared(spark, 3)
    assert {x[2] for x in want} == {"pair", "term"}


def test_many_shards_blocks_and_tiles(spark):
    compared(spark, 2, shard_bytes=300, block_terms=5, tile=2)


def test_no_term_is_kept(spark):
    want = compared(spark, 10_000)
    assert {x[2] for x in want} == {"pair"} and {x[4] for x in want} == {0}


def test_empty_table(spark):
    assert source_divergence(empty(spark)).count() == 0


def test_query_equals_its_sql(spark, duck_tables):
    con, sf = duck_tables
    got = op13_divergence(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({oracle_sql()['op13_divergence']})").fetchall())
