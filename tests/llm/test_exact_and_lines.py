import hashlib
from collections import defaultdict

from structdoc.llm import exact_dedup as E
from structdoc.llm.line_dedup import line_dedup

from tests.llm.fixtures import docs, empty, rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected_exact():
    groups = defaultdict(list)
    for r in rows():
        groups[(r[1] or "").translate(LOWER)].append(r[0])
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def test_exact_dedup_equals_brute_force(spark):
    assert sorted(map(tuple, E.exact_dedup(docs(spark)).collect()), key=repr) == expected_exact()


def test_exact_dedup_with_clashing_identifiers(spark):
    assert E.clashing_ids(docs(spark).select("text"), 64, 1).count() > 0
    assert sorted(map(tuple, E.exact_dedup(docs(spark), average_chunk=64, id_bytes=1).collect()), key=repr) == expected_exact()


def test_exact_dedup_of_an_empty_table(spark):
    assert E.exact_dedup(empty(spark)).collect() == []


def test_chunks_follow_the_content():
    text = b" ".join(hashlib.sha256(bytes([i % 251, i // 251])).hexdigest().encode() for i in range(3000))
    a, b = E.chunks_of(text, 1024), E.chunks_of(b"some other beginning " + text, 1024)
    assert b"".join(a) == text and len(set(a) & set(b)) > 0.9 * len(a)
    assert all(len(c) <= 8 * 1024 for c in a) and all(len(c) >= 256 for c in a[:-1])
    old, E.BLOCK = E.BLOCK, 1000
    try:
        assert E.chunks_of(text, 1024) == a
    finally:
        E.BLOCK = old


def test_pipeline_filter_keeps_rows_whole(spark):
    got = E.without_copies(docs(spark))
    assert got.columns == docs(spark).columns
    texts = [(r.text or "").translate(LOWER) for r in got.collect() if r.doc_id is not None]
    assert len(set(texts)) == len({(r[1] or "").translate(LOWER) for r in rows() if r[0] is not None})


def expected_lines(min_docs=2):
    blanks = " \t\n\x0b\f\r"
    holders = defaultdict(set)
    for r in rows():
        for line in (r[1] or "").split("\n"):
            key = line.strip(blanks).translate(LOWER)
            if len(key) >= 10 and r[0] is not None:
                holders[key].add(r[0])
    out = []
    for r in rows():
        lines = (r[1] or "").split("\n")
        keys = [x.strip(blanks).translate(LOWER) for x in lines]
        kept = [x for x, k in zip(lines, keys, strict=True) if r[0] is None or len(holders.get(k, ())) < min_docs or min(holders[k]) == r[0]]
        out.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup_equals_brute_force(spark):
    assert sorted(map(tuple, line_dedup(docs(spark)).collect()), key=repr) == expected_lines()
    assert sorted(map(tuple, line_dedup(docs(spark), min_docs=3).collect()), key=repr) == expected_lines(3)
    assert line_dedup(empty(spark)).collect() == []


def test_line_dedup_runs_no_python(spark):
    plan = line_dedup(docs(spark))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_rows_of_one_doc_id_lose_their_own_lines_alone(spark):
    data = [(1, "shared line one here\nzzz"), (2, "shared line one here\nother words stay"), (2, "unique precious line\nmore unique text"), (None, "shared line one here"), (None, "shared line one here")]
    got = line_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_lines, r.n_dropped, r.kept_text) for r in got) == [
        (0, 1, 0, "shared line one here"), (0, 1, 0, "shared line one here"), (1, 2, 0, data[0][1]), (2, 2, 0, data[2][1]), (2, 2, 1, "other words stay"),
    ]
