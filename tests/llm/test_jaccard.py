import random
import re

import pytest
from structdoc.llm import jaccard as J
from structdoc.llm import simhash as S
from structdoc.llm.simhash import near_dedup

from tests.llm.fixtures import docs, empty, rows, sentence


def brute_shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_components(data):
    """doc_id -> the smallest doc_id of its component, and the pairs that are similar."""
    data = [r for r in data if r[0] is not None]
    sets, parent, linked = [brute_shingles(r[1]) for r in data], {r[0]: r[0] for r in data}, set()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) * 5 >= 4 * len(a | b):
                linked.add((data[j][0], data[i][0]))
                x, y = sorted((find(data[i][0]), find(data[j][0])))
                parent[y] = x
    return {i: find(i) for i in parent}, linked


def edited():
    """Originals of 30 to 400 words, copies with words replaced here and there, chains of copies, and texts near the bound."""
    rng, out = random.Random(11), []
    shared = sentence(rng, 25)
    for _ in range(40):
        words = (sentence(rng, rng.randint(30, 400)) + (" " + shared if rng.random() < 0.5 else "")).split()
        out.append(" ".join(words))
        for _ in range(rng.randint(0, 4)):
            for _ in range(rng.randint(1, 1 + len(words) // 45)):
                words[rng.randrange(len(words))] = "edited%d" % rng.randrange(50)
            out.append(" ".join(words))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("most", [4, J.MOST_ROWS])
def test_all_near_copies_are_linked_and_no_others(spark, most):
    data = edited()
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    expected, linked = brute_components(data)
    got = {r.doc_id: r.component_id for r in J.similar(frame, most=most).collect()}
    assert got == expected and len(linked) > 30
    by_bits = {r.doc_id: r.component_id for r in near_dedup(frame).collect()}
    assert sum(by_bits[a] == by_bits[b] for a, b in linked) < len(linked) / 2  # what 3 of 64 bits would find


def test_awkward_rows(spark):
    expected, _ = brute_components(rows())
    assert {r.doc_id: r.component_id for r in J.similar(docs(spark)).collect()} == expected
    kept = S.without_near_copies(docs(spark))
    assert kept.columns == docs(spark).columns
    want = sorted((r for r in rows() if r[0] is None or expected[r[0]] == r[0]), key=repr)
    assert sorted(map(tuple, kept.collect()), key=repr) == want
    assert J.similar(empty(spark)).collect() == [] and J.without_similar(empty(spark)).collect() == []
