import re

import numpy as np
import xxhash
from structdoc.llm import simhash as S
from structdoc.llm.components import components

from tests.llm.fixtures import docs, empty, rows


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_dedup_equals_brute_force(spark):
    data = rows()
    fps = [brute_fingerprint(r[1]) for r in data]
    parent = list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            near = (fps[i] ^ fps[j]).bit_count() <= 3 or data[i][0] == data[j][0]
            if near and data[i][0] is not None and data[j][0] is not None:
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(data):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    expected = sorted(((r[0], f"{fps[i]:016x}", least[find(i)] if r[0] is not None else None) for i, r in enumerate(data)), key=repr)
    assert sorted(map(tuple, S.near_dedup(docs(spark)).collect()), key=repr) == expected
    assert S.near_dedup(empty(spark)).collect() == []


def test_buckets_lose_no_pair():
    rng, masks = np.random.default_rng(3), S.bucket_masks(3)
    for _ in range(500):
        a = int(rng.integers(0, 2**63))
        b = a
        for bit in rng.choice(64, 3, replace=False).tolist():
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)


def test_large_buckets_give_the_same_components(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 5, dtype=np.uint64)
    flips = lambda: sum(np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64) for _ in range(2))
    fps = np.unique(np.concatenate([b ^ flips() for b in base]))
    reps = spark.createDataFrame([(int(x.view(np.int64)), i) for i, x in enumerate(fps)], "fp long, rep long")
    all_at_once = sorted(map(tuple, components(S.near_links(reps)).collect()))
    assert all_at_once and all_at_once == sorted(map(tuple, components(S.near_links(reps, most=16)).collect()))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(300) if i % 100 != 99], "child long, parent long")
    got = {r.child: r.parent for r in components(edges).collect()}
    assert got == {i: i // 100 * 100 for i in range(300) if i % 100}


def test_filter_keeps_one_of_each_component(spark):
    kept = {r.doc_id for r in S.without_near_copies(docs(spark), words_in_shingle=3, similarity=None).collect() if r.doc_id is not None}
    assert kept == {r.component_id for r in S.near_dedup(docs(spark)).collect() if r.doc_id is not None}
