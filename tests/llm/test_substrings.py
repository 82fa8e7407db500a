import random

from structdoc.llm.substring_dedup import Automaton, match_shard, substring_dedup

from tests.llm.fixtures import docs, empty, rows


def brute(data, n):
    words = [(r[0], (r[1] or "").encode().split()) for r in data]
    first = {}
    for i, w in words:
        for j in range(len(w) - n + 1):
            if i is not None:
                k = tuple(w[j : j + n])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        gone = set()
        for j in range(len(w) - n + 1):
            if i is not None and first[tuple(w[j : j + n])] < i:
                gone.update(range(j, j + n))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(w) - len(kept), b" ".join(kept).decode()))
    return sorted(out, key=repr)


def test_substring_dedup_equals_brute_force(spark):
    expected = brute(rows(), 50)
    assert sum(r[2] for r in expected) > 1000
    assert sorted(map(tuple, substring_dedup(docs(spark)).collect()), key=repr) == expected
    assert sorted(map(tuple, substring_dedup(docs(spark), most_contexts=1).collect()), key=repr) == expected
    assert substring_dedup(empty(spark)).collect() == []


def test_short_windows_and_repeats(spark):
    rng = random.Random(5)
    data = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(40)]
    got = substring_dedup(spark.createDataFrame(data, "doc_id long, text string"), window_words=8, seed_words=4)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(data, 8)


def test_rows_that_repeat_a_doc_id_with_other_texts(spark):
    shared = " ".join(f"w{i}" for i in range(60))
    data = [(1, shared), (2, "x y " + shared), (2, shared + " z"), (None, shared)]
    got = substring_dedup(spark.createDataFrame(data, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(data, 50)


def test_matching_statistics():
    rng = random.Random(2)
    for _ in range(50):
        seen = [[rng.choice("abc") for _ in range(rng.randint(1, 15))] for _ in range(4)]
        automaton = Automaton()
        for s in seen:
            automaton.add(s)
        text = [rng.choice("abc") for _ in range(20)]
        parts = {tuple(s[i:j]) for s in seen for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        longest = [max((n for n in range(1, i + 2) if tuple(text[i + 1 - n : i + 1]) in parts), default=0) for i in range(20)]
        assert automaton.statistics(text, 99) == longest
        assert automaton.statistics(text, 3) == [min(3, x) for x in longest]


def test_shard_marks_windows_of_smaller_documents():
    assert match_shard([(1, 10, "a b c d"), (2, 20, "z b c d"), (2, 30, "a b c y"), (3, 40, "a b c d")], 3) == [(20, 2), (30, 1), (40, 3)]


def morse(n, a, b):
    return "".join(a if i.bit_count() % 2 == 0 else b for i in range(n))


def test_words_that_fool_a_polynomial_hash_stay_apart(spark):
    words = [f"w{i}" for i in range(60)]
    data = [(i, " ".join(words[:31] + [morse(2048, *ab)] + words[32:])) for i, ab in enumerate(("ab", "ba"))]
    got = substring_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert [r.n_removed for r in got] == [0, 0]
    short = [(i, " ".join(morse(64, *ab) for ab in (("ab", "ba") * 30)[i : i + 60])) for i in range(2)]  # as words they differ by one place only
    got = substring_dedup(spark.createDataFrame(short, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == brute(short, 50)


def test_span_hashes_tell_spans_apart():
    import numpy as np
    from structdoc.llm.tokens import words

    spans = [b"a" * n for n in range(1, 200)] + [b"b" + b"a" * n for n in range(1, 200)] + ["é".encode(), b"x\0", b"x\0\0"]
    starts, ends, h = words(b" ".join(spans))
    assert len(np.unique(h)) == len(spans) and (ends - starts).tolist() == list(map(len, spans))
    assert (words(b"\t".join(spans[::-1]))[2][::-1] == h).all()
