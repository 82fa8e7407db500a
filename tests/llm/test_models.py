import random
import zlib

import numpy as np
import pytest
from structdoc.llm import decontaminate as D
from structdoc.llm import langid, toxicity

from tests.llm.fixtures import docs, empty, rows

SYLLABLES = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "ein", "ung", "ver"], "cc": ["eau", "ois", "que", "ant"]}


def held(i, modulus, which):
    return zlib.crc32(("" if i is None else str(i)).encode()) % modulus == which


@pytest.fixture(scope="module")
def languages(spark):
    rng = random.Random(3)
    data = []
    for i in range(600):
        lang = rng.choice(list(SYLLABLES))
        data.append((i, " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(3)) for _ in range(rng.randint(3, 40))), lang))
    return data


def test_languages_of_held_out_texts(spark, languages):
    odd = [(1000, None, "aa"), (1001, "12 -- 3", "bb"), (None, "katomi ruka toka", None), (1002, "KATOMI RUKA tomi", None)]
    frame = spark.createDataFrame(languages + odd, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(frame, per_lang=60).collect()}
    assert len(got) == 604 and all(0 <= r.score <= 1 and r.held_out == held(r.doc_id, 5, 0) for r in got.values())
    assert np.mean([got[i].lang_pred == lang for i, _, lang in languages if got[i].held_out]) > 0.98
    assert (got[1000].lang_pred, got[1000].score, got[1001].lang_pred) == ("und", 0.0, "und")
    assert got[None].lang_pred == got[1002].lang_pred == "aa"
    kept = langid.accepted(frame, per_lang=60)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == set(got) - {1000, 1001}


def test_no_language_to_learn(spark):
    assert {r.lang_pred for r in langid.identify(docs(spark).drop("lang").selectExpr("*", "cast(null as string) lang")).collect()} == {"und"}
    assert len(langid.identify(docs(spark)).collect()) == len(rows())
    assert langid.identify(empty(spark)).collect() == []


def brute_grams(text):
    """The folded n-grams of a text as byte strings; of blanks in a row one counts."""
    data = (" " + text.lower() + " ").encode()
    folded = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in data)
    grams = {folded[i : i + n] for n in (1, 2, 3) for i in range(len(folded) - n + 1)}
    return {g for g in grams if b"  " not in g and g != b" "}


def test_every_gram_has_its_own_number(monkeypatch):
    texts = [r[1] or "" for r in rows()] + ["½ ÆØÅ ß 日本語", "a--b  c"]
    for text in texts:
        codes = langid.gram_codes(text)
        assert len(set(codes.tolist())) == len(codes) == len(brute_grams(text)) and codes.max(initial=0) < langid.PLACES
    whole = langid.gram_codes(" ".join(texts))
    monkeypatch.setattr(langid, "BLOCK", 1000)
    assert set(langid.gram_codes(" ".join(texts)).tolist()) == set(whole.tolist())


def test_scores_are_those_of_kernel_ridge_regression(languages):
    """With every sampled text a landmark the Nystroem map is exact: the scores are those of the dense kernel."""
    sample = sorted((lang, np.sort(langid.gram_codes(text)).astype("<i4").tobytes()) for _, text, lang in languages[:60])
    names, known, matrix = langid.fit(sample, landmarks=10_000)
    grams = [set(np.frombuffer(codes, dtype="<i4").tolist()) for _, codes in sample]
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    k = np.array([[kernel(a, b) for b in grams] for a in grams])
    y = np.array([names.index(lang) for lang, _ in sample])
    weight = len(y) / len(names) / np.bincount(y)[y]
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    share = weight / weight.sum()
    level = share @ target
    one = np.ones((len(y), 1))
    centred = k - one @ (share @ k)[None] - (k @ share)[:, None] @ one.T + share @ k @ share
    alpha = np.linalg.solve(centred * weight[None] + 1e-3 * len(y) * np.eye(len(y)), target - level)
    for _, text, _ in languages[60:80]:
        g = set(langid.gram_codes(text).tolist())
        row = np.array([kernel(g, b) for b in grams])
        expected = (row - share @ k - row @ share + share @ k @ share) * weight @ alpha + level
        x = langid.presence([np.array(sorted(g))], known)
        assert np.allclose(x @ matrix[:-1] / np.sqrt(len(g)) + matrix[-1], expected, atol=1e-3)


def test_numerals_are_no_letters(spark, languages):
    odd = [(2000 + i, t) for i, t in enumerate(["½", "²", "①", "Ⅷ", "٣", "日", "ª"])]
    frame = spark.createDataFrame(languages + [(i, t, None) for i, t in odd], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(frame, per_lang=60).collect()}
    assert [got[i] == "und" for i, _ in odd] == [True, True, True, True, True, False, False]
    kept = langid.accepted(frame, languages=("aa", "bb"), min_score=0.5, per_lang=60).collect()
    assert {r.lang for r in kept} - {None} == {"aa", "bb"}


def test_toxic_held_out_texts(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    bad = ["zorx", "quibbo", "narfly"]
    data, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        words = [word() for _ in range(20)] + ([rng.choice(bad) for _ in range(2)] if toxic else [])
        rng.shuffle(words)
        data.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    odd = [(5000, None), (5001, ""), (None, "zorx quibbo")]
    frame = spark.createDataFrame(data + odd, "doc_id long, text string")
    table = spark.createDataFrame(labels + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(frame, table).collect()}
    assert len(got) == 903 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == held(r.doc_id, 3, 1) for r in got.values())
    for value in (0, 1):
        assert np.mean([got[i].predicted == value for i, y in labels if y == value and got[i].held_out]) > 0.97
    assert got[5000].score == got[5001].score < 0.5 and got[None].predicted == 1


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.score_toxicity(docs(spark), none).collect()} == {0}
    assert toxicity.score_toxicity(empty(spark), none).collect() == []


def test_label_model_counts_correlated_voters_for_less():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    vote = lambda a, b: np.where(y, rng.random(4000) < a, rng.random(4000) < b)
    copied = vote(0.7, 0.2)
    votes = np.stack([vote(0.8, 0.05), vote(0.8, 0.05), vote(0.8, 0.05), copied, copied, copied], axis=1).astype(float)
    votes = np.column_stack([votes, votes[:, :3].sum(axis=1) <= 1])  # a voter for label 0
    noisy = np.where(rng.random(4000) < 0.15, ~y, y).astype(float)  # labels that are wrong in every seventh row
    q, weight = toxicity.label_model(votes, noisy)
    assert weight[:3].min() > 1.3 * weight[3:6].max()
    assert ((q > 0.5) == y).mean() > 0.88 > 0.87 > (noisy == y).mean()


def test_given_labels_do_not_vote():
    """Two rows with equal votes have equal posteriors, whatever their given labels."""
    rng = np.random.default_rng(1)
    y = rng.random(2000) < 0.4
    votes = np.stack([np.where(y, rng.random(2000) < 0.7, rng.random(2000) < 0.1) for _ in range(4)], axis=1).astype(float)
    q, _ = toxicity.label_model(votes, y.astype(float))
    for pattern in np.unique(votes, axis=0):
        assert np.ptp(q[(votes == pattern).all(axis=1)]) < 1e-12


def test_lexicons_are_the_telling_words_of_a_stem():
    texts = [("karamba ok" if i % 4 == 0 else "ok karaok plain") + f" w{i % 7}" for i in range(400)]
    label = np.array([int(i % 4 == 0) for i in range(400)])
    places = [np.zeros((2, 0), dtype=np.int64)] * 400
    for own, codes, families, _ in toxicity.features(texts):
        places = [np.stack([codes[own == i], families[own == i]]) for i in range(400)]
    lexicon = toxicity.mine_lexicons(label, places)
    votes = toxicity.cast_votes([(int(y), p, [False] * (len(toxicity.THEMES) + len(toxicity.PATTERNS))) for y, p in zip(label, places, strict=True)], lexicon)
    assert (lexicon >= 0).sum() == 2 and sorted(lexicon[lexicon >= 0].tolist()) in ([0, 1], [0, 0], [1, 1])
    assert (votes[label == 1, :-1].sum(axis=1) == 1).all() and (votes[label == 0, -1] == 1).all()


def test_alignment_by_hand():
    item = np.array([1, 2, 3, 4, 5, 6])
    assert D.align(item, np.array([9, 1, 2, 3, 4, 5, 6, 9])) == (12, 1, 7)
    assert D.align(item, np.array([1, 2, 8, 4, 5, 6])) == (9, 0, 6)
    assert D.align(item, np.array([1, 2, 3, 7, 7, 4, 5, 6])) == (10, 0, 8)
    assert D.align(item, np.array([1, 2, 4, 5, 6])) == (9, 0, 5)
    assert D.align(item, np.array([7, 8])) == (0, 0, 0)


def brute_score(item, text):
    h = np.zeros((len(item) + 1, len(text) + 1), dtype=int)
    for i in range(1, len(item) + 1):
        for j in range(1, len(text) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if item[i - 1] == text[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_equals_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(100):
        a, b = rng.integers(0, 5, rng.integers(1, 15)), rng.integers(0, 5, rng.integers(1, 25))
        assert D.align(a, b)[0] == brute_score(a.tolist(), b.tolist())


@pytest.mark.parametrize("shard_words", [2_000_000, 20])
def test_leaks_are_found_and_clean_documents_left(spark, shard_words):
    rng = random.Random(6)
    words = lambda n: [f"w{rng.randint(0, 3000)}" for _ in range(n)]
    items = [(i, words(rng.randint(10, 60))) for i in range(20)]
    data, expected = [], set()
    for i in range(60):
        body = words(150)
        if i < 40:
            copy = list(items[i % 20][1])
            if i >= 20:
                copy[3] = "changed"
                copy[7:7] = ["more"]
            body[40:40] = copy
            expected.add((i, i % 20))
        data.append((i, " ".join(body).upper() if i % 3 else " ".join(body)))
    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in items] + [(90, None), (91, ""), (92, "w1 w2"), (93, "short: one; TWO three, four"), (94, "日本語の文")], "item_id long, text string")
    odd = [(102, "W1 w2!"), (103, "w1 w2 w3"), (104, "before short one two three four behind"), (105, "short one two three five"), (106, "前の日本語の文と"), (107, "日本の語文")]
    expected |= {(102, 92), (104, 93), (106, 94)}
    frame = spark.createDataFrame(data + odd + [(None, data[0][1]), (100, None), (101, "")], "doc_id long, text string")
    got = D.contaminated(frame, benchmark, shard_words=shard_words).collect()
    assert {(r.doc_id, r.item_id) for r in got} == expected | {(None, 0)} and all(0.5 <= r.score <= 1 for r in got)
    clean = D.without_contaminated(frame, benchmark, shard_words=shard_words)
    assert sorted(r.doc_id for r in clean.collect()) == [*range(40, 60), 100, 101, 103, 105, 107]


def test_edited_copies_equal_exhaustive_alignment(spark):
    """Every document against every item by plain alignment: what is found is right, and at least nine tenths of it are found."""
    rng = random.Random(16)
    words = lambda n: [f"w{rng.randint(0, 400)}" for _ in range(n)]
    items = [(i, words(rng.randint(12, 30))) for i in range(12)]
    data = []
    for i in range(60):
        copy = list(items[i % 12][1])
        for _ in range(rng.randint(0, len(copy) // 3)):  # words replaced, dropped and put in
            at = rng.randrange(len(copy))
            copy[at : at + 1] = rng.choice([[], ["new"], [copy[at], "more"]])
        data.append((i, words(rng.randint(0, 30)) + copy + words(rng.randint(0, 30))))
    number = {w: i for i, w in enumerate(sorted({w for _, t in items + data for w in t}))}
    code = lambda t: [number[w] for w in t]
    best = {(i, j): brute_score(code(item), code(text)) / (2 * len(item)) for i, text in data for j, item in items}
    expected = {k for k, score in best.items() if score >= 0.5}
    frame = lambda rows, key: spark.createDataFrame([(i, " ".join(t)) for i, t in rows], f"{key} long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in D.contaminated(frame(data, "doc_id"), frame(items, "item_id")).collect()}
    assert set(got) <= expected and len(expected) > 50 and len(got) >= 0.9 * len(expected)
    assert all(abs(score - best[k]) < 1e-9 for k, score in got.items() if best[k] > 0.7)


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(docs(spark), none).collect() == [] and D.contaminated(empty(spark), none).collect() == []
    assert D.without_contaminated(docs(spark), none).count() == len(rows())


@pytest.mark.parametrize(("n", "score"), [(3, 1.0), (5, 1.0), (7, 0.8), (7, 0.75), (12, 0.7), (40, 0.7), (250, 0.7)])
def test_recall_by_the_length_of_items(spark, n, score):
    """Of edited copies whose best alignment reaches the score, at least nine tenths are found, short items too."""
    rng = random.Random(n)
    words = lambda k: [f"v{rng.randint(0, 2000)}" for _ in range(k)]
    items = [(i, words(n)) for i in range(8)]
    data = []
    for i in range(48):
        copy = list(items[i % 8][1])
        for _ in range(rng.randint(0, 1 + n // 12)):
            at = rng.randrange(len(copy))
            copy[at : at + 1] = rng.choice([[], ["new"]]) if n > 3 and rng.random() < 0.5 else [copy[at]]
        data.append((i, words(10) + copy + words(10)))
    frame = lambda rows, key: spark.createDataFrame([(i, " ".join(t)) for i, t in rows], f"{key} long, text string")
    found = {(r.doc_id, r.item_id) for r in D.contaminated(frame(data, "doc_id"), frame(items, "item_id"), short_threshold=score).collect()}
    number = {w: i for i, w in enumerate(sorted({w for _, t in items + data for w in t}))}
    best = {i: brute_score([number[w] for w in items[i % 8][1]], [number[w] for w in text]) / (2 * n) for i, text in data}
    wanted = {(i, i % 8) for i in best if best[i] >= score}
    assert len(wanted) >= 8 and len(found & wanted) >= 0.9 * len(wanted)


def test_repeated_items_and_seeds_that_many_items_share(spark):
    common = "this phrase stands in every item of all"
    items = [(i, f"{common} with word{i} and other{i} and third{i} behind") for i in range(150)] + [(7, "again another text for seven that is long enough to count")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame([(1, items[3][1]), (2, common), (3, items[-1][1]), (4, items[7][1])], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(table, benchmark, threshold=0.9).collect()}
    assert got == {(1, 3), (3, 7), (4, 7)}


def test_toxicity_scores_equal_sums_over_words(spark):
    """The query's scores against the classifier's weights added up word by word, and held-out labels that change nothing."""
    import re
    import zlib

    from structdoc.llm.tokens import span_hash

    rng = random.Random(9)
    bad = ["idiot", "moron", "clowns"]
    table, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        words = [rng.choice(["river", "stone", "Lake", "élan", "walks", "under", "the", "ab", "abcd", "abcdef"]) for _ in range(rng.randint(3, 30))] + ([rng.choice(bad)] * rng.randint(1, 3) if toxic else [])
        rng.shuffle(words)
        table.append((i, " ".join(words) + rng.choice(["", "!!", " 12 a_b"]), "k"))
        labels.append((i, int(toxic), 1))
    table += [(900, None, "k"), (901, "", "k"), (902, "x" * 200_000 + " idiot", "k"), (None, "idiot", "k")]
    frame, known = spark.createDataFrame(table, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int, text int")
    turned = [(i, (1 - t) if zlib.crc32(str(i).encode()) % 3 == 1 else t, x) for i, t, x in labels]
    got = toxicity.score_toxicity(frame, known).collect()
    again = toxicity.score_toxicity(frame, spark.createDataFrame(turned, "doc_id long, toxic int, text int")).collect()
    assert {r.doc_id: r.score for r in got} == {r.doc_id: r.score for r in again}
    weights, base = toxicity.fit(toxicity.training_sample(frame, known.where(toxicity.id_remainder(3) != 1), 3000))

    def place(piece, n):
        h = span_hash(np.frombuffer(piece, dtype=np.uint8), np.array([0]), np.array([len(piece)]))
        return int((h * np.uint64(2 * n + 1) >> np.uint64(44))[0])

    for r in got:
        text = next(t for i, t, _ in table if i == r.doc_id) or ""
        places = set()
        for word in re.findall(rb"[A-Za-z\x80-\xff]+", text.lower().encode()):
            places |= {place(word, 0)} | {place(word[:size], n) for n, size in enumerate(toxicity.BEGINNINGS, start=1) if len(word) > size}
        total = base + sum(float(weights[p]) for p in sorted(places))
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(total, -30, 30)))) < 1e-6
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) or r.doc_id is None
        assert r.predicted == int(r.score >= 0.7)
    caught = [r.predicted for r in got if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 5 == 0 and r.held_out]
    assert sum(caught) >= 0.9 * len(caught)


def test_posteriors_equal_products_by_hand():
    rng = np.random.default_rng(4)
    counts, rates, prior = rng.random((50, 6)) * (rng.random((50, 6)) < 0.4), [rng.random(6), rng.random(6)], 0.3
    got = toxicity._posterior(counts, rates, prior)
    for row, q in zip(counts, got, strict=True):
        yes, no = prior, 1 - prior
        for c, y, n in zip(row, *rates, strict=True):
            yes, no = yes * y**c, no * n**c
        assert abs(q - yes / (yes + no)) < 1e-9
