"""Small tables with the awkward cases: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, rows long, key string, label string"
WORDS = "the of and river stone light green house walks under window bright seven lake north paper signal winter copper garden".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "ed", "ly"]) for _ in range(n))


def rows(seed: int = 7) -> list[tuple]:
    rng = random.Random(seed)
    passage = sentence(rng, 60)
    texts = [None, "", "", " \t\n ", "\n\n", "a", "A", "ÉCOLE é", "école É", "12 34 !!", "x" * 5000, "word " * 3000]
    texts += [sentence(rng, rng.randint(5, 120)) for _ in range(30)]
    texts += [texts[15], texts[15], texts[15].upper(), texts[20] + "\nA shared line of text\n tail", "A SHARED line of text \nother", "a shared line of text"]
    texts += [sentence(rng, 20) + " " + passage + " " + sentence(rng, 30) for _ in range(6)]
    long = sentence(rng, 8000)
    texts += [long, long + " end", long.replace(" stone", " stones", 3)]
    out = [(i, t, "en" if i % 2 else None, "s", 0, 1, 2, "k", "l") for i, t in enumerate(texts)]
    out += [out[15], out[16]]  # repeated rows
    out += [(None, texts[15], "en", "s", 0, 1, 2, "k", "l"), (None, None, None, None, None, None, None, None, None)]
    return out


def docs(spark, seed: int = 7):
    return spark.createDataFrame(rows(seed), SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
