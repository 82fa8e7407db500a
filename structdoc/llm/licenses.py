"""License scans with DataFrame functions only: a positional index of rare license words.

A template is a notice with a label and mandatory key phrases. One pass over the corpus counts in how many texts
each word of the templates stands. In a file that holds all words of a template's first key phrase, the
two of them with the highest inverse document frequency are looked up: where each stands in the file, less its
place in the phrase, is a list of starts, and the lists are intersected. At the starts that are left the
whole phrase is verified, then the other key phrases and the share of the template's words around it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structdoc.llm.common import ascii_lower

#: Words: runs of letters and digits of A-Z, a-z and 0-9 and of everything outside ASCII, in lower-cased text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A notice as lower-cased words with single spaces; keys are phrases of it that must stand, the first of them where it is looked up. No keys: the whole text."""

    label: str
    text: str
    keys: tuple[str, ...] = ()

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def phrases(self) -> list[list[str]]:
        return [k.split() for k in self.keys or (self.text,)]


#: Phrases whose places are all reported.
BASE = (
    Template("mit", "under the mit license"),
    Template("apache-2", "apache license version 2"),
    Template("cc-by-nc", "cc by nc"),
)
#: Notices as their licenses ask for them, or as they are commonly written.
NOTICES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    Template("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", ("under the apache license", "in compliance with the license")),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("lgpl", "this library is licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl-3", "this work is licensed under the gnu affero general public license version 3", ("gnu affero general public license", "version 3")),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial license", ("creative commons attribution noncommercial",)),
    Template("cc-by-sa", "licensed under cc by sa", ("cc by sa",)),
    Template("cc0", "released into the public domain under cc0", ("public domain",)),
    Template("all-rights-reserved", "all rights reserved", ()),
)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), 1)


def _array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def document_frequency(worded: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many rows of worded(words, ...) each word of the vocabulary stands; words in none are left out."""
    held = worded.select(F.explode(F.array_intersect(_array(vocabulary), "words")).alias("word"))
    return {r[0]: r[1] for r in held.groupBy("word").agg(F.count("*")).collect()}  # a row for each word of the templates at most


def _starts(phrase: list[str], frequency: dict[str, int], words: Column, looked_up: Column) -> Column:
    """All places where the phrase stands: starts told by its two rarest words, intersected, and verified. looked_up holds (word, pos) for the words in LOOKED_UP."""
    rare = sorted(set(phrase), key=lambda w: (frequency.get(w, 0), w))[:2]

    def told(word: str) -> Column:
        own = F.filter(looked_up, lambda x: x["word"] == word)
        return F.filter(F.transform(own, lambda x: x["pos"] - phrase.index(word)), lambda s: s >= 0)

    both = reduce(F.array_intersect, map(told, rare))
    return F.array_sort(F.filter(both, lambda s: F.slice(words, s + 1, len(phrase)) == _array(phrase)))


def _stands(words: Column, phrase: list[str]) -> Column:
    """Whether the phrase stands anywhere in a short list of words."""
    return F.exists(F.transform(words, lambda _, i: F.slice(words, i + 1, len(phrase))), lambda x: x == _array(phrase))


def _matches(t: Template, starts: Column, words: Column, slack: int, min_share: float) -> Column:
    """(label, start, share) for the starts of the first key around which the rest of a template stands."""
    first, *others = t.phrases
    at = next(i for i in range(len(t.words)) if t.words[i : i + len(first)] == first)
    vocabulary = _array(sorted(set(t.words)))

    def scored(s: Column) -> Column:
        low = F.greatest(F.lit(0), s - at - slack)
        around = F.slice(words, low + 1, s - at + len(t.words) + slack - low)
        share = F.size(F.array_intersect(vocabulary, around)) / F.lit(len(set(t.words)))
        keys = reduce(Column.__and__, (_stands(around, k) for k in others), F.lit(True))
        return F.struct(F.lit(t.label).alias("label"), s.alias("start"), F.when(keys, share).otherwise(0.0).alias("share"))

    return F.filter(F.transform(starts, scored), lambda m: m["share"] >= min_share)


def _places(t: Template, starts: Column) -> Column:
    """(label, start, share) for starts of the whole text."""
    return F.transform(starts, lambda s: F.struct(F.lit(t.label).alias("label"), s.alias("start"), F.lit(1.0).alias("share")))


def license_scan(docs: DataFrame, base: tuple[Template, ...] = BASE, notices: tuple[Template, ...] = NOTICES, slack: int = 8, min_share: float = 0.5) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches for every row of docs(doc_id, text, ...).

    Words are those of the whole text with A-Z lower-cased; null is empty. n_base counts all places where a text of base stands word by
    word, overlapping ones too; first_word and last_word are the smallest and largest start, from 0, null without any. labels adds
    to the labels of base those of notices: a notice is found where its first key phrase stands, its other keys stand within slack words
    of where the notice would, and so does the share min_share or more of its distinct words. matches has (label, start, share) for
    each place, share 1 for base; score is the largest share, 0 without any. Labels are distinct, sorted and joined by commas.
    Rows that repeat a doc_id or have none are scanned each for itself; an empty table gives an empty result; other columns are
    ignored. No row leaves its partition: only the counts of the templates' words are shuffled.
    """
    worded = docs.select("doc_id", _words(F.col("text")).alias("words"))
    templates = [*base, *notices]
    vocabulary = sorted({w for t in templates for p in t.phrases for w in p})
    frequency = document_frequency(worded, vocabulary)
    first = [t.phrases[0] for t in templates]
    rare = sorted({w for p in first for w in sorted(set(p), key=lambda w: (frequency.get(w, 0), w))[:2]})
    words, looked_up, held = F.col("words"), F.col("looked_up"), F.col("held")

    worded = worded.withColumn("held", F.array_intersect(_array(sorted({w for p in first for w in p})), "words"))
    some = reduce(Column.__or__, (F.size(F.array_intersect(_array(sorted(set(p))), held)) == len(set(p)) for p in first))
    pairs = F.filter(F.transform(words, lambda w, i: F.when(w.isin(rare), F.struct(w.alias("word"), i.alias("pos")))), lambda x: x.isNotNull())
    none = F.array().cast("array<struct<word:string,pos:int>>")
    worded = worded.withColumn("looked_up", F.when(some, pairs).otherwise(none))

    def starts(p: list[str]) -> Column:
        whole = F.size(F.array_intersect(_array(sorted(set(p))), held)) == len(set(p))
        return F.when(whole, _starts(p, frequency, words, looked_up)).otherwise(F.array().cast("array<int>"))

    found = worded.select("doc_id", "words", *[starts(p).alias(f"starts{k}") for k, p in enumerate(first)])
    places = [_places(t, F.col(f"starts{k}")) for k, t in enumerate(base)]
    others = [_matches(t, F.col(f"starts{k}"), words, slack, min_share) for k, t in enumerate(notices, start=len(base))]
    kind = "array<struct<label:string,start:int,share:double>>"
    found = found.select("doc_id", F.size("words").cast("long").alias("n_words"), F.concat(F.array().cast(kind), *places).alias("base"), F.concat(F.array().cast(kind), *others).alias("other"))
    names = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda m: m["label"]))), ",")
    at = F.transform("base", lambda m: m["start"].cast("long"))
    found = found.withColumn("matches", F.concat("base", "other"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        names(F.col("base")).alias("base_labels"),
        names(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).alias("score"),
        "matches",
    )
