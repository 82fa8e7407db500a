"""Toxicity by weak supervision.

Voters are lexicons and patterns of writing. Some lexicons are given, insults by theme; the others are mined: words, and
word beginnings, that labelled documents of a bounded sample make likely, a lexicon for those of one stem. A
generative model of one hidden label estimates how often each voter votes under either label by expectation
maximisation, and from what is left over how voters depend on each other; correlated voters are counted for
less. Given labels choose the mined words and give the rates that the estimate starts from and is drawn to, as so
many observations; no given label votes. A linear classifier on word features is trained on the posterior labels and
scores whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structdoc.llm.langid import id_remainder
from structdoc.llm.tokens import ALPHA, joined, span_hash, spans

#: Places of hashed features.
PLACES = 1 << 20
#: Bytes of the word beginnings that are features besides whole words; the first is the stem.
BEGINNINGS = (4, 5)
#: Mined lexicons at most, those of the most telling words.
LEXICONS = 96
#: Votes that a mined lexicon can cast, one for each text.
LEVELS = 4
#: Mined words are at least so many times as frequent under label 1.
LIFT = 20.0
#: Given lexicons: insults by theme in the languages of the corpus, as words that may have an ending.
THEMES = {
    "intellect": "idiot stupid moron imbecil dumb fool brainless dumm blöd schwachkopf crétin débil estúpid tont",
    "worth": "loser worthless pathetic useless failure nobody versager wertlos minable perdedor inútil fracasad",
    "filth": "trash scum garbage filth vermin disgusting abschaum dreck ekelhaft ordure dégoût basura escoria asqueros",
    "ridicule": "clown laughable ridiculous joke witzfigur lächerlich bouffon ridicule payas ridícul",
    "profanity": "fuck shit bitch bastard asshole crap scheiss scheiß arschloch merde salaud connard mierda puta cabrón",
    "hostility": "hate kill despise destroy hasse töte déteste tuer odio matar",
}
#: Patterns that vote: runs of marks, of one letter, masked letters, words in capitals, the second person, commands to go.
PATTERNS = [
    re.compile(p)
    for p in (
        r"[!?]{2,}", r"([^\W\d_])\1{3,}", r"[^\W\d_][*@#$]+[^\W\d_]", r"\b[^\W\d_a-z]{4,}\b(?:\W+[^\W\d_a-z]{4,}\b){2}",
        r"(?i)\byou(?:r|'re)?\b|\bdu\b|\btú\b|\btoi\b", r"(?i)\b(?:shut up|get lost|go away|halt die klappe|hau ab|tais-toi|casse-toi|cállate|vete)\b",
        r"(?i)\b(?:such|what) an? [^\W\d_]+[.!]", r"(?i)\b(?:all|these|those|diese|ces|estos) [^\W\d_]+ (?:are|sind|sont|son)\b",
    )
]
_THEMES = [re.compile(rf"(?i)(?<![^\W\d_])(?:{'|'.join(words.split())})(?:s|e|es|en|er|ed|ing|o|a|os|as)?(?![^\W\d_])") for words in THEMES.values()]
#: Given labels count as so many times themselves when rates are estimated.
DRAWN = 3.0


def features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """For blocks of texts: the text of each feature (number in the list), its place, and the place of its stem, negative for beginnings."""
    for first, block, at in joined([(t or "").lower().encode() for t in texts]):
        data = np.frombuffer(block, dtype=np.uint8)
        starts, ends = spans(data, ALPHA)
        own = np.searchsorted(at, starts, side="right") - 1 + first
        place = lambda h, n: ((h * np.uint64(2 * n + 1)) >> np.uint64(44)).astype(np.int64)
        whole = place(span_hash(data, starts, ends), 0)
        stems, of, codes, families = whole.copy(), [own], [whole], []
        for n, size in enumerate(BEGINNINGS, start=1):
            pick = np.flatnonzero(ends - starts > size)
            codes.append(place(span_hash(data, starts[pick], starts[pick] + size), n))
            of.append(own[pick])
            if n == 1:
                stems[pick] = codes[-1]
            families.append(-1 - stems[pick])
        yield np.concatenate(of), np.concatenate(codes), np.concatenate([stems, *families]), len(at) - 1


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for low in range(0, len(texts), 256):
            part = texts[low : low + 256]
            places = [np.zeros((2, 0), dtype="<i4")] * len(part)
            for own, codes, families, _ in features(part):
                order = np.lexsort((families, codes, own))
                own, codes, families = own[order], codes[order], families[order]
                once = np.r_[True, (own[1:] != own[:-1]) | (codes[1:] != codes[:-1])][: len(own)]
                own, found = own[once], np.stack([codes[once], families[once]]).astype("<i4")
                for i, of in zip(np.unique(own).tolist(), np.split(found, np.flatnonzero(np.diff(own)) + 1, axis=1), strict=False):
                    places[i] = of
            marks = [[bool(p.search(t or "")) for p in (*_THEMES, *PATTERNS)] for t in part]
            yield pa.record_batch([batch.column(0).slice(low, 256), pa.array([p.tobytes() for p in places], pa.binary()), pa.array(marks, pa.list_(pa.bool_()))], ["toxic", "places", "marks"])


def training_sample(docs: DataFrame, labels: DataFrame, per_label: int) -> list:
    """About per_label toxic documents and three times as many others, drawn by a hash of doc_id: (toxic, places and stems, marks)."""
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rates = labels.groupBy("toxic").count().select("toxic", (F.when(F.col("toxic") == 1, per_label).otherwise(3 * per_label) / F.col("count")).alias("rate"))
    drawn = labels.join(F.broadcast(rates), "toxic").where(F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(1_000_000)) < F.col("rate") * 1_000_000)
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn.select("doc_id", "toxic")), "doc_id").select("toxic", "text")  # some 4 x per_label rows
    found = rows.mapInArrow(_sampled, "toxic int, places binary, marks array<boolean>").collect()
    return [(r["toxic"], np.frombuffer(r["places"], dtype="<i4").reshape(2, -1), list(r["marks"])) for r in found]


def mine_lexicons(label: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    """For each place 2 x the lexicon that it is in, + 1 for a beginning, or -1: a lexicon for the telling features of each stem, the most telling stems first."""
    flat = np.concatenate(places, axis=1) if places else np.zeros((2, 0), dtype=np.int64)
    of = np.repeat(label, [p.shape[1] for p in places]).astype(float)
    yes, count = np.bincount(flat[0], weights=of, minlength=PLACES), np.bincount(flat[0], minlength=PLACES)
    fit = telling(yes, count, float(label.mean()))
    lift = (yes[fit] + 0.5) / (label.sum() + 1) / ((count[fit] - yes[fit] + 0.5) / ((1 - label).sum() + 1))
    family = np.zeros(PLACES, dtype=np.int64)
    family[flat[0]] = flat[1]
    lexicon, number = np.full(PLACES, -1, dtype=np.int16), {}
    for place in fit[lift >= LIFT].tolist():
        beginning = family[place] < 0
        own = number.setdefault(int(-1 - family[place] if beginning else family[place]), len(number))
        if own < LEXICONS:
            lexicon[place] = 2 * own + beginning
    return lexicon


def cast_votes(sample: list, lexicon: np.ndarray) -> np.ndarray:
    """A row for each sampled text with 1 for each vote.

    A mined lexicon casts one of LEVELS votes: for one word, for two or three, for more, or for beginnings alone. Then come the
    given lexicons and the patterns, and last the voter for label 0: no lexicon has a word of the text.
    """
    votes = np.zeros((len(sample), LEXICONS * LEVELS + len(_THEMES) + len(PATTERNS) + 1))
    for i, (_, places, marks) in enumerate(sample):
        found = lexicon[places[0]]
        words, beginnings = (np.bincount(found[(found >= 0) & (found % 2 == odd)] // 2, minlength=LEXICONS) for odd in (0, 1))
        level = np.where(words > 0, np.minimum(LEVELS - 2, np.log2(np.maximum(1, words)).astype(int)), LEVELS - 1)
        own = np.flatnonzero(words + beginnings)
        votes[i, own * LEVELS + level[own]] = 1
        votes[i, LEXICONS * LEVELS : -1] = marks
    votes[:, -1] = votes[:, : LEXICONS * LEVELS + len(_THEMES)].max(axis=1, initial=0) == 0
    return votes


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Posterior probability of label 1 for each row of votes, and how much each voter counted in the mean after correlations.

    A voter that doesn't vote abstains, which says nothing by itself: most lexicons are of one language. start, a first guess of the labels,
    gives the rates at which voters vote under either label. These count as DRAWN x as many observations in
    each estimate, which keeps the hidden label the one that start means.
    """
    drawn = [(DRAWN * s.sum() + 1, DRAWN * (s @ votes) + 0.5) for s in (start, 1 - start)]
    prior = likely = float(start.mean())
    rates = [hits / total for total, hits in drawn]
    counts = shares(votes, correlations(votes, start, rates))  # before copied voters can pass for the label
    q = _posterior(counts, rates, prior)
    for step in range(rounds):
        rates = [(s @ votes + hits) / (s.sum() + total + 0.5) for s, (total, hits) in zip((q, 1 - q), drawn, strict=True)]
        if step == rounds // 2:
            counts = shares(votes, correlations(votes, q, rates))
        prior = (q.mean() + likely * DRAWN) / (1 + DRAWN)
        q = _posterior(counts, rates, prior)
    return q, counts.sum(axis=0) / np.maximum(1, votes.sum(axis=0))


def _posterior(counts: np.ndarray, rates: list[np.ndarray], prior: float) -> np.ndarray:
    yes, no = (np.clip(r, 1e-6, 1 - 1e-6) for r in rates)
    prior = np.clip(prior, 0.001, 0.999)
    return 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + counts @ np.log(yes / no), -30, 30)))


def correlations(votes: np.ndarray, q: np.ndarray, rates: list[np.ndarray]) -> np.ndarray:
    """What correlation above 0.1 the hidden label leaves between voters."""
    rest = votes - (q[:, None] * rates[0] + (1 - q[:, None]) * rates[1])
    rest -= rest.mean(axis=0)
    norm = np.sqrt((rest**2).sum(axis=0)) + 1e-9
    shared = (rest.T @ rest) / np.outer(norm, norm)
    np.fill_diagonal(shared, 0)
    return np.maximum(0, shared - 0.1)


def shares(votes: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """For each vote how much it counts: less for every other vote in the row that it is correlated with."""
    return votes / (1 + votes @ shared)


def telling(yes: np.ndarray, count: np.ndarray, share: float, rate: float = 0.05) -> np.ndarray:
    """Places whose documents have label 1 more often than chance: likelihood ratio tests, false discoveries held at a rate."""
    tested = np.flatnonzero(count >= 2)
    y, n = yes[tested], count[tested].astype(float)
    tiny = 1e-12
    gain = y * np.log(np.maximum(y, tiny) / (n * share)) + (n - y) * np.log(np.maximum(n - y, tiny) / (n * (1 - share)))
    gain[y <= n * share] = 0
    z = np.sqrt(2 * np.maximum(gain, 0))
    chance = np.exp(-z * z / 2) / (1 + 1.2 * z)  # above the normal distribution's tail, by a little
    order = np.argsort(chance, kind="stable")
    passed = np.flatnonzero(chance[order] <= rate * np.arange(1, len(order) + 1) / max(1, len(order)))
    return tested[order[: passed[-1] + 1]] if len(passed) else tested[:0]


def train_linear(places: list[np.ndarray], q: np.ndarray, keep: int = 4096, steps: int = 400, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on posterior labels: a weight for each place, most of them 0, and the intercept."""
    own = np.repeat(np.arange(len(places)), [len(p) for p in places])
    flat = np.concatenate(places) if places else np.zeros(0, dtype=np.int64)
    yes, count = np.bincount(flat, weights=q[own], minlength=PLACES), np.bincount(flat, minlength=PLACES)
    chosen = telling(yes, count, float(np.clip(q.mean(), 1e-6, 1 - 1e-6)))[:keep]
    column = np.full(PLACES, -1, dtype=np.int64)
    column[chosen] = np.arange(len(chosen))
    hit = column[flat] >= 0
    own, col = own[hit], column[flat[hit]]
    w, b = np.zeros(len(chosen)), float(np.log(max(q.mean(), 1e-6) / max(1 - q.mean(), 1e-6)))
    m1, m2, balance = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1), 0.5 / np.where(q > 0.5, max(q.mean(), 1e-3), max(1 - q.mean(), 1e-3))
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(own, weights=w[col], minlength=len(q)), -30, 30)))
        r = (p - q) * balance / len(q)
        g = np.append(np.bincount(col, weights=r[own], minlength=len(chosen)) + ridge * w, r.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        move = 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    table = np.zeros(PLACES, dtype=np.float32)
    table[chosen] = w
    return table, b


def fit(sample: list) -> tuple[np.ndarray, float]:
    """The classifier's weights from sampled rows; without rows of both labels, the labels' mean for every text."""
    label = np.array([y for y, _, _ in sample], dtype=np.int64)
    if not len(label) or label.min() == label.max():
        return np.zeros(PLACES, dtype=np.float32), (-4.0 if not len(label) or not label[0] else 4.0)
    places = [p for _, p, _ in sample]
    votes = cast_votes(sample, mine_lexicons(label, places))
    q, _ = label_model(votes, label.astype(float))
    return train_linear([p[0] for p in places], q)


def _scored(batches: Iterator[pa.RecordBatch], model, threshold: float) -> Iterator[pa.RecordBatch]:
    table, base = model.value
    for batch in batches:
        total = np.full(batch.num_rows, base, dtype=np.float64)
        texts = batch.column(1)
        for low in range(0, batch.num_rows, 512):
            for own, codes, *_ in features(texts.slice(low, 512).to_pylist()):
                hit = table[codes] != 0
                once = np.unique(own[hit] * PLACES + codes[hit])  # presence, not counts
                np.add.at(total, low + once // PLACES, table[once % PLACES])
        score = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        yield pa.record_batch([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])


def score_toxicity(docs: DataFrame, labels: DataFrame, per_label: int = 3000, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text, ...), given labels(doc_id, toxic, ...).

    Learns from about per_label toxic rows and three times as many others among those that aren't held out (crc32 of doc_id
    as text modulo 3 is 1); labels without doc_id or toxic are ignored, and of several for a document
    the largest counts. The score of a whole text (null: empty) comes from its words alone; without
    labels of both kinds it is the same for all texts. Rows that repeat a doc_id or have none are scored
    each for itself. An empty table gives an empty result; other columns are ignored.
    """
    model = fit(training_sample(docs, labels.where(id_remainder(3) != 1), per_label))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a weight for each place: bounded
    rows = docs.select("doc_id", "text", (id_remainder(3) == 1).alias("held_out"))
    return rows.mapInArrow(lambda batches: _scored(batches, shared, threshold), "doc_id long, held_out boolean, score double, predicted int")
