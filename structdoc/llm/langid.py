"""Language identification by a string kernel.

The blended-spectrum presence kernel of two texts is the number of byte n-grams of length 1 to 3 that both hold,
divided by the root of the product of their own numbers. Texts are lower-cased and ASCII bytes other than letters are one
blank, so that every n-gram has a number of its own and nothing is hashed. Ridge regression, one language
against the rest, works on the Nystroem map of that kernel for a bounded set of landmark texts. The kernel is linear
in the presence vectors, so landmarks, map and weights multiply to one matrix with a row for each n-gram of the
landmarks, and texts are scored by batched matrix products of presence vectors with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structdoc.llm.common import trimmed

LETTER = regex.compile(r"\p{L}")
BLOCK = 1 << 20
#: Entries of the presence vectors that are scored at a time.
ENTRIES = 1 << 22
#: Numbers of folded bytes: 0 for blanks, then a to z, then the bytes outside ASCII.
FOLD = np.array([c - 64 if 65 <= c <= 90 else c - 96 if 97 <= c <= 122 else c - 101 if c >= 128 else 0 for c in range(256)], dtype=np.int32)
SYMBOLS = 155
#: n-grams of one, two and three symbols are numbered one after the other.
STARTS = (0, SYMBOLS, SYMBOLS + SYMBOLS**2)
PLACES = SYMBOLS + SYMBOLS**2 + SYMBOLS**3


@lru_cache(maxsize=1)
def _last_seen() -> np.ndarray:
    return np.zeros(PLACES, dtype=np.int32)


def distinct(codes: np.ndarray) -> np.ndarray:
    """The codes, each once: of equal ones that which was noted last."""
    seen, order = _last_seen(), np.arange(len(codes), dtype=np.int32)
    seen[codes] = order
    return codes[seen[codes] == order]


def gram_codes(text: str) -> np.ndarray:
    """The numbers of the distinct n-grams of length 1 to 3 of a whole text."""
    data, parts = b" " + text.lower().encode() + b" ", []
    for low in range(0, len(data), BLOCK):
        b = FOLD[np.frombuffer(data[low : low + BLOCK + 2], dtype=np.uint8)]
        blank = b == 0
        twice = blank[1:] & blank[:-1]  # of blanks in a row one counts
        two = b[:-1] * SYMBOLS + b[1:]
        three = two[:-1] * SYMBOLS + b[2:]
        parts.append(distinct(np.concatenate([b[~blank], two[~twice] + STARTS[1], three[~(twice[:-1] | twice[1:])] + STARTS[2]])))
    return parts[0] if len(parts) == 1 else distinct(np.concatenate(parts))


@trimmed
def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = [np.sort(gram_codes(value.as_py())).astype("<i4").tobytes() for value in batch.column(1)]
        yield pa.record_batch([batch.column(0), pa.array(codes, pa.binary())], ["lang", "grams"])


def id_remainder(modulus: int):
    """crc32 of doc_id as text, modulo; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def training_sample(docs: DataFrame, per_lang: int) -> list[tuple[str, bytes]]:
    """About per_lang labelled documents of each language, taken by a hash of doc_id: their languages and n-grams."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & F.col("doc_id").isNotNull())
    rates = labelled.groupBy("lang").count().select("lang", (F.lit(per_lang) / F.col("count")).alias("rate"))
    drawn = labelled.join(F.broadcast(rates), "lang").where(F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1_000_000)) < F.col("rate") * 1_000_000)
    rows = drawn.select("lang", "text").mapInArrow(_grams, "lang string, grams binary").collect()
    return sorted((r["lang"], bytes(r["grams"])) for r in rows)


def presence(texts: list[np.ndarray], known: np.ndarray) -> np.ndarray:
    """A row for each text with 1 for each of the known n-grams, a sorted list, that it holds."""
    x = np.zeros((len(texts), len(known)), dtype=np.float32)
    for i, codes in enumerate(texts):
        at = np.searchsorted(known, codes)
        at[at == len(known)] = 0
        x[i, at[known[at] == codes]] = 1
    return x


def fit(sample: list[tuple[str, bytes]], landmarks: int = 192, ridge: float = 1e-3) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The languages, the n-grams of the landmarks, and the matrix by which presence vectors over these are scored; its last row is the intercept."""
    names = sorted({lang for lang, _ in sample})
    if not names:
        return [], np.zeros(0, dtype=np.int32), np.zeros((1, 0), dtype=np.float32)
    texts = [np.frombuffer(codes, dtype="<i4") for _, codes in sample]
    y = np.array([names.index(lang) for lang, _ in sample])
    each = max(1, landmarks // len(names))
    chosen = np.concatenate([np.flatnonzero(y == c)[:: max(1, int((y == c).sum()) // each)][:each] for c in range(len(names))])
    known = np.unique(np.concatenate([texts[i] for i in chosen]))
    norm = lambda of: np.sqrt(np.maximum(1, np.array([len(t) for t in of])))[:, None]
    marks = presence([texts[i] for i in chosen], known) / norm([texts[i] for i in chosen]).astype(np.float32)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > values.max() * 1e-8
    to_map = vectors[:, keep] / np.sqrt(values[keep])  # kernel values with the landmarks -> Nystroem features
    step = max(1, ENTRIES // len(known))
    kernel = np.concatenate([(presence(texts[a : a + step], known) @ marks.T) / norm(texts[a : a + step]) for a in range(0, len(texts), step)])
    z = kernel @ to_map
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    weight = (len(y) / len(names) / np.bincount(y, minlength=len(names)))[y][:, None]
    middle = (z * weight).sum(axis=0) / weight.sum()
    level = (target * weight).sum(axis=0) / weight.sum()
    zc = z - middle
    w = np.linalg.solve((zc * weight).T @ zc + ridge * len(y) * np.eye(z.shape[1]), (zc * weight).T @ (target - level))
    matrix = marks.T.astype(np.float64) @ (to_map @ w)
    return names, known, np.vstack([matrix, level - middle @ w]).astype(np.float32)


def predict(texts: pa.Array, model: tuple[list[str], np.ndarray, np.ndarray]) -> tuple[list[str], list[float]]:
    """The language and score of each text."""
    names, known, matrix = model
    lang, score = [], []
    step = max(1, min(512, ENTRIES // max(1, len(known))))
    for low in range(0, len(texts), step):
        part = texts.slice(low, step).to_pylist()
        if not names:
            lang += ["und"] * len(part)
            score += [0.0] * len(part)
            continue
        lettered = np.array([bool(text and LETTER.search(text)) for text in part])
        codes = [gram_codes(text) if has else np.zeros(0, dtype=np.int32) for text, has in zip(part, lettered, strict=True)]
        size = np.sqrt(np.maximum(1, np.array([len(c) for c in codes], dtype=np.float32)))[:, None]
        f = (presence(codes, known) @ matrix[:-1]) / size + matrix[-1]
        e = np.exp(6 * (f - f.max(axis=1, keepdims=True)).astype(np.float64))
        lang += [names[b] if k else "und" for b, k in zip(f.argmax(axis=1).tolist(), lettered.tolist(), strict=True)]
        score += np.where(lettered, 1 / e.sum(axis=1), 0.0).tolist()
    return lang, score


@trimmed
def _predict(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, score = predict(batch.column(1), model.value)
        yield pa.record_batch([batch.column(0), batch.column(2), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])


@trimmed
def _accept(batches: Iterator[pa.RecordBatch], model, text: int, languages: frozenset[str] | None, min_score: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = zip(*predict(batch.column(text), model.value), strict=True)
        yield batch.filter(pa.array([lang != "und" and score >= min_score and (languages is None or lang in languages) for lang, score in found], pa.bool_()))


def trained(docs: DataFrame, per_lang: int, landmarks: int):
    """The model, learnt from documents that aren't held out, for the executors: at most languages x PLACES numbers."""
    model = fit(training_sample(docs.where(id_remainder(5) != 0).select("doc_id", "text", "lang"), per_lang), landmarks)
    return docs.sparkSession.sparkContext.broadcast(model)


def identify(docs: DataFrame, per_lang: int = 500, landmarks: int = 192) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs(doc_id, text, lang, ...).

    Learns from text and lang of a sample of about per_lang documents of each language among those that
    aren't held out (crc32 of doc_id as text modulo 5 is 0); documents without lang, text, letters or
    doc_id aren't learnt from. Predicts from the whole text alone. ``und`` with score 0 is given to texts that are null or
    have no letter (Unicode category L), and to all if nothing could be learnt. Rows that repeat a doc_id are predicted each
    for itself. An empty table gives an empty result; other columns are ignored.
    """
    held_out = (id_remainder(5) == 0).alias("held_out")
    shared = trained(docs, per_lang, landmarks)
    return docs.select("doc_id", "text", held_out).mapInArrow(lambda batches: _predict(batches, shared), "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, languages: tuple[str, ...] | None = None, min_score: float = 0.0, per_lang: int = 500, landmarks: int = 192) -> DataFrame:
    """The rows of docs, with all their columns, for which identify() gives one of the languages (None: any but ``und``) with at least min_score."""
    shared, text = trained(docs, per_lang, landmarks), docs.columns.index("text")
    wanted = None if languages is None else frozenset(languages)
    return docs.mapInArrow(lambda batches: _accept(batches, shared, text, wanted, min_score), docs.schema)
