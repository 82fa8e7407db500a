import hashlib
import random

import corpus_pipeline
import public_tokenizers
import sentencepiece

from tests.llm.fixtures import SCHEMA, sentence
from tests.llm.test_jaccard import brute_components


def table():
    """Rows for each stage to drop or keep: no letters, copies, edited copies, leaks whole or edited, repeats, nulls."""
    rng = random.Random(21)
    items = [(i, " ".join(f"q{i}x{rng.randrange(900)}" for _ in range(20))) for i in range(3)]
    texts = [None, "", "12 34 !!", "a", *(sentence(rng, rng.randint(40, 120)) for _ in range(12))]
    texts += [texts[4], texts[5].upper()]
    for i in (6, 7, 8):
        edited = texts[i].split()
        edited[len(edited) // 2] = "edited"
        texts.append(" ".join(edited))
    texts += [texts[9] + " " + items[0][1], items[1][1].upper(), texts[10] + " " + items[2][1].replace(" ", " more ", 1) + " " + texts[11]]
    out = [(i, t, "en", "s", 0, 1, 2, "k", "l") for i, t in enumerate(texts)]
    out += [out[12], (None, texts[13], "en", "s", 0, 1, 2, "k", "l"), (None, "a row without a name", None, "s", 0, 1, 2, "k", "l")]
    return out, items


def plain(data, items):
    """The five stages without Spark: a Python loop for each; one language, so only texts without letters have none."""
    low = lambda r: (r[1] or "").lower()
    rows = [r for r in data if any(c.isalpha() for c in low(r))]
    keep = {}
    for r in rows:
        keep[low(r)] = max(keep.get(low(r), -1), -1 if r[0] is None else r[0])
    rows = [r for r in rows if keep[low(r)] == (-1 if r[0] is None else r[0])]
    of, linked = brute_components(rows)
    assert linked
    rows = [r for r in rows if r[0] is None or of[r[0]] == r[0]]

    def leaks(text, item):  # the share of the item's words that stand in the text in order
        best = [0] * (len(text) + 1)
        for word in item:
            best = [0, *(max(best[j + 1], best[j] + (word == t)) for j, t in enumerate(text))]
            for j in range(len(text)):
                best[j + 1] = max(best[j], best[j + 1])
        return best[-1] / len(item) > 0.5

    rows = [r for r in rows if not any(leaks(low(r).split(), t.lower().split()) for _, t in items)]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = []
    for r in rows:
        ids = library.encode(r[1])
        out.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_run_equals_the_plain_stages(spark, tmp_path):
    data, items = table()
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == plain(data, items)
