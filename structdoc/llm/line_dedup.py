"""Line dedup with DataFrame functions only: explode normalised lines, hash them, count documents, drop, reassemble."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structdoc.llm.common import ascii_lower, hash128, keyed_join, written

#: U+0020 and U+0009 to U+000D, stripped from both ends of a line.
BLANKS = " \t\n\x0b\f\r"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's variable isn't evaluated again for each use."""
    return F.transform(F.array(value), body)[0]


def line_dedup(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text for every row of docs(doc_id, text, ...).

    A text is split at \\n; a null or empty text is one empty line. A line's key is the line without
    blanks at both ends, A-Z lower-cased; keys are compared by 128 bits of hash. Keys of at least
    min_chars code points found in at least min_docs documents lose all their lines except in the
    smallest doc_id holding it. Rows that repeat a doc_id are one document for the counts, and
    each of them loses its own lines alone: what is dropped is kept by doc_id and 128 bits of the text's hash.
    A row with a null doc_id isn't counted and loses nothing. An empty table gives an empty result;
    other columns are ignored.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("*", F.xxhash64("text").alias("row0"), F.xxhash64(F.lit(77), "text").alias("row1"))
    lines = docs.where("doc_id is not null").select("doc_id", "row0", "row1", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc_id", "row0", "row1", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    keys = written(keys.select("doc_id", "row0", "row1", "pos", *hash128(F.col("key"))), "line-keys")
    if min_docs == 2:
        shared = keys.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("rows")).where("last_doc > first_doc").drop("last_doc")
    else:
        each = keys.groupBy("h1", "h2", "doc_id").agg(F.count("*").alias("rows"))
        shared = each.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n_docs"), F.sum("rows").alias("rows")).where(F.col("n_docs") >= min_docs).drop("n_docs")
    shared = written(shared, "shared-lines")
    found = keyed_join(keys, shared, ["h1", "h2"], "rows", F.struct("doc_id", "pos"))
    row = ["doc_id", "row0", "row1"]
    drops = found.where("first_doc < doc_id").groupBy(*row).agg(F.collect_set("pos").alias("drops"))
    joined = docs.join(drops, row, "left")

    def without(all_lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("drops"))
        return F.array_join(F.transform(kept, lambda i: all_lines[i]), "\n")

    whole = F.col("drops").isNull()
    return joined.select(
        "doc_id",
        (F.length("text") - F.length(F.translate("text", "\n", "")) + 1).cast("long").alias("n_lines"),
        F.when(whole, 0).otherwise(F.size("drops")).cast("long").alias("n_dropped"),
        F.when(whole, F.col("text")).otherwise(_let(F.split("text", "\n", -1), without)).alias("kept_text"),
    )
