"""A corpus pipeline: five operators of structdoc.llm, each on what the stage before it kept.

A stage takes (spark, docs, sf_dir), with docs in the columns of the table documents, and returns a
DataFrame that is written as Parquet and read again as the next stage's docs. The stages that filter
return the rows they keep with all their columns; the last returns a row for each document kept.
Stages treat null, empty, repeated and missing rows as their operators do.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from structdoc.llm.common import shared_path, small_batches
from structdoc.llm.decontaminate import without_contaminated
from structdoc.llm.exact_dedup import without_copies
from structdoc.llm.langid import accepted
from structdoc.llm.pieces import digest_pieces
from structdoc.llm.simhash import without_near_copies

#: Languages of the corpus, and the least score at which a document counts as one of them.
LANGUAGES, LEAST_SCORE = ("de", "en", "es", "fr"), 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the corpus's languages; texts without letters, in other languages or of an unclear one go."""
    small_batches(spark)  # for all stages
    return accepted(docs, LANGUAGES, LEAST_SCORE)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts the document with the largest doc_id."""
    return without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of documents linked by near fingerprints and a similarity of 0.8 or more of their 5-word shingles the one with the smallest doc_id."""
    return without_near_copies(docs, words_in_shingle=5, similarity=0.8)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item or an edited copy of one."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes what is left: counts and digests of ids and decoded text for each document."""
    return digest_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("benchmark_leaks", benchmark_leaks), ("pieces", pieces)]

#: The classifier, the alignment and the tokenizer have no SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
