"""Writing documents: Parquet, JSON lines, HTML files as text, requests to a service; media as data addresses."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

MOST_MEDIA_BYTES = 18 << 20


def write_documents(articles: DataFrame, blocks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    articles.write.mode(mode).parquet(f"{path}/articles")
    blocks.write.mode(mode).parquet(f"{path}/blocks")


def write_json(articles: DataFrame, blocks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A JSON line for each document with its blocks in order."""
    ordered = F.array_sort(F.collect_list(F.struct("block_idx", *[c for c in blocks.columns if c not in ("doc_id", "block_idx")])))
    articles.join(blocks.groupBy("doc_id").agg(ordered.alias("blocks")), "doc_id", "left").write.mode(mode).json(path)


def write_html(rendered: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A text file part for each group of documents, partitioned by name."""
    rendered.select("filename", F.col("html").alias("value")).write.mode(mode).partitionBy("filename").text(path)


def data_urls(files: DataFrame) -> DataFrame:
    """Images read by spark.read.format("binaryFile") as data addresses; others and too large ones are left out."""
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    mime = F.when(kind.isin("jpg", "jpeg"), "image/jpeg").when(kind.isin("png", "gif", "webp", "bmp"), F.concat(F.lit("image/"), kind)).when(kind == "svg", "image/svg+xml")
    small = files.where((F.col("length") <= MOST_MEDIA_BYTES) & mime.isNotNull())
    return small.select("path", F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64("content")).alias("data_url"))


def post_documents(documents: DataFrame, url: str, timeout: float = 30.0) -> int:
    """Sends each row as a JSON object by POST, from the executors; how many were sent. A service that answers with an error fails the job.

    A task that is tried again sends its rows again, so the service should take a doc_id twice.
    """

    def send(rows: Iterator[Row]) -> None:
        for row in rows:
            body = json.dumps(row.asDict(recursive=True), default=str).encode()
            with urlopen(Request(url, body, {"Content-Type": "application/json"}), timeout=timeout) as answer:
                answer.read()
            sent.add(1)

    sent = documents.sparkSession.sparkContext.accumulator(0)
    documents.foreachPartition(send)
    return sent.value
