"""Reading of the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables whose rows are long texts, so that a scan takes far more time than reading.
HEAVY = ("documents", "pages")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if its files give fewer splits than there are cores; large inputs have more and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in HEAVY else df


#: Bytes of files for each part where rows grow to several times their size and are kept.
MOST_PART = 8 << 20


def parts(spark: SparkSession, sf_dir: str, name: str, most: int = MOST_PART) -> int:
    """How many parts of a bounded size a table's files make, at least one for each core; the files are only listed."""
    size = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{sf_dir}/{name}.parquet").agg(F.sum("length")).first()[0]
    return max(spark.sparkContext.defaultParallelism, -(-(size or 0) // most))


def fine(spark: SparkSession, sf_dir: str, name: str, most: int = MOST_PART) -> DataFrame:
    """A table in parts of a bounded size. Splits of compressed files hold many times what their bytes tell, and no more of them come with more input up to the most that a split takes."""
    df, n = spark.read.parquet(f"{sf_dir}/{name}.parquet"), parts(spark, sf_dir, name, most)
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
