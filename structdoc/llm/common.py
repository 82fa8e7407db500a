"""What several operators share: the shared folder, written tables, joins that survive hot keys."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than 1/HEAVY_SHARE of the counted rows is heavy, so fewer than HEAVY_SHARE keys are.
HEAVY_SHARE = 1000
_PATHS: list[str] = []
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where it is unset and Spark runs in this process alone."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="structdoc-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _PATHS.append(path)
    return path


def drop_tables(spark: SparkSession) -> None:
    """Deletes what this process wrote to the shared folder; for when no result that reads it is needed any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _PATHS:
        path = jvm.org.apache.hadoop.fs.Path(_PATHS.pop())
        path.getFileSystem(conf).delete(path, True)


#: Rows of an Arrow batch between Spark and Python where texts are long: Spark's own 10,000 take some hundred MB in either.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """Makes Arrow batches of this session small unless its user has set their size."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def trimmed(emit: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """emit, giving freed memory back to the system now and then and at its end: Python workers outlive their tasks and would keep the most they ever had."""

    @wraps(emit)
    def run(*args, **more):
        for n, out in enumerate(emit(*args, **more)):
            yield out
            if n % 16 == 15:
                _give_back()
        _give_back()

    return run


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, is read many times, outlives executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more: what was made of them is written itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
        _PATHS.remove(df._written_path)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; lower() has a fast path for texts that are all ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def hash128(*of: Column) -> list[Column]:
    """Two independent 64-bit hashes, h1 and h2: together a key without collisions in practice."""
    return [F.xxhash64(*of).alias("h1"), F.xxhash64(F.lit(77), *of).alias("h2")]


def keyed_join(rows: DataFrame, dim: DataFrame, keys: list[str], weight: str, spread: Column) -> DataFrame:
    """Left join of rows to dim, which has one row for each key and in ``weight`` how many rows hold it.

    Keys with more than a thousandth of all counted rows are fewer than a thousand, so they are
    broadcast; their rows are dealt out by ``spread`` in the shuffle join of the other keys, where
    they find no partner. dim should be a written table: it is read three times. The light keys are hashed, not sorted, which
    takes less memory here: a task's table has its partition's share of dim, a few longs a row (10^10 rows over 2,000 partitions are some 400 MB).
    """
    total = dim.agg(F.sum(weight)).first()[0] or 0
    values = [c for c in dim.columns if c not in keys and c != weight]
    is_heavy = F.col(weight) > total / HEAVY_SHARE
    heavy = dim.where(is_heavy).select(*keys, F.struct(*values).alias("_heavy"))
    light = dim.where(~is_heavy).select(*keys, F.lit(0).alias("_deal"), F.struct(*values).alias("_light"))
    out = rows.join(F.broadcast(heavy), keys, "left")
    out = out.withColumn("_deal", F.when(F.col("_heavy").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.lit(9973)).cast("int") + 1))
    out = out.join(light.hint("shuffle_hash"), [*keys, "_deal"], "left")
    found = F.coalesce("_heavy", "_light")
    return out.select(*rows.columns, *[found[c].alias(c) for c in values])
