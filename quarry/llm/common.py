"""Helpers that several operators share: the shared work folder, written tables, word rules."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and DuckDB regular expression of a word; the same set as bytes.split() drops.
WORD = r"[^\x20\x09-\x0D]+"

HOT_ROWS = 1024  # of a key in one task of a join
MOST_KEYS = 1_000_000  # that are broadcast to pick rows
FILE_ROWS = 50_000  # of keys, in a file of a written table

_TABLES: ContextVar[list[tuple[str, DataFrame]] | None] = ContextVar("tables", default=None)  # written since ``condensed`` began


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where a local session names none, as in tests, a temporary folder is set; on a cluster
    executors would each write to a disk of their own, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, under the application's id."""
    return f"{shared_dir(spark)}/quarry/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage, keeps the columns from being computed twice, and survives lost executors. The plans
    that ended with the write are collected at once, as Spark keeps their shuffle files on disk until then.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    found = spark.read.schema(df.schema).parquet(path)
    if (tables := _TABLES.get()) is not None:
        tables.append((path, found))
    return found


def in_files(keys: DataFrame, rows: int) -> DataFrame:
    """``keys``, narrow rows that an exchange has dealt, about ``rows`` of them, in one partition for FILE_ROWS of these.

    So a small table isn't written as a file for each shuffle partition: each file costs a task's commit and, on
    local folders, processes that Hadoop forks to set its permissions, which count as large as the executor meanwhile.
    """
    return keys.coalesce(max(1, -(-rows // FILE_ROWS)))


def condensed[T](make: Callable[[], T]) -> T:
    """What ``make`` returns: one or several tables of ``written``. The others that it wrote on its way are deleted.

    So nothing that ``make`` has planned may be read later but through these.
    """
    token = _TABLES.set([])
    try:
        out = make()
        tables = _TABLES.get()
    finally:
        _TABLES.reset(token)
    left = out if isinstance(out, tuple) else (out,)
    kept = [t for t in tables if any(t[1] is x for x in left)]
    if len(kept) != len(left):
        raise ValueError("only written tables can be kept")
    for path, df in tables:
        if all(df is not x for x in left):
            _delete(df.sparkSession, path)
    if (outer := _TABLES.get()) is not None:
        outer += kept
    return out


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_work(spark: SparkSession) -> None:
    """Delete what this application has written below the shared folder."""
    _delete(spark, f"{shared_dir(spark)}/quarry/{spark.sparkContext.applicationId}")


def tasks_for(spark: SparkSession, rows: int, rows_a_task: int) -> int:
    """Tasks for work that grows with rows rather than bytes: one per ``rows_a_task``, and enough for all cores."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_a_task))


def spread_join(big: DataFrame, small: DataFrame, key: str, within: list[str], how: str = "inner") -> DataFrame:
    """``big`` joined with ``small`` (few rows a key) on ``key``, rows of a hot key dealt to several tasks.

    A key is hot with over HOT_ROWS rows of ``big``, or over one in 100,000 of them, so at most
    100,000 hot keys are broadcast. Rows of ``big`` are dealt by a hash of the columns ``within``;
    ``small``'s rows of a hot key are copied once for every share. ``how``: inner, left, left_semi or left_anti.
    """
    rows = big.count()
    if rows <= HOT_ROWS:
        return big.join(small, key, how)
    sizes = big.groupBy(key).agg(F.count("*").alias("k_n"))
    most = max(HOT_ROWS, rows // 100_000)
    hot = F.broadcast(sizes.where(F.col("k_n") > most).select(F.col(key).alias("k_hot"), F.ceil(F.col("k_n") / most).cast("int").alias("k_shares")))
    dealt = big.join(hot, F.col(key).eqNullSafe(F.col("k_hot")), "left").withColumn("k_share", F.coalesce(F.pmod(F.xxhash64(*within), F.col("k_shares")), F.lit(0)).cast("int")).drop("k_hot", "k_shares")
    copies = small.join(hot, F.col(key) == F.col("k_hot"), "left").withColumn("k_share", F.explode(F.sequence(F.lit(0), F.coalesce("k_shares", F.lit(1)) - 1))).drop("k_hot", "k_shares")
    return dealt.join(copies, [key, "k_share"], how).drop("k_share")


def picked(big: DataFrame, keys: DataFrame, on: str | Column, how: str) -> DataFrame:
    """Rows of ``big`` with (left_semi) or without (left_anti) a row of the written table ``keys``.

    Up to MOST_KEYS keys are broadcast, so that ``big``'s rows stay where they are; with more, both are exchanged.
    """
    return big.join(F.broadcast(keys) if keys.count() <= MOST_KEYS else keys, on, how)


def utf8_size(text: Column) -> Column:
    """UTF-8 bytes of a text, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def batch_rows(spark: SparkSession, rows: int) -> None:
    """Rows in an Arrow batch, so that a batch of whole texts stays within memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
