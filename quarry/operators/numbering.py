"""Running numbers over arrival order, and retention by age.

Numbers are global per batch, so they need a rank over all rows of it. Rows are ranged over
partitions by their order, counted per partition, and numbered within; no task sees a whole batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def ranked(rows: DataFrame, order: list[Column], name: str, by: str | None = None, slices: int | None = None) -> DataFrame:
    """``rows`` with ``name``: 1, 2, ... by ``order``, within each value of ``by`` if named.

    The order must be total for a fixed result.
    """
    n = slices or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *([F.col(by)] if by else []), *order).withColumn("k_part", F.spark_partition_id())
    keys = [by] if by else []
    own = F.row_number().over(W.partitionBy("k_part", *keys).orderBy(*order))
    numbered = dealt.withColumn("k_own", own)
    counts = dealt.groupBy("k_part", *keys).agg(F.count("*").alias("k_n"))
    over = (W.partitionBy(by) if by else W.partitionBy(F.lit(0))).orderBy("k_part")
    first = counts.withColumn("k_first", F.sum("k_n").over(over) - F.col("k_n")).drop("k_n")
    if by:
        joined = numbered.join(first.withColumnRenamed(by, "k_by"), (F.col(by).eqNullSafe(F.col("k_by"))) & (numbered["k_part"] == first["k_part"])).drop("k_by", first["k_part"])
    else:
        joined = numbered.join(first, "k_part")
    return joined.withColumn(name, F.col("k_first") + F.col("k_own")).drop("k_part", "k_own", "k_first")


def assign_seq(records: DataFrame, order: list[Column]) -> DataFrame:
    """Rows without a sequence number (null or 0) get the next ones, in ``order``."""
    has = F.coalesce("_seq", F.lit(0)) > 0
    top = records.agg(F.coalesce(F.max("_seq"), F.lit(0)).alias("k_top"))  # one row
    fresh = ranked(records.where(~has), order, "k_number").join(F.broadcast(top), F.lit(True))
    fresh = fresh.withColumn("_seq", F.col("k_top") + F.col("k_number")).select(records.columns)
    return records.where(has).unionByName(fresh)


def assign_reference_codes(records: DataFrame, order: list[Column], batch_name: str = "batch_name") -> DataFrame:
    """Rows without a code get Temp/<batch>/<7 digits>, on from the batch's highest number."""
    has = F.coalesce("referenceCode", F.lit("")) != ""
    number = F.try_to_number(F.nullif(F.regexp_extract("referenceCode", r"/(\d+)$", 1), F.lit("")), F.lit("9" * 18)).cast("long")
    top = records.where(has).groupBy(F.col(batch_name).alias("k_batch")).agg(F.max(number).alias("k_top"))
    fresh = ranked(records.where(~has), order, "k_number", batch_name)
    fresh = fresh.join(top, F.col(batch_name).eqNullSafe(F.col("k_batch")), "left")
    code = F.format_string("Temp/%s/%07d", F.coalesce(batch_name, F.lit("Untitled")), F.coalesce("k_top", F.lit(0)) + F.col("k_number"))
    return records.where(has).unionByName(fresh.withColumn("referenceCode", code).select(records.columns))


def retained(cache: DataFrame, cap: int, slices: int | None = None) -> DataFrame:
    """The newest cached files whose sizes sum to ``cap`` at most; the one that crosses it goes.

    Order: cachedAt, then id. ``cache``: id, size, cachedAt, more. Sums run over ranges of the order,
    so no task sees the whole cache.
    """
    n = slices or int(cache.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("cachedAt").desc(), F.col("id").desc()]
    dealt = cache.repartitionByRange(n, *order).withColumn("k_part", F.spark_partition_id())
    size = F.coalesce("size", F.lit(0))
    own = F.sum(size).over(W.partitionBy("k_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    sums = dealt.groupBy("k_part").agg(F.sum(size).alias("k_sum"))
    before = sums.withColumn("k_before", F.sum("k_sum").over(W.partitionBy(F.lit(0)).orderBy("k_part")) - F.col("k_sum")).drop("k_sum")
    kept = dealt.withColumn("k_own", own).join(before, "k_part").where(F.col("k_before") + F.col("k_own") <= cap)
    return kept.drop("k_part", "k_own", "k_before")
