"""Incremental capture: files as a stream, captured first, extracted in the same micro-batch.

The two tiers of a batch are two appends to a journal: skeleton records, then results. Reading the
journal back takes the latest state of each record, so a batch that is run again after a failure
changes nothing: file ids are the same and the last row counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import apply_results
from ..plans.extract import extract
from ..schema import RECORD
from ..sources.files import capture, stream_files


def ingest(spark: SparkSession, root: str, journal: str, checkpoint: str, files_a_batch: int = 10, deep: bool = True) -> StreamingQuery:
    """Start capturing what lies and arrives below ``root``; stops once all present files are done."""

    def batch(files: DataFrame, number: int) -> None:
        records = capture(files)
        stamped = lambda rows, tier: rows.withColumns({"k_batch": F.lit(number), "k_tier": F.lit(tier)})
        stamped(records, 0).write.mode("append").parquet(journal)
        if deep:
            content = capture(files, keep=["content"])
            results = extract(content.select("id", "extension", "content"))
            stamped(apply_results(records, results), 1).write.mode("append").parquet(journal)

    stream = stream_files(spark, root, files_a_batch)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, journal: str) -> DataFrame:
    """The present state of every record of a journal."""
    rows = spark.read.parquet(journal)
    order = F.row_number().over(W.partitionBy("id").orderBy(F.col("k_tier").desc(), F.col("k_batch").desc()))
    return rows.withColumn("k_rank", order).where("k_rank = 1").select(*(f.name for f in RECORD.fields))
