"""Batches of records, export log and file cache as Parquet tables below one folder.

Records and the registry are partitioned by batch and replaced by Spark's dynamic partition overwrite, so
a write touches one batch alone. Logs and the cache are only appended to: what is evicted is listed by id,
and a wave of the cache that nothing is left of gives its space back. A partition that is emptied holds one
row without an id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.merge import new_files, resume
from ..operators.numbering import retained
from ..functions.values import CACHE_CAP
from ..schema import BATCH, EXPORT, RECORD

_fields = lambda **kinds: T.StructType([T.StructField(k, v()) for k, v in kinds.items()])
CACHE = _fields(id=T.StringType, size=T.LongType, cachedAt=T.LongType, content=T.BinaryType)
EVICTED = _fields(wave=T.LongType, id=T.StringType)
CHOSEN = _fields(id=T.StringType, at=T.TimestampType)


class Store:
    """The tables below ``root``; every read sees what is there when it is planned."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _table(self, name: str, schema: T.StructType, by: str | None = None) -> DataFrame:
        path = f"{self.root}/{name}"
        schema = T.StructType([*schema.fields, T.StructField(by, T.LongType() if by == "wave" else T.StringType())]) if by and by not in schema.names else schema
        if not self._exists(path):
            return self.spark.createDataFrame([], schema)
        self.spark.catalog.refreshByPath(path)
        return self.spark.read.schema(schema).parquet(path)

    def _append(self, name: str, rows: DataFrame, *by: str) -> None:
        rows.write.mode("append").partitionBy(*by).parquet(f"{self.root}/{name}")

    def _overwrite(self, name: str, rows: DataFrame, by: str) -> None:
        """Replace the partitions that ``rows`` have, and no others."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{self.root}/{name}")

    def _registered(self, batch: str, **changes: Column) -> None:
        """A batch's row of the registry, changed."""
        row = self.batch(batch).withColumns({k: v.cast(BATCH[k].dataType) for k, v in changes.items()})
        self._overwrite("batches", row.withColumns({"batch": F.col("id"), "gone": F.lit(False)}).coalesce(1), "batch")

    def batches(self) -> DataFrame:
        rows = self._table("batches", T.StructType([*BATCH.fields, T.StructField("gone", T.BooleanType())]), "batch")
        return rows.where("not gone").select(*BATCH.names)

    def exports(self) -> DataFrame:
        return self._table("exports", EXPORT)

    def create_batch(self, name: str | None = None) -> str:
        """A new batch; its name defaults to batch-<date>."""
        now = self.spark.range(1).select(F.concat(F.lit("batch_"), F.unix_millis(F.current_timestamp()).cast("string")).alias("id"), F.coalesce(F.lit(name), F.concat(F.lit("batch-"), F.current_date().cast("string"))).alias("name"), F.current_timestamp().alias("createdAt"), F.lit(0).cast("long").alias("fileCount")).first()
        row = self.spark.createDataFrame([now], BATCH).withColumns({"batch": F.col("id"), "gone": F.lit(False)})
        self._append("batches", row.coalesce(1), "batch")
        return now["id"]

    def rename_batch(self, batch: str, name: str) -> None:
        self._registered(batch, name=F.lit(name))

    def load(self, batch: str) -> DataFrame:
        """A batch's records; none for an unknown batch. Only its partition is read."""
        return self._table("records", RECORD, "batch").where((F.col("batch") == batch) & F.col("id").isNotNull()).select(*RECORD.names)

    def save(self, batch: str, records: DataFrame) -> None:
        """Replace a batch's records and its file count; no content is stored with them."""
        rows = records.select(*(F.col(f"`{f.name}`").cast(f.dataType) for f in RECORD.fields))
        marker = self.spark.createDataFrame([(None,) * len(RECORD.fields)], T.StructType([T.StructField(f.name, f.dataType) for f in RECORD.fields]))
        self._overwrite("records", rows.where("id is not null").unionByName(marker).withColumn("batch", F.lit(batch)), "batch")
        self._registered(batch, fileCount=F.lit(self.load(batch).count()))

    def clear(self, batch: str) -> None:
        self.save(batch, self.spark.createDataFrame([], RECORD))

    def delete_batch(self, batch: str) -> None:
        """The batch and its records go; its exports stay in the log."""
        self.clear(batch)
        self._overwrite("batches", self.batch(batch).withColumns({"batch": F.col("id"), "gone": F.lit(True)}).coalesce(1), "batch")

    def record_export(self, batch: str, n: int) -> None:
        row = self.spark.range(1).select(F.lit(batch).alias("batch_id"), F.current_timestamp().alias("date"), F.lit(n).cast("long").alias("fileCount"))
        self._append("exports", row.coalesce(1))

    def _entries(self) -> DataFrame:
        """The cache's entries with their waves, without those evicted."""
        return self._table("cache", CACHE, "wave").where("id is not null").join(self._table("evicted", EVICTED), ["wave", "id"], "left_anti")

    def cache(self) -> DataFrame:
        return self._entries().select(*CACHE.names)

    def cache_files(self, files: DataFrame, cap: int = CACHE_CAP) -> None:
        """Append files (id, size, cachedAt, content) that aren't cached yet, then list the oldest over ``cap`` bytes as evicted.

        Ids and sizes alone are read of what is cached. A wave that is evicted as a whole is emptied.
        """
        wave = (self._table("cache", CACHE, "wave").agg(F.max("wave")).first()[0] or 0) + 1
        fresh = new_files(files.select(*CACHE.names), self.cache().select("id"))
        self._append("cache", fresh.withColumn("wave", F.lit(wave).cast("long")).sortWithinPartitions("id"), "wave")
        index = self._entries().select("wave", "id", "size", "cachedAt")
        kept = retained(index, cap)
        self._append("evicted", index.join(kept.select("wave", "id"), ["wave", "id"], "left_anti").select("wave", "id"))
        self._empty(self._table("cache", CACHE, "wave").where("id is not null").select("wave").distinct().join(kept.select("wave").distinct(), "wave", "left_anti"))

    def _empty(self, waves: DataFrame) -> None:
        gone = [r["wave"] for r in waves.collect()]  # waves, not files: one for each call that cached some
        if gone:
            self._overwrite("cache", self.spark.createDataFrame([(None, None, None, None, w) for w in gone], T.StructType([*CACHE.fields, T.StructField("wave", T.LongType())])), "wave")

    def cached(self, record_id: str) -> DataFrame:
        """One record's cached bytes; no row where they were evicted. Files are sorted by id, so most are skipped."""
        return self.cache().where(F.col("id") == record_id)

    def clear_cache(self) -> None:
        self._empty(self._entries().select("wave").distinct())

    def batch(self, batch: str) -> DataFrame:
        """The registry's row of a batch; none for an unknown one."""
        return self.batches().where(F.col("id") == batch)

    def activate(self, batch: str | None) -> None:
        self._append("active", self.spark.range(1).select(F.lit(batch).cast("string").alias("id"), F.current_timestamp().alias("at")).coalesce(1))

    def active(self) -> str | None:
        """The active batch: the one chosen last while it exists, else the newest, else none."""
        chosen = self._table("active", CHOSEN).agg(F.max_by("id", "at")).first()[0]
        if chosen and self.batch(chosen).first():
            return chosen
        last = self.batches().orderBy(F.col("createdAt").desc(), F.col("id").desc()).first()
        return last["id"] if last else None

    def switch(self, current: DataFrame | None, batch: str) -> tuple[DataFrame, DataFrame]:
        """Save the active batch's records, make another one active, and give its records and those to resume.

        Rows to resume have their bytes from the cache; those whose bytes were evicted are errors.
        """
        if current is not None and (active := self.active()):
            self.save(active, current)
        self.activate(batch)
        records = self.load(batch)
        return records, resume(records, self.cache().select("id", "content"))

    def import_records(self, records: DataFrame, name: str = "Imported") -> str:
        """Records kept elsewhere, as a new batch; fields that they lack are null."""
        key = self.create_batch(name)
        have = set(records.columns)
        self.save(key, records.select(*((F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in RECORD.fields)))
        return key
