"""Files and folders as rows, and their capture as catalogue records."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import classified, is_os_artifact
from ..functions.scalars import file_id, iso_ms
from ..schema import FILE, RECORD

#: Scheme and host before a path.
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def read_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """All files below ``root`` with path relative to it; unreadable ones are skipped."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    return relative(reader.option("pathGlobFilter", pattern).load(root) if pattern else reader.load(root), root)


def stream_files(spark: SparkSession, root: str, files_a_batch: int = 10) -> DataFrame:
    """The same as a stream, a few files at a time."""
    reader = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_a_batch)
    return relative(reader.load(root), root)


def relative(files: DataFrame, root: str) -> DataFrame:
    """Paths below ``root``, whatever the scheme they come with."""
    base = re.sub(SCHEME, "", root).rstrip("/") + "/"
    plain = F.regexp_replace("path", SCHEME, "")
    return files.withColumn("path", F.when(plain.startswith(base), F.substring(plain, len(base) + 1, 1 << 20)).otherwise(plain))


def capture(files: DataFrame, source: str = "local", keep: list[str] | None = None, mime: Column | None = None) -> DataFrame:
    """A skeleton record of each file (path, modificationTime, length, content), status captured.

    Operating-system artifacts are left out. No content is kept in records.
    """
    rows = files.where(~is_os_artifact(F.col("path"))).withColumn("k_name", F.substring_index("path", "/", -1))
    extension, category, detected = classified(F.col("k_name"), F.col("content"))
    ms = F.unix_millis("modificationTime")
    text = F.lit("")
    given = {
        "id": file_id(F.col("path"), F.col("length"), ms), "name": F.col("k_name"), "path": F.col("path"), "size": F.col("length"),
        "type": F.coalesce(F.nullif(mime, F.lit("")) if mime is not None else F.lit(None).cast("string"), detected, F.lit("application/octet-stream")),
        "extension": extension, "category": category, "lastModified": iso_ms(F.col("modificationTime")),
        "description": text, "levelOfDescription": F.lit("File"), "language": text, "extent": text, "referenceCode": text,
        "source": F.lit(source), "notes": text, "excerpt": text, "_status": F.lit("captured"), "_unpacked": F.lit(False),
    }
    return rows.select(*(keep or []), *(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RECORD.fields))
