"""The catalogue record and the tables around it."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()

#: One row a file. ``deepMeta`` is JSON text in insertion order; empty text and null differ.
RECORD = T.StructType(
    [T.StructField("id", _S, False)]
    + [T.StructField(c, _S) for c in ("name", "path")]
    + [T.StructField("size", T.LongType())]
    + [T.StructField(c, _S) for c in ("type", "extension", "category", "lastModified", "createdDate", "author", "title", "description", "levelOfDescription", "language", "extent", "referenceCode", "source", "url", "notes", "excerpt", "deepMeta", "_status")]
    + [T.StructField("_seq", T.LongType()), T.StructField("_unpacked", T.BooleanType())]
)

#: Files as a source gives them.
FILE = T.StructType([T.StructField("path", _S), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])

BATCH = T.StructType([T.StructField("id", _S), T.StructField("name", _S), T.StructField("createdAt", T.TimestampType()), T.StructField("fileCount", T.LongType())])
EXPORT = T.StructType([T.StructField("batch_id", _S), T.StructField("date", T.TimestampType()), T.StructField("fileCount", T.LongType())])
