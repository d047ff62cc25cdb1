"""Canonical fields from open metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Which metadata keys fill which field, first that counts.
CANONICAL = {
    "createdDate": ("CreationDate", "DateTimeOriginal", "created"),
    "author": ("Author", "Artist", "creator", "author"),
    "title": ("Title", "title"),
    "language": ("language", "defaultLanguage"),
    "extent": ("pageCount", "pages", "slideCount", "slides", "sheetCount", "Duration"),
}


def truthy(meta: Column, key: str) -> Column:
    """A value as text unless it is missing, null, empty, false or the number 0; the text "0" counts."""
    value = F.try_variant_get(meta, f"$['{key}']", "string")
    kind = F.schema_of_variant(F.try_variant_get(meta, f"$['{key}']", "variant"))
    nothing = (value == "") | ((kind == "BOOLEAN") & (value == "false")) | ((kind != "STRING") & (value.try_cast("double") == 0))
    return F.when(~nothing, value)


def normalised(records: DataFrame, meta: str = "deepMeta") -> DataFrame:
    """``records`` with the canonical fields set from JSON text ``meta``; null where none counts."""
    parsed = records.withColumn("k_parsed", F.try_parse_json(F.col(meta)))  # once a record
    return parsed.withColumns({name: F.coalesce(*[truthy(F.col("k_parsed"), k) for k in keys]) for name, keys in CANONICAL.items()}).drop("k_parsed")
