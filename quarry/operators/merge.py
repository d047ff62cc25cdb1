"""Upserts and key lookups between record tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _last_of_each(rows: DataFrame, key: str, order: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """One row a key: the last by ``order``, of equal ones the first by ``ties``."""
    return rows.withColumn("k_rank", F.row_number().over(W.partitionBy(key).orderBy(F.col(order).desc(), *ties))).where("k_rank = 1").drop("k_rank")


def merge_records(existing: DataFrame, incoming: DataFrame, order: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """Upsert by id: incoming rows win, but edits of existing ones stay.

    notes, description and referenceCode stay where incoming ones are null or empty;
    levelOfDescription stays unless it is File. Of incoming rows with the same id the last by
    ``order`` counts, of equal ones the first by ``ties``. Reference codes are to be assigned after the
    merge, so that a file that comes again keeps its code.
    """
    new = _last_of_each(incoming, "id", order, ties)
    e, n = existing.alias("e"), new.alias("n")
    out = []
    for c in existing.columns:
        old, now = F.col(f"e.`{c}`"), F.col(f"n.`{c}`") if c in new.columns else F.col(f"e.`{c}`")
        if c == "id":
            col = F.coalesce(F.col("n.id"), F.col("e.id"))
        elif c in ("notes", "description", "referenceCode"):
            kept = F.when((F.coalesce(old, F.lit("")) != "") & (F.coalesce(now, F.lit("")) == ""), old).otherwise(now)
            col = F.when(F.col("n.id").isNull(), old).otherwise(kept)
        elif c == "levelOfDescription":
            kept = F.when((F.coalesce(old, F.lit("")) != "") & (old != "File"), old).otherwise(now)
            col = F.when(F.col("n.id").isNull(), old).otherwise(kept)
        else:
            col = F.when(F.col("n.id").isNull(), old).otherwise(now)
        out.append(col.alias(c))
    return e.join(n, F.col("e.id") == F.col("n.id"), "full_outer").select(*out)


def apply_results(records: DataFrame, results: DataFrame) -> DataFrame:
    """Set what deep extraction found; records without a result stay as they are.

    ``results``: id, deepMeta, excerpt, createdDate, author, title, language, extent, error. Author
    and title are replaced even where they were edited; a result with an error only sets the status.
    """
    r, x = records.alias("r"), results.alias("x")
    ok = F.col("x.id").isNotNull() & F.col("x.error").isNull()
    out = []
    for c in records.columns:
        old = F.col(f"r.`{c}`")
        if c in ("deepMeta", "createdDate", "author", "title"):
            col = F.when(ok, F.col(f"x.{c}")).otherwise(old)
        elif c in ("excerpt", "language", "extent"):
            col = F.when(ok, F.coalesce(F.col(f"x.{c}"), F.lit(""))).otherwise(old)
        elif c == "_status":
            col = F.when(ok, "complete").when(F.col("x.id").isNotNull(), "error").otherwise(old)
        else:
            col = old
        out.append(col.alias(c))
    return r.join(x, F.col("r.id") == F.col("x.id"), "left").select(*out)


def new_files(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose id the cache doesn't hold yet."""
    return files.join(cache.select("id"), "id", "left_anti")


def orphans(cache: DataFrame, records: DataFrame) -> DataFrame:
    """Cached ids that no record of any batch has."""
    return cache.join(records.select("id").distinct(), "id", "left_anti")


def without_orphans(cache: DataFrame, records: DataFrame) -> DataFrame:
    return cache.join(records.select("id").distinct(), "id", "left_semi")


def restore_bytes(records: DataFrame, cache: DataFrame) -> DataFrame:
    """Records with their cached content, null where it was evicted."""
    return records.join(cache.select("id", "content"), "id", "left")


def resume(records: DataFrame, cache: DataFrame) -> DataFrame:
    """Incomplete records to process again: captured with content, or error where it is gone."""
    rows = restore_bytes(incomplete(records), cache)
    lost = F.col("content").isNull()
    note = F.lit("Source file no longer cached; add it again to extract its metadata.")
    return rows.withColumns({"_status": F.when(lost, "error").otherwise("captured"), "notes": F.when(lost & (F.coalesce("notes", F.lit("")) == ""), note).otherwise(F.col("notes"))})


def update_cell(records: DataFrame, record_id: str, field: str, value: str) -> DataFrame:
    """Set one field of one record, trimmed; size can't be edited."""
    if field in ("size", "id"):
        raise ValueError(f"{field} can't be edited")
    return records.withColumn(field, F.when(F.col("id") == record_id, F.lit(value.strip())).otherwise(F.col(field)))


def unpack_target(records: DataFrame, name: str) -> DataFrame:
    """The first archive of a displayed name, by sequence; no row without one."""
    return first_match(records.where(F.col("category") == "Archive"), "name", name)


def first_match(records: DataFrame, field: str, value: str, order: str = "_seq") -> DataFrame:
    """The first record by ``order`` whose field has a value. Displayed names may repeat; ids don't."""
    return records.where(F.col(field) == value).orderBy(F.coalesce(order, F.lit(0)), "id").limit(1)


def incomplete(records: DataFrame) -> DataFrame:
    """Records that deep extraction hasn't finished."""
    return records.where(F.col("_status").isin("captured", "processing"))


def delete_record(records: DataFrame, record_id: str) -> DataFrame:
    return records.where(F.col("id") != record_id)
