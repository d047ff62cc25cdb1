"""CSV and JSON exports of mapped rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..work import kept


def csv_field(value: Column) -> Column:
    """Quoted if it holds a comma, a quote or a line feed; a lone carriage return is left alone."""
    return F.when(value.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def _plain(rows: DataFrame, labels: list[str]) -> list[Column]:
    return [F.coalesce(rows[f"`{c}`" if c in rows.columns else c].cast("string"), F.lit("")) for c in labels]


def csv_lines(rows: DataFrame, labels: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """``line`` for each row, after the columns ``keep``."""
    labels = labels or [c for c in rows.columns if c not in (keep or [])]
    return rows.select(*(keep or []), F.concat_ws(",", *(csv_field(c) for c in _plain(rows, labels))).alias("line"))


def json_rows(rows: DataFrame, labels: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """``line`` for each row: an object of strings keyed by label."""
    labels = labels or [c for c in rows.columns if c not in (keep or [])]
    return rows.select(*(keep or []), F.to_json(F.struct(*(c.alias(n) for c, n in zip(_plain(rows, labels), labels, strict=True)))).alias("line"))


def write_csv(rows: DataFrame, path: str, order: list[Column], labels: list[str] | None = None) -> int:
    """Text files whose lines, file by file, are the export; returns the number of rows.

    Lines are ranged over files by ``order``, so no task writes a whole large export; the header is
    the first line of the first file. Nothing is written for no rows.
    """
    n = rows.count()
    if n:
        labels = labels or rows.columns
        head = ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n') else c for c in labels)
        ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        lines = csv_lines(ranged, labels)
        parts = rows.sparkSession.createDataFrame([(head,)], "line string").coalesce(1).unionByName(lines)
        parts.write.mode("overwrite").text(path)
    return n


def write_json(rows: DataFrame, path: str, order: list[Column], labels: list[str] | None = None) -> int:
    """JSON lines in export order; returns the number of rows."""
    n = rows.count()
    if n:
        json_rows(rows.repartitionByRange(*order).sortWithinPartitions(*order), labels or rows.columns).write.mode("overwrite").text(path)
    return n


def write_json_array(rows: DataFrame, path: str, order: list[Column], labels: list[str] | None = None) -> int:
    """Text files whose lines, file by file, are one JSON array of objects of strings, indented by two spaces; returns the number of rows.

    Of a repeated label the last column counts. Nothing is written for no rows.
    """
    n = rows.count()
    if n:
        labels = labels or rows.columns
        text = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"(?s)^\[|\]$", "")
        last = {label: i for i, label in enumerate(labels)}
        own = _plain(rows, labels)
        fields = [F.concat(F.lit("    "), text(F.lit(label)), F.lit(": "), text(own[i])) for label, i in last.items()]
        ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        blocks = kept(ranged.select(F.concat(F.lit("  {\n"), F.concat_ws(",\n", *fields), F.lit("\n  }")).alias("line"), F.monotonically_increasing_id().alias("k_row")))
        end = blocks.agg(F.max("k_row")).first()[0]
        lines = blocks.repartitionByRange("k_row").sortWithinPartitions("k_row").select(F.concat("line", F.when(F.col("k_row") == end, "").otherwise(",")).alias("line"))
        edge = lambda x: rows.sparkSession.createDataFrame([(x,)], "line string").coalesce(1)
        edge("[").unionByName(lines).unionByName(edge("]")).write.mode("overwrite").text(path)
    return n
