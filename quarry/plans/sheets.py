"""Workbooks: their cells whatever the format, statistics of them, and their text as CSV.

Cells: key, sheet, name, state, merges, high, wide (of the used range), row, col, kind, formula, text. A
sheet without cells has one row without one. Text is cut as excerpts are before it is put together, and
empty rows and columns between cells are counted, not made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import headers as h
from ..functions.values import EXCERPT_CAP
from ..operators.sinks import csv_field
from ..operators.views import histogram_text
from ..sources import sheets as source
from ..sources.office import cells as package_cells

ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}
CELL = ["sheet", "name", "state", "merges", "high", "wide", "row", "col", "kind", "formula", "text"]


def _word(data: Column, at: int) -> Column:
    """Up to four bytes from a place (counted from 1) on, the lowest first; null for none."""
    hexed = F.hex(F.substring(data, at, 4))
    return F.conv(F.nullif(F.concat(*(F.substring(hexed, i, 2) for i in (7, 5, 3, 1))), F.lit("")), 16, 10).cast("long")


def double_of(low: Column, high: Column) -> Column:
    """The number whose eight bytes are two unsigned words, as IEEE 754 has it; no infinities."""
    exponent = F.shiftright(high, 20).bitwiseAND(2047)
    part = high.bitwiseAND(2**20 - 1).cast("double") * 2.0**32 + low
    size = F.when(exponent == 0, part * F.pow(F.lit(2.0), F.lit(-1074))).otherwise((F.lit(1.0) + part / 2.0**52) * F.pow(F.lit(2.0), exponent - 1023))
    return F.when(exponent < 2047, F.when(high >= 2**31, -size).otherwise(size))


def rk_number(word: Column) -> Column:
    """A number in four bytes: thirty bits of an integer or of a double, perhaps in hundredths."""
    cut = F.shiftrightunsigned(word, 2)
    whole = F.when(cut >= 2**29, cut - 2**30).otherwise(cut).cast("double")
    value = F.when(word.bitwiseAND(2) == 2, whole).otherwise(double_of(F.lit(0), word - word.bitwiseAND(3)))
    return F.when(word.bitwiseAND(1) == 1, value / 100).otherwise(value)


def number_text(x: Column) -> Column:
    """A number as a cell shows it without a format."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("decimal(20,0)").cast("string")).otherwise(F.regexp_replace(x.cast("string"), r"E(\d)", "E+$1"))


def biff_cells(records: DataFrame, key: str = "id") -> DataFrame:
    """Cells of ``sources.sheets.records``: values by their record's number, shared strings and sheets by joins."""
    kind, data = F.col("kind"), F.col("data")
    text = F.make_valid_utf8(data.cast("string"))
    shared = records.where(kind == source.SST).select(key, F.col("row").alias("k_string"), text.alias("k_shared"))
    sheets = records.where(kind == source.BOUNDSHEET).select(key, "sheet", text.alias("name"), F.element_at(F.array(F.lit(""), F.lit("hidden"), F.lit("veryHidden"), F.lit("")), F.col("col") + 1).alias("state"))
    merges = F.sum(F.when(kind == source.MERGES, F.col("row"))).cast("int").alias("merges")
    high = F.max(F.when(kind == source.DIMENSIONS, h.little(data, 4) - h.little(data, 0))).cast("int").alias("k_high")
    wide = F.max(F.when(kind == source.DIMENSIONS, h.little(data, 10, 2) - h.little(data, 8, 2))).cast("int").alias("k_wide")
    values = kind.isin(source.LABELSST, source.LABEL, source.NUMBER, source.RK, source.BOOLERR)
    row, col = F.when(values, F.col("row")), F.when(values, F.col("col"))
    sides = records.where("sheet > 0").groupBy(key, "sheet").agg(merges, high, wide, (F.max(row) - F.min(row) + 1).alias("k_rows"), (F.max(col) - F.min(col) + 1).alias("k_cols"))
    used = lambda given, met: F.when(F.col(met).isNull(), 0).otherwise(F.coalesce(F.nullif(F.col(given), F.lit(0)), F.col(met))).cast("int")
    sheets = sheets.join(sides, [key, "sheet"], "left").select(key, "sheet", "name", "state", F.coalesce("merges", F.lit(0)).alias("merges"), used("k_high", "k_rows").alias("high"), used("k_wide", "k_cols").alias("wide"))
    # In steps, so that each word and number is computed once.
    cells = records.where(values & (F.col("sheet") > 0)).select(key, "sheet", (F.col("row") + 1).alias("row"), (F.col("col") + 1).alias("col"), "kind", "formula", "data", _word(data, 1).alias("k_low"), _word(data, 5).alias("k_high"))
    number = F.when(kind == source.NUMBER, double_of(F.col("k_low"), F.col("k_high"))).when(kind == source.RK, rk_number(F.col("k_low")))
    cells = cells.withColumns({"k_number": number, "k_value": F.col("k_low").bitwiseAND(255).cast("int"), "k_error": F.shiftright("k_low", 8).bitwiseAND(255) == 1, "k_string": F.when(kind == source.LABELSST, F.col("k_low")).cast("int")})
    error = F.create_map(*(F.lit(x) for kv in ERRORS.items() for x in kv))
    shown = (
        F.when(kind == source.LABEL, text).when(kind.isin(source.NUMBER, source.RK), number_text(F.col("k_number")))
        .when(kind == source.BOOLERR, F.when(F.col("k_error"), F.try_element_at(error, F.col("k_value"))).when(F.col("k_value") == 1, "TRUE").otherwise("FALSE"))
    )
    named = F.when(kind.isin(source.LABELSST, source.LABEL), "string").when(kind.isin(source.NUMBER, source.RK), "number").when(F.col("k_error"), "error").otherwise("boolean")
    cells = cells.select(key, "sheet", "row", "col", named.alias("kind"), "formula", shown.alias("text"), "k_string")
    plain = cells.where("k_string is null").drop("k_string")
    by_string = cells.where("k_string is not null").join(shared, [key, "k_string"], "left").withColumn("text", F.coalesce("k_shared", F.lit(""))).drop("k_string", "k_shared")
    return sheets.join(plain.unionByName(by_string), [key, "sheet"], "left").withColumn("formula", F.coalesce("formula", F.lit(False))).select(key, *CELL)


def expanded(spanned: DataFrame, key: str = "id") -> DataFrame:
    """Cells of ``sources.sheets.spanned`` or ``fields``: runs of equal filled cells become cells, and the used range is what they cover."""
    sides = spanned.groupBy(key, "sheet").agg((F.max(F.col("row") + F.col("rows")) - F.min("row")).cast("int").alias("high"), (F.max(F.col("col") + F.col("cols")) - F.min("col")).cast("int").alias("wide"))
    runs = spanned.join(sides, [key, "sheet"]).withColumns({"high": F.coalesce("high", F.lit(0)), "wide": F.coalesce("wide", F.lit(0))})
    runs = runs.withColumn("row", F.explode_outer(F.sequence(F.col("row"), F.col("row") + F.col("rows") - 1))).withColumn("col", F.explode_outer(F.sequence(F.col("col"), F.col("col") + F.col("cols") - 1)))
    return runs.select(key, *(F.col(c).cast("int") if c in ("row", "col") else F.col(c) for c in CELL))


def cells(files: DataFrame, key: str = "id") -> DataFrame:
    """Cells of the workbooks among ``files`` (key, extension, content)."""
    of = lambda *extensions: files.where(F.col("extension").isin(*extensions))
    found = package_cells(of("xlsx"), key).select(key, *CELL).unionByName(biff_cells(source.records(of("xls", "xlt"), key), key))
    return found.unionByName(expanded(source.spanned(of("ods"), key), key)).unionByName(expanded(source.fields(of("csv"), key), key))


def sheet_statistics(cells: DataFrame, key: str = "id") -> DataFrame:
    """key, sheetCount, sheetNames, totalPopulatedCells, totalFormulas, totalMergedRegions, hiddenSheets, sheetSummary, dataTypes; ``cells``: above."""
    there = F.col("row").isNotNull()
    sheets = cells.groupBy(key, "sheet").agg(
        F.first("name").alias("name"), F.first("state").alias("state"), F.first("merges").alias("merges"), F.first("high").alias("high"), F.first("wide").alias("wide"),
        F.count_if(there).alias("cells"), F.count_if(there & F.col("formula")).alias("formulas"),
    )
    shown = F.when(F.col("state") == "hidden", "(hidden)").when(F.col("state") == "veryHidden", "(very hidden)")
    size = F.when(F.col("high") > 0, F.concat(F.col("high").cast("string"), F.lit("×"), F.col("wide").cast("string")))
    line = F.concat_ws(" — ", "name", size, F.concat(F.col("cells").cast("string"), F.lit(" cells")), F.when(F.col("formulas") > 0, F.concat(F.col("formulas").cast("string"), F.lit(" formulas"))), shown)
    in_order = lambda x, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct("sheet", x.alias("x"))))), lambda p: p["x"]), by)
    books = sheets.groupBy(key).agg(
        F.count("*").alias("sheetCount"), in_order(F.col("name"), ", ").alias("sheetNames"),
        F.sum("cells").alias("totalPopulatedCells"), F.sum("formulas").alias("totalFormulas"), F.nullif(F.sum("merges"), F.lit(0)).alias("totalMergedRegions"),
        F.nullif(in_order(F.when(shown.isNotNull(), F.col("name")), ", "), F.lit("")).alias("hiddenSheets"), in_order(line, " | ").alias("sheetSummary"),
    )
    return books.join(histogram_text(cells.where(there), "kind", [key]).withColumnRenamed("histogram", "dataTypes"), key, "left")


def _commas(n: Column) -> Column:
    return F.repeat(F.lit(","), F.least(n, F.lit(EXCERPT_CAP)).cast("int"))


def sheet_text(cells: DataFrame, key: str = "id") -> DataFrame:
    """key and body: each sheet's used range as CSV lines, headed by its name where there are several; no more of a sheet than an excerpt takes."""
    filled = cells.where("row is not null")
    ends = filled.groupBy(key, "sheet").agg(F.min("col").alias("left"), F.max("col").alias("right"))
    rows = filled.groupBy(key, "sheet", "name", "row").agg(F.array_sort(F.collect_list(F.struct("col", csv_field(F.coalesce("text", F.lit(""))).alias("text")))).alias("of")).join(ends, [key, "sheet"])
    field = lambda c, i: F.concat(_commas(c["col"] - F.when(i == 0, F.col("left")).otherwise(F.get("of", i - 1)["col"])), c["text"])
    line = F.concat(F.array_join(F.transform("of", field), ""), _commas(F.col("right") - F.element_at("of", -1)["col"]))
    lines = rows.select(key, "sheet", "name", "row", line.alias("line"), (F.col("right") - F.col("left")).cast("long").alias("wide"))
    down = W.partitionBy(key, "sheet").orderBy("row")
    lines = lines.withColumn("empty", F.coalesce(F.col("row") - F.lag("row").over(down) - 1, F.lit(0)).cast("long"))
    own = F.length("line") + 1 + F.col("empty") * (F.col("wide") + 1)
    lines = lines.withColumn("start", F.coalesce(F.sum(own).over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).where(F.col("start") <= EXCERPT_CAP)
    some = F.least(F.col("empty"), F.ceil(F.lit(EXCERPT_CAP) / (F.col("wide") + 1))).cast("int")
    text = F.concat(F.repeat(F.concat(_commas(F.col("wide")), F.lit("\n")), some), F.col("line"))
    sheets = lines.groupBy(key, "sheet", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", text.alias("text")))), lambda r: r["text"]), "\n").alias("text"))
    pages = sheets.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("sheet", "name", "text"))).alias("pages"))
    count = cells.groupBy(key).agg(F.count_distinct("sheet").alias("n"))
    head = lambda p: F.when(F.col("n") > 1, F.concat(F.lit("--- "), p["name"], F.lit(" ---\n"))).otherwise("")
    return pages.join(count, key).select(key, F.trim(F.array_join(F.transform("pages", lambda p: F.concat(head(p), p["text"])), "\n")).alias("body"))
