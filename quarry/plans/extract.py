"""Deep extraction: metadata, excerpt and canonical fields of captured files.

Formats with fields at fixed places or in markup are read by Column expressions; container formats go
through ``sources.chunks`` in one pass; PDF files through their objects; office files through their members
and cells. Each is chosen by extension, and files without any metadata get text statistics. What each way
finds are a few strings a file; these meet in one exchange, and contents never travel. A file that can't be
read has no metadata and no error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import headers, markup
from ..functions.rtf import rtf_text
from ..functions.scalars import excerpt_of_bytes, excerpt_of_text
from ..functions.textstats import text_stats
from ..functions.values import EXCERPT_CAP
from ..sources.archives import zip_member
from ..sources.chunks import WALKERS, parts
from ..sources.office import word_bodies
from ..sources.pdf import pdf_objects
from ..work import kept
from .metadata import entries, gathered
from .normalize import normalised
from .pdf import loose, pdf_metadata, pdf_text
from .sheets import cells, sheet_statistics, sheet_text

# Extensions whose content is an excerpt as it is, and those of office packages.
PLAIN = "txt csv json xml html htm css js ts md log ini cfg yaml yml toml sh bat py rb java c cpp h rs go php sql".split()
OFFICE = "docx xlsx pptx odt ods odp".split()
MEMBERS = {"core": "docProps/core.xml", "app": "docProps/app.xml", "custom": "docProps/custom.xml", "meta": "meta.xml", "main": "word/document.xml", "workbook": "xl/workbook.xml"}


def as_json(fields: dict[str, Column], needs: Column | None = None) -> Column:
    """A JSON object of the fields that aren't null; null where none is."""
    text = F.nullif(F.to_json(F.struct(*(v.alias(k) for k, v in fields.items()))), F.lit("{}"))
    return text if needs is None else F.when(needs, text)


def overlaid(base: Column, more: Column) -> Column:
    """A JSON object with a second one's entries after its own; either may be null. They share no names."""
    return F.when(base.isNull() | (base == "{}"), more).when(more.isNull() | (more == "{}"), base).otherwise(F.concat(F.left(base, F.length(base) - 1), F.lit(","), F.substring(more, F.lit(2), F.length(more))))


def plain_metadata(files: DataFrame) -> DataFrame:
    """``files`` with plain: metadata of formats that need no walking, null for others.

    What several fields are read from is computed first, once.
    """
    extension, content = F.col("extension"), F.col("content")
    latin = F.decode(F.when(extension == "rtf", F.substring(content, 1, 32_768)).when(extension == "indd", F.substring(content, 1, 4_194_304)), "ISO-8859-1")
    rows = files.withColumns({"k_latin": latin, "k_svg": F.when(extension == "svg", F.make_valid_utf8(content.cast("string")))})
    rows = rows.withColumns({"k_packet": F.when(extension != "rtf", markup.xmp_packet(F.col("k_latin"))), "k_info": F.when(extension == "rtf", markup.rtf_info(F.col("k_latin")))})
    hexed, packet = F.hex(F.substring(content, 1, 4)), F.col("k_packet")
    plain = (
        F.when(extension == "svg", as_json(markup.svg_fields(F.col("k_svg"))))
        .when(extension == "bmp", as_json(headers.bmp_header(content), hexed.startswith("424D") & (F.octet_length(content) >= 30)))
        .when(extension == "ico", as_json(headers.ico_fields(content), F.octet_length(content) >= 6))
        .when(extension == "webp", as_json(headers.webp_fields(content), (hexed == "52494646") & (F.octet_length(content) >= 30)))
        .when(extension == "rtf", as_json(markup.rtf_fields(F.col("k_latin"), F.col("k_info")), F.col("k_info").isNotNull() & (hexed == "7B5C7274")))
        .when(extension == "indd", F.when(packet.isNotNull(), as_json({"Format": F.lit("InDesign")} | {k: v for k, v in markup.xmp_fields(packet).items() if k != "Format"})))
    )
    return rows.withColumn("plain", plain).drop("k_latin", "k_svg", "k_packet", "k_info")


def loose_metadata(files: DataFrame, key: str = "id") -> DataFrame:
    """key, plain and text of PDF files without a usable object graph (``plans.pdf.loose``), by patterns over all of a file."""
    rows = files.withColumn("k_packet", markup.xmp_packet(F.col("latin")))
    return rows.select(key, as_json(markup.pdf_fields(F.col("latin"), F.col("k_packet"))).alias("plain"), F.col("loose_text").alias("text"))


def office_metadata(files: DataFrame, key: str = "id") -> DataFrame:
    """key, office (JSON) and body (text of a word-processing document)."""
    x = zip_member(files.where(F.col("extension").isin(*OFFICE)), MEMBERS, key)
    core, app, odf = (markup.office_fields(F.col(c), names) for c, names in (("core", markup.CORE), ("app", markup.APP), ("meta", markup.ODF)))
    fields = core | {k: F.coalesce(v, core[k]) if k in core else v for k, v in app.items()}
    fields = fields | {k: F.coalesce(v, fields[k]) if k in fields else v for k, v in odf.items()}
    sheets = F.regexp_extract_all(F.col("workbook"), F.lit(r'<sheet\b[^>]*\bname="([^"]*)"'), 1)
    fields["sheetCount"] = F.when(F.size(sheets) > 0, F.size(sheets).cast("long"))
    fields["sheetNames"] = F.when(F.size(sheets) > 0, F.array_join(sheets, ", "))
    names = F.filter(F.regexp_extract_all(F.col("workbook"), F.lit(r'<definedName\b[^>]*\bname="([^"]*)"'), 1), lambda n: ~n.startswith("_"))
    fields["namedRanges"] = F.when(F.size(names) > 0, F.array_join(names, ", "))
    fields["namedRangeCount"] = F.when(F.size(names) > 0, F.size(names).cast("long"))
    hidden = F.regexp_count(F.col("workbook"), F.lit(r'<sheet\b[^>]*\bstate="(?:hidden|veryHidden)"')).cast("long")
    fields["hiddenSheets"] = F.when(hidden > 0, hidden)
    fields["customProperties"] = markup.custom_properties(F.col("custom"))
    return x.select(key, as_json(fields).alias("office"), markup.docx_text(F.col("main")).alias("body"))


SHEETS, PDFS, WORDS = ["xlsx", "xls", "xlt", "ods", "csv"], ["pdf", "ai"], ["doc", "dot"]
TOTALS = ["totalPopulatedCells", "totalFormulas", "totalMergedRegions", "sheetSummary", "dataTypes"]


def sheet_metadata(found: DataFrame, files: DataFrame, key: str = "id") -> DataFrame:
    """key, sheets (JSON) and body of the workbooks and CSV files whose cells are ``found``; a package's own members tell its sheets' names."""
    x = sheet_statistics(found, key).join(sheet_text(found, key), key, "left").join(files.select(key, "extension"), key)
    totals = {c: F.col(c) for c in TOTALS}
    named = as_json({c: F.col(c) for c in ("sheetCount", "sheetNames")} | totals | {"hiddenSheets": F.col("hiddenSheets")})
    return x.select(key, F.when(F.col("extension") == "xlsx", as_json(totals)).otherwise(named).alias("sheets"), "body")


SOUNDS = ["mp3", "wav", "wave", "flac", "ogg", "oga", "aiff", "aif", "aac"]


def sound_details(walked: Column, extension: Column, size: Column) -> Column:
    """What a sound's metadata lack: a bit rate by its size and length, and its format by the extension."""
    told = lambda k: F.get_json_object(walked, f"$.{k}")
    seconds = told("durationSeconds").try_cast("double")
    rate = F.when(told("bitrate").isNull() & (seconds > 0), F.concat(F.floor(size * 8 / (seconds * 1000) + 0.5).cast("string"), F.lit(" kbps")))
    return as_json({"bitrate": rate, "format": F.when(told("format").isNull(), F.upper(extension))}, walked.isNotNull() & extension.isin(*SOUNDS))


def extract(files: DataFrame, key: str = "id") -> DataFrame:
    """``files`` (key, extension, content): key, deepMeta, excerpt, canonical fields, error (null).

    The result is what ``operators.merge.apply_results`` takes. An id counts once.
    """
    extension, content = F.col("extension"), F.col("content")
    files = files.select(key, "extension", "content")
    stats = F.when(extension.isin(*PLAIN), F.to_json(text_stats(content)))
    body = F.when(extension.isin(*PLAIN), excerpt_of_bytes(content, EXCERPT_CAP)).when(extension == "rtf", excerpt_of_text(rtf_text(F.decode(content, "ISO-8859-1")))).when(extension.isin(*WORDS), excerpt_of_text(markup.mac_word_text(content)))
    told = [plain_metadata(files).select(key, F.col("plain"), stats.alias("stats"), body.alias("text"), extension.alias("k_extension"), F.octet_length(content).alias("k_size"))]
    known = {*WALKERS, *OFFICE, *SHEETS, *PDFS, *WORDS}
    met = {r[0] for r in files.where(extension.isin(*known)).select("extension").distinct().collect()}  # some of a fixed list; ways that nothing needs aren't planned
    of = lambda names: files.where(extension.isin(*names))
    if walked := sorted(met & {*WALKERS}):
        told.append(gathered(entries(parts(of(walked), key), key, walked), key).select(key, F.col("deepMeta").alias("walked")))
    if met & {*WORDS}:
        told.append(word_bodies(of(WORDS), key).select(key, F.col("text").alias("word")))
    if met & {*OFFICE}:
        told.append(office_metadata(files, key).select(key, "office", F.col("body").alias("main")))
    if met & {*PDFS}:
        objects = kept(pdf_objects(of(PDFS), key))
        told += [pdf_metadata(objects, key), pdf_text(objects, key).withColumnRenamed("text", "shown"), loose_metadata(loose(objects, key), key).withColumnRenamed("text", "loose")]
    if met & {*SHEETS}:
        told.append(sheet_metadata(kept(cells(of(SHEETS), key)), files, key).withColumnRenamed("body", "cells"))
    every = T.StructType([T.StructField(c, T.StringType()) for c in ("walked", "word", "office", "main", "pdf", "shown", "loose", "sheets", "cells")])
    told.append(files.sparkSession.createDataFrame([], T.StructType([files.schema[key], *every.fields])))  # names that no file has
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), told)
    names = [c for c in rows.columns if c != key]
    rows = rows.groupBy(key).agg(*(F.max(c).alias(c) for c in names))  # of each name one row a file has a value
    extension = F.col("k_extension")
    found = overlaid(F.coalesce("pdf", "plain", overlaid(F.col("walked"), sound_details(F.col("walked"), extension, F.col("k_size"))), "office", "stats"), F.col("sheets"))
    shown = (
        F.when(extension.isin(*PLAIN) | (extension == "rtf"), F.col("text")).when(extension == "docx", excerpt_of_text(F.col("main"))).when(extension.isin("xlsx", "xls", "ods"), excerpt_of_text(F.col("cells")))
        .when(extension == "pdf", F.coalesce("shown", excerpt_of_text(F.col("loose")))).when(extension.isin(*WORDS), F.coalesce("text", excerpt_of_text(F.col("word"))))
    )
    return normalised(rows.select(key, found.alias("deepMeta"), shown.alias("excerpt"), F.lit(None).cast("string").alias("error")))
