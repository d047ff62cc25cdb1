"""Registered queries of document formats: files built from tables by Column expressions, then read by the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import markup
from .functions.rtf import rtf_text
from .plans import sheets
from .plans.pdf import pdf_metadata, pdf_text
from .queries import _le, _spread, _t, query
from .sources import sheets as source
from .sources.pdf import pdf_objects
from .work import kept


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _revision(before: Column, objects: list[tuple[int, Column]], trailer: Column) -> tuple[Column, Column]:
    """A PDF file with one more revision: its bytes, and the place of its cross-reference table."""
    content, entries = before, []
    for number, body in objects:
        entries.append(_text(f"{number} 1\n", F.lpad(F.octet_length(content).cast("string"), 10, "0"), " 00000 n \n"))
        content = _text(content, f"{number} 0 obj\n", body, "\nendobj\n")
    place = F.octet_length(content)
    return _text(content, "xref\n", *entries, "trailer\n<<", trailer, ">>\nstartxref\n", place, "\n%%EOF\n"), place


@query("""select c_custkey, c_name as title, 'Ann' as author, c_mktsegment as segment, (c_nationkey + 1)::bigint as pages, c_custkey % 2 = 0 as signed, c_custkey % 3 = 0 as has_form, false as encrypted from customer""")
def pdf_object_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updated files: the title by a reference, the last information of two, custom entries, forms and signatures."""
    form = F.when(F.col("c_custkey") % 6 == 0, "/AcroForm 6 0 R").when(F.col("c_custkey") % 2 == 0, "/AcroForm<</SigFlags 1/Fields[]>>").when(F.col("c_custkey") % 3 == 0, "/AcroForm<</Fields[9 0 R]>>").otherwise("")
    first, place = _revision(
        F.lit("%PDF-1.5\n"), [(1, _text("<</Type/Catalog/Pages 2 0 R", form, ">>")), (2, _text("<</Type/Pages/Kids[]/Count ", F.col("c_nationkey") + 1, ">>")), (3, F.lit("<</Title(old)/Author(nobody)>>")), (6, F.lit("<</SigFlags 3/Fields[9 0 R]>>"))], F.lit("/Root 1 0 R/Info 3 0 R")
    )
    content, _ = _revision(first, [(3, _text("<</Title 4 0 R/Author<416E6E>/Segment(", F.col("c_mktsegment"), ")>>")), (4, _text("(", F.col("c_name"), ")"))], _text("/Root 1 0 R/Info 3 0 R/Prev ", place))
    objects = kept(pdf_objects(_t(spark, sf_dir, "customer").select("c_custkey", F.encode(content, "ISO-8859-1").alias("content")), "c_custkey"))
    told = lambda k: F.get_json_object("pdf", f"$.{k}")
    flag = lambda k: F.coalesce(told(k) == "true", F.lit(False))
    return pdf_metadata(objects, "c_custkey").select(
        "c_custkey", told("Title").alias("title"), told("Author").alias("author"), told("custom_Segment").alias("segment"), told("pageCount").cast("long").alias("pages"),
        flag("hasSignatures").alias("signed"), flag("hasAcroForm").alias("has_form"), flag("encrypted").alias("encrypted"),
    )


@query("select s_suppkey, s_name || chr(10) || 'nation ' || s_nationkey || chr(10) || chr(10) || s_name as text from supplier")
def pdf_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of two fonts, one with codes that only its ToUnicode map explains; a line, and a second page."""
    codes = F.array_join(F.transform(F.split("s_name", ""), lambda c: F.lpad(F.hex(F.ascii(c) + 300), 4, "0")), "")
    stream = lambda body: _text("<</Length ", F.octet_length(body), ">>\nstream\n", body, "\nendstream")
    page = stream(_text("BT /F2 12 Tf 50 700 Td <", codes, "> Tj /F1 12 Tf 0 -14 Td (nation ", F.col("s_nationkey"), ") Tj ET"))
    cmap = stream(F.lit("begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <014C> <01AA> <0020> endbfrange endcmap"))
    objects = [
        (1, F.lit("<</Type/Catalog/Pages 2 0 R>>")), (2, F.lit("<</Type/Pages/Kids[3 0 R 4 0 R]/Count 2/Resources<</Font<</F1 5 0 R/F2 6 0 R>>>>>>")), (3, F.lit("<</Type/Page/Parent 2 0 R/Contents 8 0 R>>")),
        (4, F.lit("<</Type/Page/Parent 2 0 R/Contents[9 0 R]>>")), (5, F.lit("<</Type/Font/Subtype/Type1>>")), (6, F.lit("<</Type/Font/Subtype/Type0/ToUnicode 7 0 R>>")), (7, cmap), (8, page), (9, stream(_text("BT /F1 9 Tf (", F.col("s_name"), ") Tj ET"))),
    ]
    content, _ = _revision(F.lit("%PDF-1.5\n"), objects, F.lit("/Root 1 0 R"))
    found = kept(pdf_objects(_t(spark, sf_dir, "supplier").select("s_suppkey", F.encode(content, "ISO-8859-1").alias("content")), "s_suppkey"))
    return pdf_text(found, "s_suppkey")


def _biff(kind: int, data: Column) -> Column:
    return F.concat(_le(F.lit(kind), 2), _le(F.octet_length(data), 2), data)


def _string8(text: Column) -> Column:
    return F.concat(_le(F.length(text), 2), F.unhex(F.lit("00")), F.encode(text, "ISO-8859-1"))


def _ole2(stream: Column, sectors: int) -> Column:
    """An OLE2 file whose Workbook stream fills so many sectors of 512 bytes: header, FAT, directory, stream."""
    padded = F.concat(stream, F.unhex(F.repeat(F.lit("00"), sectors * 512 - F.octet_length(stream))))
    hexed = lambda n: F.unhex(F.lit("00" * n))
    word = lambda *x: F.concat(*(_le(F.lit(v)) for v in x))
    free, end = 0xFFFFFFFF, 0xFFFFFFFE
    entry = lambda name, kind, first, size: F.concat(F.lit((name.encode("utf-16le") + bytes(64))[:64]), _le(F.lit(2 * len(name) + 2), 2), F.unhex(F.lit(f"{kind:02x}01" + "ff" * 12 + "00" * 36)), word(first, size, 0))
    fat = [0xFFFFFFFD, end, *range(3, 2 + sectors), end]
    head = F.concat(F.unhex(F.lit("D0CF11E0A1B11AE1" + "00" * 16 + "3E000300FEFF09000600" + "00" * 6)), word(0, 1, 1, 0, 4096, end, 0, end, 0), word(0), F.unhex(F.lit("ff" * 4 * 108)))
    tree = F.concat(entry("Root Entry", 5, end, 0), entry("Workbook", 2, 2, sectors * 512), hexed(256))
    return F.concat(head, word(*fat, *[free] * (128 - len(fat))), tree, padded)


@query("""select p_partkey, row, col, kind, text, formula from (select p_partkey, unnest([1, 1, 2, 2]) as row, unnest([1, 2, 1, 2]) as col, unnest(['string', 'string', 'number', 'number']) as kind,
  unnest([p_name, p_brand, p_size::varchar, (p_partkey * 2)::varchar]) as text, unnest([false, false, false, true]) as formula from part)""")
def biff_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbooks with a shared string that a continuation cuts, a small number and a formula's value."""
    brand = F.encode("p_brand", "ISO-8859-1")
    sst = F.concat(_biff(source.SST, F.concat(_le(F.lit(2)), _le(F.lit(2)), _string8(F.col("p_name")), _le(F.length("p_brand"), 2), F.unhex(F.lit("00")), F.substring(brand, 1, 3))), _biff(source.CONTINUE, F.concat(F.unhex(F.lit("00")), F.substring(brand, 4, 100))))
    at = lambda r, c: F.concat(_le(F.lit(r), 2), _le(F.lit(c), 2), F.unhex(F.lit("0000")))
    # The double of 2 * p_partkey by its sign, exponent and mantissa.
    value = F.col("p_partkey") * 2
    bits = F.when(value > 0, F.length(F.bin(value)) - 1).otherwise(0)
    two = lambda n: F.pow(F.lit(2.0), n).cast("long")
    double = F.when(value == 0, F.unhex(F.lit("00" * 8))).otherwise(_le((bits + 1023).cast("long") * 2**52 + (value - two(bits)) * two(52 - bits), 8))
    one = F.concat(
        _biff(source.LABELSST, F.concat(at(0, 0), _le(F.lit(0)))), _biff(source.LABELSST, F.concat(at(0, 1), _le(F.lit(1)))), _biff(source.RK, F.concat(at(1, 0), _le(F.col("p_size").cast("long") * 4 + 2))),
        _biff(source.FORMULA, F.concat(at(1, 1), F.col("double"), F.unhex(F.lit("00" * 8)))), _biff(0x0A, F.unhex(F.lit(""))),
    )
    bof = _biff(source.BOF, F.unhex(F.lit("0006050000000000")))
    bound = lambda place: _biff(source.BOUNDSHEET, F.concat(_le(place), F.unhex(F.lit("00000300")), F.lit(b"One")))
    rows = _spread(_t(spark, sf_dir, "part")).withColumns({"sst": sst, "double": double, "bof": bof})  # steps, so that each part is made once
    rows = rows.withColumn("one", one).withColumn("bound", bound(F.octet_length("bof") + F.octet_length("sst") + 15))
    files = rows.withColumn("stream", F.concat("bof", "bound", "sst", "bof", "one")).select("p_partkey", _ole2(F.col("stream"), 9).alias("content"))
    cells = sheets.biff_cells(kept(source.records(files, "p_partkey")), "p_partkey")
    return cells.select("p_partkey", "row", "col", "kind", "text", "formula")


@query("""select s_suppkey, 2 + s_nationkey + 1 as cells, (100002 + s_nationkey + 1)::int as high, 3 as wide, md5(s_name || ',,' || chr(10) || repeat(',,' || chr(10), 3) ) as digest from supplier""")
def opendocument_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets whose 100,000 empty rows cost nothing, and whose repeated filled row counts as many times as it says."""
    cell = lambda text, more="": _text(f'<table:table-cell office:value-type="string"{more}><text:p>', text, "</text:p></table:table-cell>")
    xml = _text(
        '<office:spreadsheet><table:table table:name="S"><table:table-row>', cell(F.col("s_name")), '<table:table-cell table:number-columns-repeated="16383"/></table:table-row>',
        '<table:table-row table:number-rows-repeated="100000"><table:table-cell table:number-columns-repeated="16384"/></table:table-row><table:table-row table:number-rows-repeated="', F.col("s_nationkey") + 1, '">',
        '<table:table-cell table:number-columns-repeated="2"/>', cell(F.lit("x")), "</table:table-row><table:table-row>", cell(F.lit("end")), "</table:table-row></table:table></office:spreadsheet>",
    )
    body, name = F.encode(xml, "UTF-8"), b"content.xml"
    size = F.octet_length(body)
    entry = lambda more: F.concat(_le(F.lit(20), 2), F.unhex(F.lit("0000" * 2 + "00000000" + "00000000")), _le(size), _le(size), _le(F.lit(len(name)), 2), F.unhex(F.lit("0000")), more)
    local, central = F.concat(F.lit(b"PK\3\4"), entry(F.lit(name)), body), F.concat(F.lit(b"PK\1\2"), _le(F.lit(20), 2), entry(F.unhex(F.lit("00" * 14))), F.lit(name))
    end = F.concat(F.lit(b"PK\5\6"), F.unhex(F.lit("00000000" + "0100" * 2)), _le(F.octet_length(central)), _le(F.octet_length(local)), F.unhex(F.lit("0000")))
    files = _t(spark, sf_dir, "supplier").select("s_suppkey", F.concat(local, central, end).alias("content"))
    cells = kept(sheets.expanded(source.spanned(files, "s_suppkey"), "s_suppkey"))
    counts = cells.groupBy("s_suppkey").agg(F.count("*").cast("int").alias("cells"), F.max("high").alias("high"), F.max("wide").alias("wide"))
    lines = F.slice(F.split("body", "\n"), 1, 4)
    text = sheets.sheet_text(cells, "s_suppkey").select("s_suppkey", F.md5(F.concat(F.array_join(lines, "\n"), F.lit("\n"))).alias("digest"))
    return counts.join(text, "s_suppkey")


@query("select page_id, length(url)::bigint as characters, lower(hex(url)) as digits, page_id + 1 as pages from pages")
def rtf_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs within groups four deep, among hidden ones as deep; the information ends with its group."""
    escaped = F.regexp_replace("url", r"([\\{}])", r"\\$1")
    text = _text(r"{\rtf1\ansi{\info{\title T{\b x}}{\nofpages", F.col("page_id") + 1, r"}}{\header{\b{\i{\ul hidden}}}}{\*\gen{a{b{c}}}}{\b{\i{\ul{\strike ", escaped, r"}}}}{\pict{a{b}}}{\nofpages9 }\uc0\u32}")
    rows = _t(spark, sf_dir, "pages").select("page_id", text.alias("t"))
    rows = rows.select("page_id", rtf_text(F.col("t")).alias("x"), markup.rtf_fields(F.col("t"), markup.rtf_info(F.col("t")))["pageCount"].alias("pages"))
    return rows.select("page_id", F.length("x").cast("long").alias("characters"), F.lower(F.hex("x")).alias("digits"), "pages")
