"""Workbooks of older and open formats, CSV files, sparse sheets, and RTF at any depth."""

import json
import struct

from pyspark.sql import functions as F

from quarry.functions.markup import rtf_fields, rtf_info
from quarry.functions.rtf import rtf_text
from quarry.plans.extract import extract
from quarry.plans.sheets import cells, sheet_text
from quarry.sources import sheets

from .test_formats import package
from .test_office import ole2_with

SCHEMA = "id string, extension string, content binary"


def record(kind, *data):
    data = b"".join(data)
    return struct.pack("<HH", kind, len(data)) + data


def text8(text, wide=False):
    return struct.pack("<HB", len(text), int(wide)) + text.encode("utf-16le" if wide else "latin-1")


def biff():
    """Two sheets: shared strings cut across continuations, numbers of each kind, formulas, errors."""
    long = "long é " * 30
    head = struct.pack("<II", 9, 4) + text8("Hello") + struct.pack("<HBH", 4, 8, 1) + b"rich" + b"\0" * 4 + struct.pack("<HB", len(long) * 2, 0) + long.encode("latin-1")
    sst = record(sheets.SST, head) + record(sheets.CONTINUE, b"\1" + long.encode("utf-16le") + struct.pack("<H", 2)[:1]) + record(sheets.CONTINUE, struct.pack("<H", 2)[1:] + b"\1" + "Ωx".encode("utf-16le"))
    rk = lambda n: struct.pack("<HI", 0, n)
    at = lambda r, c: struct.pack("<HHH", r, c, 0)
    hundredth = struct.unpack("<I", struct.pack("<d", 12.5)[4:])[0] & ~3 | 1
    one = [
        record(sheets.DIMENSIONS, struct.pack("<IIHHH", 0, 4, 0, 3, 0)),
        *(record(sheets.LABELSST, at(r, c), struct.pack("<I", i)) for r, c, i in ((0, 0, 0), (0, 1, 1), (0, 2, 3))),
        record(sheets.NUMBER, at(1, 0), struct.pack("<d", 2.5)), record(sheets.RK, struct.pack("<HH", 1, 1), rk((7 << 2) | 2)), record(sheets.MULRK, struct.pack("<HH", 2, 0), rk(hundredth), rk((-3 & 0x3FFFFFFF) << 2 | 2), struct.pack("<H", 1)),
        record(sheets.BOOLERR, at(1, 2), b"\1\0"), record(sheets.BOOLERR, at(2, 2), b"\x2a\1"),
        record(sheets.FORMULA, at(3, 0), struct.pack("<d", -1e300), b"\0" * 8), record(sheets.FORMULA, at(3, 1), b"\0\0\0\0\0\0\xff\xff", b"\0" * 8), record(sheets.STRING, text8("Ωk", True)),
        record(sheets.FORMULA, at(3, 2), b"\1\0\0\0\0\0\xff\xff", b"\0" * 8), record(sheets.MERGES, struct.pack("<H", 2), b"\0" * 16), record(0x0A),
    ]
    two = [record(sheets.LABEL, at(4, 4), text8("alone")), record(0x0A)]
    bof = record(sheets.BOF, struct.pack("<HHHH", 0x600, 5, 0, 0))
    bound = lambda place, hidden, name: record(sheets.BOUNDSHEET, struct.pack("<IBB", place, hidden, 0), struct.pack("<BB", len(name), 0), name)
    size = len(bof) + len(bound(0, 0, b"First") + bound(0, 0, b"Other") + bound(0, 0, b"None")) + len(sst) + 4
    first = size
    second = first + len(bof) + sum(map(len, one))
    third = second + len(bof) + sum(map(len, two))
    book = bof + bound(first, 0, b"First") + bound(second, 2, b"Other") + bound(third, 0, b"None") + sst + record(0x0A)
    return ole2_with({"Workbook": book + bof + b"".join(one) + bof + b"".join(two) + bof + record(0x0A), "A": b"x", "B": b"x"}), long


def test_biff_workbook(spark):
    content, long = biff()
    got = extract(spark.createDataFrame([("x", "xls", content), ("cut", "xls", content[:3000]), ("no", "xls", b"x")], SCHEMA)).collect()
    found = {r["id"]: r for r in got}
    meta = json.loads(found["x"]["deepMeta"])
    assert {k: meta[k] for k in ("sheetCount", "sheetNames", "totalPopulatedCells", "totalFormulas", "totalMergedRegions", "hiddenSheets", "sheetSummary", "dataTypes")} == {
        "sheetCount": 3, "sheetNames": "First, Other, None", "totalPopulatedCells": 13, "totalFormulas": 3, "totalMergedRegions": 2, "hiddenSheets": "Other",
        "sheetSummary": "First — 4×3 — 12 cells — 3 formulas | Other — 1×1 — 1 cells — (very hidden) | None — 0 cells", "dataTypes": "number: 5, string: 5, boolean: 2, error: 1",
    }
    assert found["x"]["excerpt"] == "--- First ---\nHello,rich,Ωx\n2.5,7,TRUE\n0.125,-3,#N/A\n-1.0E+300,Ωk,FALSE\n--- Other ---\nalone"
    assert found["no"]["excerpt"] is None
    texts = {r[2]: r[5].decode() for r in sheets.biff_records(content) if r[1] == sheets.SST}
    assert texts == {0: "Hello", 1: "rich", 2: long * 2, 3: "Ωx"}


def ods():
    cell = lambda more, text="": f"<table:table-cell {more}><text:p>{text}</text:p></table:table-cell>"
    rows = (
        '<table:table-row><table:table-cell table:number-columns-repeated="2"/>' + cell('office:value-type="string"', "a<text:s text:c=\"2\"/>&amp;b") + "</table:table-row>"
        '<table:table-row table:number-rows-repeated="1000000"><table:table-cell table:number-columns-repeated="16384"/></table:table-row>'
        '<table:table-row table:number-rows-repeated="2">' + cell('office:value-type="float" office:value="1.5" table:number-columns-repeated="3"', "1.50") + cell('table:formula="of:=1" office:value-type="boolean" office:boolean-value="true"', "TRUE") + "</table:table-row>"
        '<table:table-row table:number-rows-repeated="40000"><table:table-cell table:number-columns-repeated="16384"/></table:table-row>'
    )
    style = '<style:style style:name="ta2" style:family="table"><style:table-properties table:display="false"/></style:style>'
    second = f'<table:table table:name="H" table:style-name="ta2"><table:table-row>{cell(chr(32).join(["office:value-type=" + chr(34) + "date" + chr(34), "table:number-columns-spanned=" + chr(34) + "2" + chr(34)]), "1 May")}<table:covered-table-cell/></table:table-row></table:table>'
    return package({"content.xml": f'<office:document>{style}<table:table table:name="S &amp; T">{rows}</table:table>{second}</office:document>', "meta.xml": "<x/>"})


def test_opendocument_sheets(spark):
    row = extract(spark.createDataFrame([("o", "ods", ods())], SCHEMA)).first()
    meta = json.loads(row["deepMeta"])
    assert {k: meta[k] for k in ("sheetCount", "sheetNames", "totalPopulatedCells", "totalFormulas", "hiddenSheets", "sheetSummary", "dataTypes", "totalMergedRegions")} == {
        "sheetCount": 2, "sheetNames": "S & T, H", "totalPopulatedCells": 10, "totalFormulas": 2, "hiddenSheets": "H", "totalMergedRegions": 1,
        "sheetSummary": "S & T — 1000003×4 — 9 cells — 2 formulas | H — 1×1 — 1 cells — (hidden)", "dataTypes": "number: 6, boolean: 2, date: 1, string: 1",
    }
    assert row["excerpt"].startswith("--- S & T ---\n,,a  &b,\n,,,\n,,,\n")


def test_csv_cells_and_text_statistics(spark):
    content = 'a;"b;""c""";1\n\ntrue;2,5;-3e4\n"two\nlines";;x\n'.encode()
    row = extract(spark.createDataFrame([("c", "csv", content), ("e", "csv", b"")], SCHEMA)).where("id = 'c'").first()
    meta = json.loads(row["deepMeta"])
    assert meta["wordCount"] > 0 and meta["sheetSummary"] == "Sheet1 — 4×3 — 8 cells" and meta["dataTypes"] == "string: 5, number: 2, boolean: 1" and row["excerpt"] == content.decode()


def test_far_cells_cost_nothing(spark):
    far = '<worksheet><sheetData><c r="A1"><v>1</v></c><c r="B1"><v>2</v></c><c r="XFD1048576"><v>9</v></c></sheetData></worksheet>'
    book = package({"xl/workbook.xml": '<sheets><sheet name="A" sheetId="1"/></sheets>', "xl/worksheets/sheet1.xml": far})
    found = cells(spark.createDataFrame([("f", "xlsx", book)], SCHEMA)).cache()
    assert found.count() == 3
    body = sheet_text(found).first()["body"]
    assert body.startswith("1,2" + "," * 16_382 + "\n,,,") and len(body) < 300_000


def test_rtf_groups_nest(spark):
    cases = {
        r"{\rtf1{\info{\title A}}\pard body {\nofpages9 x}}": ("body x", None),
        r"{\rtf1\uc2\u33606\'80\'81!{\uc0\u937 x}{\*\gen {a{b{c{d}e}f}g}}{\header{\b{\i{\ul{deep}}}}}{\b{\i{\ul{\strike four \{x\} deep}}}}\u-10179?\u-8704?.}": (chr(33606) + "!Ωxfour {x} deep😀", None),
        r"{\rtf1{\info{\title A {\b c}}{\nofpages7}}x\par y\tab z\line w{\pict 0102}\'e9\u233?}": ("x\ny\tz\nwéé", 7),
    }
    df = spark.createDataFrame([(k,) for k in cases] + [("",), (None,), ("}}{{ \\",)], "t string")
    text = F.col("t")
    got = {r["t"]: (r["x"], r["p"]) for r in df.select("t", rtf_text(text).alias("x"), rtf_fields(text, rtf_info(text))["pageCount"].alias("p")).collect()}
    assert {k: got[k] for k in cases} == cases and got[None] == (None, None)
