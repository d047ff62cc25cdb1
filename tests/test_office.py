"""Workbooks, Word documents and PDF files whose text and cells are read from their bytes."""

import json
import struct
import zlib

import pytest

from quarry.plans.extract import extract
from quarry.sources import office

from .test_formats import package


def workbook():
    cell = lambda at, value, kind="", formula="": f'<c r="{at}"{f" t={chr(34)}{kind}{chr(34)}" if kind else ""}>{formula}<v>{value}</v></c>'
    first = '<worksheet><dimension ref="A1:C3"/><sheetData><row r="1">' + cell("A1", 0, "s") + cell("C1", "2.5") + '</row><row r="3">' + cell("B3", 3, "", "<f>A1+1</f>") + cell("C3", 1, "b") + '</row></sheetData><mergeCells count="1"><mergeCell ref="A2:B2"/></mergeCells></worksheet>'
    second = '<worksheet><sheetData><row r="2"><c r="B2" t="inlineStr"><is><t>x,"y"</t></is></c></row></sheetData></worksheet>'
    return package({
        "[Content_Types].xml": "<Types/>", "xl/workbook.xml": '<workbook><sheets><sheet name="A &amp; B" sheetId="1" r:id="r1"/><sheet name="Two" sheetId="2" state="hidden" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><r><t>Hel</t></r><r><t>lo</t></r></si></sst>", "xl/worksheets/sheet1.xml": first, "xl/worksheets/sheet2.xml": second,
    })


def ole2_with(streams):
    """An OLE2 file of regular streams."""
    end, free = 0xFFFFFFFE, 0xFFFFFFFF
    entry = lambda name, kind, first, size: (name.encode("utf-16le") + b"\0" * 64)[:64] + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<III", first, size, 0)
    fat, tree, body = [0xFFFFFFFD, end], entry("Root Entry", 5, end, 0), b""
    for name, data in streams.items():
        data += b"\0" * (4096 - len(data))
        n = len(data) // 512
        tree += entry(name, 2, len(fat), len(data))
        fat += [*range(len(fat) + 1, len(fat) + n), end]
        body += data
    assert len(tree) == 512
    head = bytes.fromhex("D0CF11E0A1B11AE1") + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6
    head += struct.pack("<IIIIIIIII", 0, 1, 1, 0, 4096, end, 0, end, 0) + struct.pack("<109I", 0, *[free] * 108)
    return head + struct.pack("<128I", *(fat + [free] * (128 - len(fat)))) + tree + body


def document(pieces):
    narrow, wide = "One café line\rnext".encode("cp1252"), "Ωmega end".encode("utf-16le")
    text = b"\0" * 1024 + narrow + wide
    ends = [0, len(narrow), len(narrow) + len(wide) // 2]
    pcd = lambda place: struct.pack("<HIH", 0, place, 0)
    plc = struct.pack("<3I", *ends) + pcd(1024 * 2 | 1 << 30) + pcd(1024 + len(narrow))
    clx = b"\x01" + struct.pack("<H", 3) + b"abc" + b"\x02" + struct.pack("<I", len(plc)) + plc
    fib = bytearray(text)
    struct.pack_into("<H", fib, 10, 0x200)
    if pieces:
        struct.pack_into("<II", fib, 0x1A2, 0, len(clx))
    pad = {"Data": b"x"}
    return ole2_with({"WordDocument": bytes(fib), "1Table": clx, **pad})


def test_workbook(spark):
    files = spark.createDataFrame([("w", "xlsx", workbook()), ("bad", "xlsx", workbook()[:200])], "id string, extension string, content binary")
    rows = {r["id"]: r for r in extract(files).collect()}
    meta = json.loads(rows["w"]["deepMeta"])
    assert {k: meta[k] for k in ("totalPopulatedCells", "totalFormulas", "totalMergedRegions", "sheetSummary", "dataTypes")} == {
        "totalPopulatedCells": 5, "totalFormulas": 1, "totalMergedRegions": 1, "sheetSummary": "A & B — 3×3 — 4 cells — 1 formulas | Two — 1×1 — 1 cells — (hidden)", "dataTypes": "number: 2, string: 2, boolean: 1",
    }
    assert rows["w"]["excerpt"] == '--- A & B ---\nHello,,2.5\n,,\n,3,1\n--- Two ---\n"x,""y"""'
    assert rows["bad"]["deepMeta"] is None and rows["bad"]["excerpt"] is None


def test_word_text(spark):
    (text,) = next(office.word_text(document(True)))
    assert text == "One café line\nnextΩmega end"
    readable = ole2_with({"WordDocument": b"readable words of a document. " * 140, "Data": b"x", "Other": b"x"})
    assert next(office.word_text(readable))[0].startswith("readable words of a document.")
    assert list(office.word_text(b"no such file")) == []
    files = spark.createDataFrame([("d", "doc", document(True)), ("n", "doc", None)], "id string, extension string, content binary")
    assert {r["id"]: r["excerpt"] for r in extract(files).collect()} == {"d": "One café line\nnextΩmega end", "n": None}


def test_pdf_objects_and_text(spark):
    packed = lambda data, more=b"": b"<</Filter/FlateDecode/Length 1" + more + b">>\nstream\n" + zlib.compress(data) + b"\nendstream\n"
    info = b"1 0 2 30 <</Title (Plan \\(B\\))/Author <FEFF03A9>>> <</Type/Catalog/Lang (de)/AcroForm 3 0 R>> <</Type /Page>> <</Type/Page>>"
    page = b"BT /F1 12 Tf 72 700 Td (Hello) Tj [(wo) -20 (rld)] TJ 0 -14 Td (next \\050line\\051) Tj ET"
    pdf = b"%PDF-1.7\n1 0 obj\n" + packed(info, b"/Type/ObjStm/N 2/First 8") + b"2 0 obj\n" + packed(page) + b"trailer"
    files = spark.createDataFrame([("p", "pdf", pdf), ("cut", "pdf", pdf[:60]), ("plain", "pdf", b"%PDF-1.4 <</Title (T)>>")], "id string, extension string, content binary")
    rows = {r["id"]: r for r in extract(files).collect()}
    meta = json.loads(rows["p"]["deepMeta"])
    assert {k: meta.get(k) for k in ("Title", "Author", "language", "hasAcroForm", "pageCount", "hasXFA")} == {"Title": "Plan (B)", "Author": "Ω", "language": "de", "hasAcroForm": True, "pageCount": 2, "hasXFA": None}
    assert rows["p"]["excerpt"] == "Helloworld\nnext (line)"
    assert rows["cut"]["excerpt"] is None and json.loads(rows["plain"]["deepMeta"])["Title"] == "T"


@pytest.mark.parametrize("walker", [office.workbook_cells, office.word_text, office.pdf_streams])
def test_nothing_in_nothing(walker):
    assert list(walker(b"")) == []
