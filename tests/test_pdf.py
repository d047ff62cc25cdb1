"""PDF files: object graphs, updates, cross-reference streams, and text of two fonts."""

import json
import zlib

from quarry.plans.extract import extract
from quarry.plans.pdf import pdf_metadata, pdf_text, xmp_properties
from quarry.sources import pdf
from pyspark.sql import functions as F

SCHEMA = "id string, extension string, content binary"
XMP = b"""<?xpacket begin=''?><x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF><rdf:Description rdf:about=""><dc:title><rdf:Alt><rdf:li xml:lang="x-default">From XMP</rdf:li></rdf:Alt></dc:title>
<DC:Creator><rdf:Seq><rdf:li>Ann</rdf:li><rdf:li>Bo &amp; Co</rdf:li></rdf:Seq></DC:Creator><xmpMM:DocumentID>uuid:1</xmpMM:DocumentID><pdfaid:part>2</pdfaid:part><pdfaid:conformance>B</pdfaid:conformance>
<xmp:Rating>4</xmp:Rating><prism:copyright> none </prism:copyright></rdf:Description></rdf:RDF></x:xmpmeta>"""
CMAP = b"""begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0003> <0020> <0105> <00660066> endbfchar
2 beginbfrange <0010> <0030> <0041> <00F0> <0101> <03B1> endbfrange 1 beginbfrange <0200> <0201> [<0058> <D83DDE00>] endbfrange endcmap"""


def stream(data, more=b"", packed=True):
    body = zlib.compress(data) if packed else data
    return b"<</Length %d%s%s>>\nstream\n" % (len(body), b"/Filter/FlateDecode" if packed else b"", more) + body + b"\nendstream"


def with_table(objects, trailer, before=b"%PDF-1.4\n", prev=None):
    """``before`` and a revision with a cross-reference table."""
    out, places = before, {}
    for number, body in objects.items():
        places[number] = len(out)
        out += b"%d 0 obj\n" % number + body + b"\nendobj\n"
    start = len(out)
    out += b"xref\n" + b"".join(b"%d 1\n%010d 00000 n \n" % x for x in places.items())
    return out + b"trailer\n<<" + trailer + (b"/Prev %d" % prev if prev is not None else b"") + b">>\nstartxref\n%d\n%%%%EOF\n" % start, start


def predicted(rows):
    """PNG rows, a filter each."""
    out, above = b"", bytes(len(rows[0]))
    for i, row in enumerate(rows):
        kind, made = i % 5, bytearray()
        for j, x in enumerate(row):
            left, up, corner = row[j - 1] if j else 0, above[j], above[j - 1] if j else 0
            guess = left + up - corner
            paeth = min((left, up, corner), key=lambda v: abs(guess - v))
            made.append((x - (0, left, up, (left + up) // 2, paeth)[kind]) & 255)
        out, above = out + bytes([kind]) + bytes(made), row
    return out


def with_stream(objects, inner, trailer):
    """Objects of ``inner`` in an object stream, and a predicted cross-reference stream."""
    heads, body = b"", b""
    for n, x in inner.items():
        heads, body = heads + b"%d %d " % (n, len(body)), body + x + b" "
    holder = max([*objects, *inner]) + 1
    objects = objects | {holder: stream(heads + body, b"/Type/ObjStm/N %d/First %d" % (len(inner), len(heads)))}
    out, rows = b"%PDF-1.6\n", {0: bytes(6)}
    for n, x in objects.items():
        rows[n] = b"\1" + len(out).to_bytes(4, "big") + b"\0"
        out += b"%d 0 obj\n" % n + x + b"\nendobj\n"
    rows |= {n: b"\2" + holder.to_bytes(4, "big") + bytes([i]) for i, n in enumerate(inner)}
    rows[holder + 1] = b"\1" + len(out).to_bytes(4, "big") + b"\0"
    table = predicted([rows[n] for n in sorted(rows)])
    more = b"/Type/XRef/W[1 4 1]/Size %d/Index[%s]/DecodeParms<</Predictor 15/Columns 6>>" % (holder + 2, b" ".join(b"%d 1" % n for n in sorted(rows))) + trailer
    return out + b"%d 0 obj\n" % (holder + 1) + stream(table, more) + b"\nendobj\nstartxref\n%d\n%%%%EOF" % len(out)


CATALOG = b"<</Type/Catalog/Pages 2 0 R/AcroForm<</Fields[9 0 R]/SigFlags 3>>/Lang(de)/Metadata 8 0 R/Names<</A<</B 1>>>>>>"
PAGES = b"<</Type/Pages/Kids[3 0 R 4 0 R]/Count 3/Resources<</Font<</F1 10 0 R/F2 11 0 R>>>>>>"
TREE = {3: b"<</Type/Page/Parent 2 0 R/Contents[20 0 R 21 0 R]>>", 4: b"<</Type/Pages/Kids[5 0 R 6 0 R]/Parent 2 0 R>>", 5: b"<</Type/Page/Contents 22 0 R/Resources 30 0 R>>", 6: b"<</Type/Page>>"}
FONTS = {10: b"<</Type/Font/Subtype/Type1/Encoding<</Differences[65/eacute/B 200/uni03A9]>>>>", 11: b"<</Type/Font/Subtype/Type0/ToUnicode 12 0 R>>", 12: stream(CMAP), 30: b"<</Font 31 0 R>>", 31: b"<</F9 11 0 R>>"}
CONTENT = {
    20: stream(b"q 1 0 0 1 0 100 cm BT /F1 12 Tf 72 700 Td (A\\102\\(x\\)\\310 \\223q\\224) Tj 0 -14 Td [(wo) -20 (rd) -300 (next)] TJ"),
    21: stream(b"/F2 10 Tf 0 -30 Td <0010 0011 0003> Tj <0100> Tj <0105 0200 0201> Tj T* (\\000\\020) ' ET Q BI /W 1 ID (x EI"),
    22: stream(b"BT /F9 10 Tf 1 0 0 1 0 50 Tm <00100012> Tj ET"),
}
TEXT = "éB(x)Ω “q”\nword next\n\nAB ρffX😀A\n\nAC"


def files(spark):
    base = {1: CATALOG, 2: PAGES, 7: b"<</Title(old)/Author(First)/Keywords(lost)>>", 8: stream(XMP, packed=False), **TREE, **FONTS, **CONTENT}
    old, start = with_table(base, b"/Root 1 0 R/Info 7 0 R/Size 40")
    update = {7: b"<</Title 33 0 R/Subject<FEFF03A9>/Company(A \\(b\\) (c))/Pages 3/CreationDate(D:20230102)/Trapped/False>>", 33: b"(New \\245 title)"}
    new, _ = with_table(update, b"/Root 1 0 R/Info 7 0 R/Size 40", old, start)
    inner = {1: CATALOG, 2: PAGES, **TREE, **{k: v for k, v in FONTS.items() if k != 12}, **update}
    packed = with_stream({12: FONTS[12], 8: base[8], **CONTENT}, inner, b"/Root 1 0 R/Info 7 0 R")
    loose = old[: old.rindex(b"startxref")]
    sealed, _ = with_table(base, b"/Root 1 0 R/Info 7 0 R/Encrypt 50 0 R")
    cycle, _ = with_table({1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[2 0 R 3 0 R]/Count 1>>", 3: b"<</Type/Page/Contents 99 0 R>>"}, b"/Root 1 0 R")
    rows = [("new", new), ("packed", packed), ("old", old), ("loose", loose), ("sealed", sealed), ("cycle", cycle), ("cut", new[:200]), ("none", None), ("no", b"no pdf")]
    return spark.createDataFrame([(k, "pdf", v) for k, v in rows], SCHEMA)


def test_object_graph(spark):
    objects = pdf.pdf_objects(files(spark)).cache()
    found = {r["id"]: json.loads(r["pdf"]) for r in pdf_metadata(objects).collect()}
    want = {
        "Title": "New • title".replace("•", "¥"), "Author": "Ann,Bo & Co", "Subject": "Ω", "CreationDate": "2023-01-02T00:00:00.000Z", "Trapped": "False", "pdfVersion": "1.4", "language": "de", "hasAcroForm": True,
        "hasSignatures": True, "custom_Company": "A (b) (c)", "custom_Pages": "3", "pageCount": 3, "encrypted": False, "rating": "4", "pdfaConformance": "PDF/A-2b", "documentId": "uuid:1", "copyright": "none",
    }
    assert found["new"] == want and found["packed"] == want | {"pdfVersion": "1.6"}
    assert {k: found["old"].get(k) for k in ("Title", "Author", "Keywords")} == {"Title": "old", "Author": "First", "Keywords": "lost"} == {k: found["loose"].get(k) for k in ("Title", "Author", "Keywords")}
    assert found["sealed"] == {"pdfVersion": "1.4", "hasAcroForm": True, "hasSignatures": True, "pageCount": 3, "encrypted": True}
    assert found["cycle"]["pageCount"] == 1 and "none" not in found and "no" not in found


def test_text_by_fonts_and_places(spark):
    objects = pdf.pdf_objects(files(spark)).cache()
    found = {r["id"]: r["text"] for r in pdf_text(objects).collect()}
    assert found["new"] == TEXT and found["packed"] == TEXT and found["loose"] == TEXT
    assert "cycle" not in found


def test_extract_takes_both(spark):
    found = {r["id"]: r for r in extract(files(spark)).collect()}
    assert found["new"]["excerpt"] == TEXT and found["new"]["title"] == "New ¥ title" and found["new"]["extent"] == "3"
    assert found["none"]["deepMeta"] is None and found["no"]["deepMeta"] is None and found["no"]["excerpt"] is None


def test_damaged_streams_give_what_came_before():
    data = zlib.compress(bytes(range(256)) * 400)
    assert pdf.unfiltered(b"<</Filter/FlateDecode>>", data[:-40])[:1000] == (bytes(range(256)) * 400)[:1000]
    assert pdf.unfiltered(b"<</Filter[/ASCIIHexDecode]>>", b"4 1 4>") == b"A@"
    assert pdf.unfiltered(b"<</Filter/ASCII85Decode>>", b"<~87cURD]~>".replace(b"<~", b"")) == b"Hello"
    assert list(pdf.objects_of(b"%PDF-")) and list(pdf.objects_of(b"")) == []
    assert [s[2] for s in pdf.strings_shown(b"BT (a) Tj (b(c)\\)) Tj <4> Tj [(x) 5 ] TJ")] == [b"a", b"b(c))", b"@", b"x"]


def test_long_values_need_no_stack(spark):
    body = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[]/Count 1>>", 3: b"<</Title(" + b"long \\) (x) " * 20_000 + b")>>"}
    content, _ = with_table(body, b"/Root 1 0 R/Info 3 0 R")
    found = pdf_metadata(pdf.pdf_objects(spark.createDataFrame([("a", "pdf", content)], SCHEMA))).first()
    assert len(json.loads(found["pdf"])["Title"]) == len("long ) (x) ") * 20_000 - 1


def test_xmp_properties_of_nothing(spark):
    row = spark.createDataFrame([(None,), ("",), ("<a:b>1</a:b><A:B>2</A:B>",)], "x string").select(xmp_properties(F.col("x")).alias("m")).collect()
    assert [r["m"] for r in row] == [None, {}, {"a:b": "1"}]
