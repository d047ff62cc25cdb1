"""Metadata and text held in markup, as Column expressions over decoded text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import hours_minutes, pdf_date, rtf_date, tidy_newlines

# XML elements of office documents and the keys they fill.
CORE = {"title": "dc:title", "subject": "dc:subject", "creator": "dc:creator", "description": "dc:description", "lastModifiedBy": "cp:lastModifiedBy", "revision": "cp:revision", "created": "dcterms:created", "modified": "dcterms:modified", "keywords": "cp:keywords", "category": "cp:category", "contentStatus": "cp:contentStatus", "language": "dc:language"}
APP = {"application": "Application", "appVersion": "AppVersion", "template": "Template", "totalEditingMinutes": "TotalTime", "pages": "Pages", "words": "Words", "characters": "Characters", "charactersWithSpaces": "CharactersWithSpaces", "paragraphs": "Paragraphs", "lines": "Lines", "slides": "Slides", "notes": "Notes", "company": "Company", "manager": "Manager", "hiddenSlides": "HiddenSlides", "presentationFormat": "PresentationFormat", "sharedDoc": "SharedDoc", "hyperlinksChanged": "HyperlinksChanged", "linksUpToDate": "LinksUpToDate", "scaleCrop": "ScaleCrop", "docSecurity": "DocSecurity"}
ODF = {"title": "dc:title", "subject": "dc:subject", "creator": "dc:creator", "description": "dc:description", "created": "meta:creation-date", "modified": "dc:date", "keywords": "meta:keyword", "language": "dc:language", "application": "meta:generator", "revision": "meta:editing-cycles", "totalEditingTime": "meta:editing-duration", "initialCreator": "meta:initial-creator"}
# Single elements and lists of XMP packets.
XMP_SINGLE = {"Format": "dc:format", "CreationDate": "xmp:CreateDate", "ModifyDate": "xmp:ModifyDate", "CreatorTool": "xmp:CreatorTool", "MetadataDate": "xmp:MetadataDate", "DocumentID": "xmpMM:DocumentID", "InstanceID": "xmpMM:InstanceID", "OriginalDocumentID": "xmpMM:OriginalDocumentID", "Producer": "pdf:Producer", "Trapped": "pdf:Trapped", "ICCProfile": "photoshop:ICCProfile"}
XMP_MODES = ["Bitmap", "Grayscale", "Indexed", "RGB", "CMYK", "", "", "Multichannel", "Duotone", "Lab"]
# Control words of an RTF information group.
RTF_TEXT = {"title": "title", "subject": "subject", "author": "author", "manager": "manager", "company": "company", "lastAuthor": "operator", "category": "category", "keywords": "keywords", "comments": "doccomm", "hyperlinkBase": "hlinkbase"}
RTF_DATES = {"created": "creatim", "modified": "revtim", "lastPrinted": "printim"}
RTF_NUMBERS = {"revision": "version", "pageCount": "nofpages", "wordCount": "nofwords", "charCount": "nofchars", "charCountWithSpaces": "nofcharsws", "documentId": "id"}
PDF_INFO = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate")


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null without one or where it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def xml_field(xml: Column, tag: str) -> Column:
    """An element's text without inner tags; entities stay as they are."""
    inner = F.regexp_replace(found(xml, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), "<[^>]+>", "")
    return F.nullif(F.trim(inner), F.lit(""))


def office_fields(xml: Column, names: dict[str, str]) -> dict[str, Column]:
    return {k: xml_field(xml, tag) for k, tag in names.items()}


def custom_properties(xml: Column) -> Column:
    """Name and value of each property of custom.xml, as a map; null without any."""
    each = F.regexp_extract_all(xml, F.lit(r"(?is)(<property\b.*?</property>)"), 1)
    pairs = F.transform(each, lambda p: F.struct(F.regexp_extract(p, r'(?i)name="([^"]*)"', 1).alias("k"), F.trim(F.regexp_replace(p, "<[^>]+>", "")).alias("v")))
    pairs = F.filter(pairs, lambda p: (p["k"] != "") & (p["v"] != ""))
    # of equal names the last counts
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))
    return F.when(F.size(last) > 0, F.map_from_entries(last))


def svg_fields(text: Column) -> dict[str, Column]:
    root = F.regexp_extract(text, r"(?i)<svg[^>]*>", 0)
    attr = lambda name: found(root, rf"""\b{name}\s*=\s*["']([^"']+)""")
    return {
        "SVGWidth": attr("width"), "SVGHeight": attr("height"), "ViewBox": attr("viewBox"),
        "SVGTitle": F.trim(found(text, r"(?i)<title[^>]*>([^<]+)</title>")), "SVGDescription": F.trim(found(text, r"(?i)<desc[^>]*>([^<]+)</desc>")),
        "ColorSpace": F.lit("Vector (SVG)"), "Format": F.lit("SVG/XML"), "ElementCount": element_count(text),
    }


def element_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("<[a-zA-Z]")).cast("long")


def xmp_packet(latin: Column) -> Column:
    """The XMP packet within bytes read one character each, as UTF-8 text; null without one."""
    return F.make_valid_utf8(F.encode(found(latin, r"(?s)(<x:xmpmeta.*?</x:xmpmeta>|<rdf:RDF.*?</rdf:RDF>)"), "ISO-8859-1").cast("string"))


def xmp_fields(xml: Column) -> dict[str, Column]:
    """Element-form properties of a packet; attributes aren't read."""
    items = lambda tag: F.filter(F.transform(F.regexp_extract_all(found(xml, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(r"(?is)<rdf:li[^>]*>([^<]*)</rdf:li>"), 1), lambda x: F.trim(x)), lambda x: x != "")
    first = lambda tag: F.try_element_at(items(tag), F.lit(1))
    joined = lambda tag, by: F.nullif(F.array_join(items(tag), by), F.lit(""))
    single = {k: F.trim(found(xml, rf"(?i)<{tag}>([^<]+)</{tag}>")) for k, tag in XMP_SINGLE.items()}
    mode = found(xml, r"(?i)<photoshop:ColorMode>([^<]+)</photoshop:ColorMode>")
    names = F.array(*(F.lit(x) for x in XMP_MODES))
    named = F.nullif(F.get(names, mode.try_cast("int")), F.lit(""))
    return {
        "Title": first("dc:title"), "Author": joined("dc:creator", "; "), "Description": first("dc:description"),
        "Keywords": joined("dc:subject", ", "), "Rights": first("dc:rights"), **single,
        "PageCount": found(xml, r"(?i)<xmpTPg:NPages>(\d+)").try_cast("long"), "XmpColorMode": F.coalesce(named, mode),
    }


def _pdf_string(latin: Column, key: str) -> Column:
    """A literal or hexadecimal string of an information dictionary."""
    literal = found(latin, rf"/{key}\s*\(((?:[^\\()]++|\\.)*+)\)")
    for a, b in ((r"\n", "\n"), (r"\r", "\r"), (r"\t", "\t"), (r"\(", "("), (r"\)", ")"), ("\\\\", "\\")):
        literal = F.replace(literal, F.lit(a), F.lit(b))
    hexed = F.upper(F.regexp_replace(found(latin, rf"/{key}\s*<([0-9A-Fa-f\s]+)>"), r"\s", ""))
    wide = F.when(hexed.startswith("FEFF"), F.decode(F.unhex(F.substring(hexed, 5, 65_536)), "UTF-16BE")).otherwise(F.decode(F.unhex(hexed), "ISO-8859-1"))
    return F.nullif(F.trim(F.coalesce(literal, wide)), F.lit(""))


def pdf_fields(latin: Column, packet: Column) -> dict[str, Column]:
    """What a PDF's objects and XMP packet tell; ``latin``: its bytes, one character each.

    Objects in compressed streams count where ``sources.office.pdf_contents`` has added them.
    """
    out = {k: pdf_date(_pdf_string(latin, k)) if k.endswith("Date") else _pdf_string(latin, k) for k in PDF_INFO}
    xmp = xmp_fields(packet)
    part = found(latin, r"(?i)<pdfaid:part>(\d+)")
    level = found(latin, r"(?i)<pdfaid:conformance>([A-Za-z]+)")
    for k in ("Title", "Author", "Description", "Keywords", "Producer"):
        out[k] = F.coalesce(out[k], xmp[k]) if k in out else xmp[k]
    return out | {
        "trapped": found(latin, r"/Trapped\s*/(\w+)"), "pdfVersion": found(latin, r"^%PDF-(\d+\.\d+)"),
        "pageCount": F.nullif(F.regexp_count(latin, F.lit(r"/Type\s*/Page(?!\s*s)")).cast("long"), F.lit(0)),
        "encrypted": latin.rlike(r"/Encrypt\s"), "linearized": F.when(F.contains(F.left(latin, F.lit(1024)), F.lit("/Linearized")), True),
        "language": _pdf_string(latin, "Lang"), "hasAcroForm": F.when(latin.rlike(r"/AcroForm\b"), True), "hasXFA": F.when(latin.rlike(r"/XFA\b"), True),
        "isCollection": F.when(latin.rlike(r"/Collection\b"), True), "hasSignatures": F.when(latin.rlike(r"/Type\s*/Sig\b"), True),
        "pdfaConformance": F.concat(F.lit("PDF/A-"), part, F.coalesce(F.lower(level), F.lit(""))),
    }


def rtf_info(text: Column) -> Column:
    """An RTF file's information group, with its braces; null without one, cut off what there is."""
    rest = F.substring(text, F.instr(text, "{\\info"), F.length(text))
    cut = F.regexp_extract_all(rest, F.lit(r"([{}]|\\[{}\\]|[^{}\\]+|\\)"), 1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("done"), F.lit(0).alias("size"))
    step = lambda a, t: F.when(a["done"], a).otherwise(F.struct((a["depth"] + F.when(t == "{", 1).when(t == "}", -1).otherwise(0)).alias("depth"), ((t == "}") & (a["depth"] == 1)).alias("done"), (a["size"] + F.length(t)).alias("size")))
    return F.when(F.contains(text, F.lit("{\\info")), F.left(rest, F.aggregate(cut, start, step)["size"]))


def rtf_fields(text: Column, info: Column) -> dict[str, Column]:
    """An RTF file's information, from its first 32 KB and ``rtf_info`` of them."""
    number = lambda w: found(info, rf"\{{\\{w}(\d+)\}}").try_cast("long")
    clean = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\\[a-z]+-?\d* ?|[{}]", "")), F.lit(""))
    out = {k: clean(found(info, rf"\{{\\{w}\s+((?:[^{{}}\\]|\\.)*)\}}")) for k, w in RTF_TEXT.items()}
    out |= {k: rtf_date(found(info, rf"\{{\\{w}([^}}]*)\}}")) for k, w in RTF_DATES.items()}
    out |= {k: number(w) for k, w in RTF_NUMBERS.items()}
    has = info.isNotNull()
    out["totalEditingTime"] = hours_minutes(number("edmins"))
    out["rtfVersion"] = F.when(has, found(text, r"^\{\\rtf(\d+)"))
    out["defaultLanguageId"] = F.when(has, found(text, r"\\deflang(\d+)").try_cast("long"))
    return out


def docx_text(xml: Column) -> Column:
    """The plain text of a word-processing document's main part."""
    for pattern, to in ((r"<w:p(?:\s[^>]*)?/>", "\n"), ("</w:p>", "\n"), ("<w:tab/>", "\t"), (r"<w:br[^>]*/>", "\n"), ("<[^>]+>", "")):
        xml = F.regexp_replace(xml, pattern, to)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        xml = F.replace(xml, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(xml, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


#: Characters of Macintosh documents that aren't those of ISO-8859-1.
MAC_CHARACTERS = {
    0xA0: "\u00a0", 0xA5: "\u2022", 0xA9: "\u2026", 0xC7: "\u00ab", 0xC8: "\u00bb", 0xC9: "\u2026", 0xCA: "\u00a0", 0xD0: "\u2013", 0xD1: "\u2014", 0xD2: "\u201c", 0xD3: "\u201d",
    0xD4: "\u2018", 0xD5: "\u2019", 0xD6: "\u00f7", 0xE1: "\u00b7",
}
_BINARY = r"[\x00-\x08\x0A-\x0C\x0E-\x1F\x7F-\x9F]"


def mac_word_text(content: Column) -> Column:
    """The text of a Word for Macintosh 4 document; null for other files.

    It follows a header of 256 bytes and ends before 21 bytes in a row that are no text, less the 20
    characters before these.
    """
    latin = F.decode(F.substring(content, 257, 1 << 30), "ISO-8859-1")
    ends = latin.rlike(_BINARY + "{21}")
    text = F.regexp_replace(F.when(ends, F.regexp_extract(latin, rf"(?s)^(.*?){_BINARY}{{21}}", 1)).otherwise(latin), _BINARY, "")
    text = F.translate(F.replace(text, F.lit("\r"), F.lit("\n")), "".join(map(chr, MAC_CHARACTERS)), "".join(MAC_CHARACTERS.values()))
    text = F.when(ends, F.left(text, F.greatest(F.length(text) - 20, F.lit(0)))).otherwise(text)
    return F.when(F.hex(F.substring(content, 1, 4)) == "FE37001C", F.nullif(tidy_newlines(text), F.lit("")))
