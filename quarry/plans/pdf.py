"""What the objects of PDF files say: references are resolved by joins on (file, object number).

``objects``: rows of ``sources.pdf.pdf_objects``, written once. Metadata takes two joins: the objects that
trailers name (catalogue and information), then those that these name. Text follows the page tree level by
level, and each page's fonts to their ToUnicode maps, whose code ranges are joined to the codes shown.
Encrypted files give their flags alone. Text within form objects isn't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.markup import found, xmp_packet
from ..functions.scalars import excerpt_of_text, pdf_date, windows_1252
from ..functions.values import EXCERPT_CAP
from ..sources.pdf import LOOSE, TRAILER, shown_strings
from ..work import kept

# Names of an information dictionary, and what XMP properties fill where it has a gap.
INFO = "Title Author Subject Keywords Creator Producer CreationDate ModDate Trapped".split()
XMP_GAPS = {
    "dc:title": "Title", "dc:creator": "Author", "dc:subject": "Subject", "dc:description": "Description", "dc:rights": "rights", "dc:language": "language", "dc:format": "format",
    "xmp:creatortool": "Creator", "xmp:createdate": "CreationDate", "xmp:modifydate": "ModDate", "xmp:metadatadate": "metadataDate", "xmp:label": "label", "xmp:rating": "rating",
    "pdf:producer": "Producer", "pdf:keywords": "Keywords", "pdf:trapped": "Trapped", "pdf:pdfversion": "pdfVersion", "pdfaid:part": "pdfaPart", "pdfaid:conformance": "pdfaConformance",
    "pdfaid:amd": "pdfaAmendment", "pdfuaid:part": "pdfuaPart", "xmprights:webstatement": "rightsWebStatement", "xmprights:marked": "rightsMarked", "xmpmm:documentid": "documentId",
    "xmpmm:instanceid": "instanceId", "xmpmm:versionid": "versionId", "xmpmm:renditionclass": "renditionClass", "photoshop:colormode": "colorMode", "photoshop:iccprofile": "iccProfile",
    "prism:aggregationtype": "aggregationType", "prism:copyright": "copyright",
}
#: Characters 0x80 to 0x9E of the encoding of text strings.
DOC_ENCODING = "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž"
#: Glyph names of encodings' differences that aren't the character itself.
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+",
    "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "colon": ":",
    "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "underscore": "_", "braceleft": "{", "bar": "|", "braceright": "}",
    "endash": "–", "emdash": "—", "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "bullet": "•", "ellipsis": "…", "fi": "ﬁ", "fl": "ﬂ", "germandbls": "ß", "adieresis": "ä",
    "odieresis": "ö", "udieresis": "ü", "Adieresis": "Ä", "Odieresis": "Ö", "Udieresis": "Ü", "eacute": "é", "egrave": "è", "ecircumflex": "ê", "agrave": "à", "acircumflex": "â", "ccedilla": "ç", "ntilde": "ñ", "Euro": "€",
}
_HEX = r"<[^<>]*+>"
_DICT = rf"<<(?:[^<>]++|<<(?:[^<>]++|<<(?:[^<>]++|{_HEX})*+>>|{_HEX})*+>>|{_HEX})*+>>"  # possessive, so that long ones need no stack
_STRING = r"\((?:[^\\()]++|\\.|\((?:[^\\()]++|\\.|\((?:[^\\()]++|\\.)*+\))*+\))*+\)|<[0-9A-Fa-f\s]*>"
_PAIR = rf"(?s)/([^\s()<>\[\]{{}}/%]+)\s*({_DICT}|{_STRING}|\[[^\]]*\]|/[^\s()<>\[\]{{}}/%]+|\d+\s+\d+\s+R\b|[^\s()<>\[\]{{}}/%]+)"
MOST_DEEP = 64  # levels of a page tree


def reference(body: Column, name: str) -> Column:
    """The number of the object that a dictionary's entry refers to."""
    return found(body, rf"/{name}\s+(\d+)\s+\d+\s+R\b").try_cast("int")


def within(body: Column, name: str) -> Column:
    """The dictionary that a dictionary's entry holds itself."""
    return found(body, rf"(?s)/{name}\s*({_DICT})")


def pairs(body: Column) -> Column:
    """name and raw value of a dictionary's entries, as an array of structs."""
    inner = F.regexp_replace(body, r"(?s)^\s*<<|>>\s*$", "")
    return F.transform(F.regexp_extract_all(inner, F.lit(_PAIR), 0), lambda p: F.struct(F.regexp_extract(p, _PAIR, 1).alias("name"), F.regexp_extract(p, _PAIR, 2).alias("raw")))


def _octal(p: Column) -> Column:
    digit = lambda i: F.ascii(F.substring(F.lpad(F.substring(p, 2, 3), 3, "0"), i, 1)) - 48
    return F.decode(F.unhex(F.lpad(F.hex((digit(1) * 64 + digit(2) * 8 + digit(3)) % 256), 2, "0")), "ISO-8859-1")


def string_value(raw: Column) -> Column:
    """The text of a literal or hexadecimal string, a name or a number; null for other values."""
    inner = F.substring(raw, 2, F.length(raw) - 2)
    cut = F.regexp_extract_all(inner, F.lit(r"(?s)(\\[0-7]{1,3}|\\\r\n|\\.|[^\\]+)"), 1)
    named = lambda p: F.when(p.rlike(r"^\\[0-7]"), _octal(p)).when(p == r"\n", "\n").when(p == r"\r", "\r").when(p == r"\t", "\t").when(p == r"\b", "\b").when(p == r"\f", "\f").when(p.rlike(r"^\\[\r\n]"), "").when(p.startswith("\\"), F.substring(p, 2, 1)).otherwise(p)
    literal = F.encode(F.array_join(F.transform(cut, named), ""), "ISO-8859-1")
    digits = F.regexp_replace(inner, r"\s", "")
    hexed = F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits))
    data = F.when(raw.startswith("("), literal).when(raw.startswith("<") & ~raw.startswith("<<"), hexed)
    head = F.hex(F.substring(data, 1, 3))
    plain = F.translate(F.decode(data, "ISO-8859-1"), "".join(map(chr, range(0x80, 0x9F))), DOC_ENCODING)
    text = (
        F.when(head.startswith("FEFF"), F.decode(F.substring(data, 3, 1 << 20), "UTF-16BE")).when(head.startswith("FFFE"), F.decode(F.substring(data, 3, 1 << 20), "UTF-16LE"))
        .when(head == "EFBBBF", F.make_valid_utf8(F.substring(data, 4, 1 << 20).cast("string"))).otherwise(plain)
    )
    name = F.when(raw.startswith("/"), F.substring(raw, 2, 256)).when(raw.rlike(r"^([-+.\d]+|true|false)$"), raw)
    return F.nullif(F.trim(F.coalesce(text, name)), F.lit(""))


def xmp_properties(packet: Column) -> Column:
    """Element-form properties of an XMP packet: lower-case prefix:name to text; list items are joined by commas."""
    element = r"(?s)<([A-Za-z][\w.-]*:[\w.-]+)(?:\s[^>]*)?(?<!/)>(.*?)</\1>"
    inner = F.regexp_replace(F.regexp_replace(packet, r"(?s)<\?.*?\?>|</?(?:x:xmpmeta|rdf:RDF|rdf:Description)(?:\s[^>]*)?>", ""), r"(?s)<!--.*?-->", "")
    entity = lambda t: F.replace(F.replace(F.replace(F.replace(t, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))

    def value(body: Column) -> Column:
        items = F.regexp_extract_all(body, F.lit(r"(?s)<rdf:li(?:\s[^>]*)?>(.*?)</rdf:li>"), 1)
        text = F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x: F.trim(F.regexp_replace(x, "<[^>]+>", ""))), ",")).otherwise(F.regexp_replace(body, "<[^>]+>", ""))
        return F.trim(entity(F.regexp_replace(text, r"^\s+|\s+$", "")))

    each = F.transform(F.regexp_extract_all(inner, F.lit(element), 0), lambda e: F.struct(F.lower(F.regexp_extract(e, element, 1)).alias("name"), value(F.regexp_extract(e, element, 2)).alias("value")))
    told = F.filter(each, lambda e: e["value"] != "")
    names = F.array_distinct(F.transform(told, lambda e: e["name"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(told, lambda e: e["name"] == n), 1)["value"]))


def resolved(wanted: DataFrame, objects: DataFrame, key: str) -> DataFrame:
    """``wanted`` (key, role, number, more) with body and data of the objects that it names."""
    return wanted.join(objects.select(key, "number", "body", "data"), [key, "number"], "left")


def pdf_metadata(objects: DataFrame, key: str = "id") -> DataFrame:
    """key, pdf (a JSON object) of every file with a catalogue; what a file doesn't say is absent."""
    trailer = objects.where(F.col("number") == TRAILER)
    roles = lambda pairs_: F.explode(F.array(*(F.struct(F.lit(r).alias("role"), n.alias("number")) for r, n in pairs_)))
    first = trailer.select(key, roles([("info", reference(F.col("body"), "Info")), ("catalog", reference(F.col("body"), "Root"))]).alias("r")).select(key, "r.*").where("number is not null")
    first = kept(resolved(first, objects, key))
    catalog, info = first.where("role = 'catalog' and body is not null"), first.where("role = 'info' and body is not null")
    entry = info.select(key, F.explode(pairs(F.col("body"))).alias("e")).select(key, F.concat(F.lit("info:"), "e.name").alias("role"), "e.raw", F.regexp_extract("e.raw", r"^(\d+)\s+\d+\s+R$", 1).try_cast("int").alias("number"))
    named = catalog.select(key, roles([(n, reference(F.col("body"), n)) for n in ("AcroForm", "Metadata", "Pages", "Lang")]).alias("r")).select(key, "r.*").where("number is not null")
    second = resolved(entry.select(key, "role", "number").unionByName(named).where("number is not null"), objects, key)
    said = entry.where("number is null").select(key, "role", F.col("raw").alias("value")).unionByName(second.where("role like 'info:%' or role = 'Lang'").select(key, "role", F.col("body").alias("value")))
    said = said.unionByName(catalog.select(key, F.lit("Lang").alias("role"), found(F.col("body"), rf"(?s)/Lang\s*({_STRING})").alias("value")))
    values = said.select(key, "role", string_value(F.col("value")).alias("value")).unionByName(second.where("role in ('AcroForm', 'Pages')").select(key, "role", F.col("body").alias("value")))
    values = values.unionByName(catalog.select(key, F.lit("catalog").alias("role"), F.col("body").alias("value"))).unionByName(trailer.select(key, F.lit("trailer").alias("role"), F.col("body").alias("value")))
    values = values.unionByName(trailer.select(key, F.lit("head").alias("role"), F.decode("data", "ISO-8859-1").alias("value")))
    values = values.unionByName(second.where("role = 'Metadata'").select(key, "role", xmp_packet(F.decode("data", "ISO-8859-1")).alias("value"))).where("value is not null")
    files = values.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("role", "value"))).alias("v"))  # one file's few entries, each role once
    v = lambda role: F.try_element_at("v", F.lit(role))
    files = files.where(v("catalog").isNotNull()).select(
        key, "v", v("catalog").alias("catalog"), v("head").alias("head"), v("trailer").rlike(r"/Encrypt\b").alias("sealed"), F.coalesce(v("AcroForm"), within(v("catalog"), "AcroForm")).alias("form"),
        F.coalesce(xmp_properties(v("Metadata")), F.create_map().cast("map<string,string>")).alias("xmp"),
    )
    own = {n: pdf_date(v(f"info:{n}")) if n.endswith("Date") else v(f"info:{n}") for n in INFO} | {"language": v("Lang")}
    own["pdfVersion"] = F.coalesce(found(F.col("catalog"), r"/Version\s*/(\d+\.\d+)"), found(F.col("head"), r"^%PDF-(\d+\.\d+)"))
    gap = {name: F.try_element_at("xmp", F.lit(k)) for k, name in XMP_GAPS.items()}
    part, level = gap.pop("pdfaPart"), gap["pdfaConformance"]
    gap["pdfaConformance"] = F.when(part.isNotNull(), F.concat(F.lit("PDF/A-"), part, F.lower(F.coalesce(level, F.lit(""))))).otherwise(level)
    names = [*own, *(n for n in gap if n not in own)]
    merged = {n: F.coalesce(*(x[n] for x in (own, gap) if n in x)) for n in names}
    open_ = {n: c if n == "pdfVersion" else F.when(~F.col("sealed"), c) for n, c in merged.items()}
    more = F.map_filter("v", lambda k, _: k.startswith("info:") & ~k.isin([f"info:{n}" for n in INFO]) & ~F.col("sealed"))
    texts = F.concat(F.array(*(F.struct(F.lit(n).alias("key"), c.alias("value")) for n, c in open_.items())), F.array_sort(F.transform(F.map_entries(more), lambda e: F.struct(F.concat(F.lit("custom_"), F.substring(e["key"], 6, 256)).alias("key"), e["value"].alias("value")))))
    flag = lambda name, c: F.when(c, F.lit(f'"{name}":true'))
    form = F.col("form")
    flags = F.concat_ws(
        ",", flag("linearized", F.col("head").rlike(r"/Linearized\s")), flag("hasAcroForm", form.rlike(r"/XFA\b|/Fields\s*\[\s*[^\]\s]|/Fields\s+\d+\s+\d+\s+R")), flag("hasXFA", form.rlike(r"/XFA\b")),
        flag("isCollection", F.col("catalog").rlike(r"/Collection\b")), flag("hasSignatures", found(form, r"/SigFlags\s+(\d+)").try_cast("int").bitwiseAND(1) == 1),
        F.concat(F.lit('"pageCount":'), F.nullif(found(v("Pages"), r"/Count\s+(\d+)"), F.lit("0"))), F.when(F.col("sealed"), '"encrypted":true').otherwise('"encrypted":false'),
    )
    json = F.to_json(F.map_from_entries(F.filter(texts, lambda e: e["value"].isNotNull())))
    return files.select(key, F.concat(F.lit("{"), F.regexp_replace(F.substring(json, F.lit(2), F.length(json)), r"\}$", ","), flags, F.lit("}")).alias("pdf")).withColumn("pdf", F.regexp_replace("pdf", r"^\{,", "{"))


def _pages(objects: DataFrame, key: str) -> DataFrame:
    """key, path (places in the page tree), body, resources (of the page or the nearest parent that has some); a level of the tree a join."""
    roots = objects.where(F.col("number") == TRAILER).select(key, F.lit("catalog").alias("role"), reference(F.col("body"), "Root").alias("number"))
    start = resolved(roots, objects, key).select(key, reference(F.col("body"), "Pages").alias("number"), F.array().cast("array<int>").alias("path"), F.array().cast("array<int>").alias("seen"), F.lit(None).cast("string").alias("resources"))
    level, found_ = kept(start.where("number is not null")), None
    for _ in range(MOST_DEEP):
        if level.isEmpty():
            break
        rows = level.join(objects.select(key, "number", "body"), [key, "number"])
        own = F.coalesce(within(F.col("body"), "Resources"), F.concat(F.lit("/ "), reference(F.col("body"), "Resources").cast("string"), F.lit(" 0 R")), F.col("resources"))
        rows = rows.withColumn("resources", own).withColumn("kids", F.when(F.col("body").rlike(r"/Kids\b"), F.regexp_extract_all(found(F.col("body"), r"/Kids\s*\[([^\]]*)\]"), F.lit(r"(\d+)\s+\d+\s+R"), 1)))
        pages = rows.where("kids is null").select(key, "path", "body", "resources")
        found_ = pages if found_ is None else found_.unionByName(pages)
        deeper = rows.where("kids is not null").select(key, "path", "resources", F.array_append("seen", F.col("number")).alias("seen"), F.posexplode("kids").alias("at", "kid"))
        level = kept(deeper.select(key, F.col("kid").cast("int").alias("number"), F.array_append("path", F.col("at")).alias("path"), "seen", "resources").where("not array_contains(seen, number)"))
    if found_ is None:
        return start.select(key, "path", F.lit("").alias("body"), "resources").where("false")
    return kept(found_)


def _contents(pages: DataFrame, objects: DataFrame, key: str) -> DataFrame:
    """key, path, content: the content streams of each page, joined in order."""
    refs = F.coalesce(found(F.col("body"), r"/Contents\s*\[([^\]]*)\]"), found(F.col("body"), r"/Contents\s+(\d+\s+\d+\s+R)"))
    parts = pages.select(key, "path", F.posexplode(F.regexp_extract_all(refs, F.lit(r"(\d+)\s+\d+\s+R"), 1)).alias("part", "number")).withColumn("number", F.col("number").cast("int"))
    parts = parts.join(objects.select(key, "number", "body", "data"), [key, "number"])
    inner = parts.where("data is null").select(key, "path", F.col("part").alias("outer"), F.posexplode(F.regexp_extract_all(F.col("body"), F.lit(r"(\d+)\s+\d+\s+R"), 1)).alias("part", "number"))  # an array that stands for itself
    inner = inner.withColumn("number", F.col("number").cast("int")).join(objects.select(key, "number", "data"), [key, "number"]).where("data is not null").select(key, "path", "part", "data")
    every = parts.where("data is not null").select(key, "path", "part", "data").unionByName(inner)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "data"))), lambda p: F.hex(p["data"])), "0A")
    return every.groupBy(key, "path").agg(F.unhex(joined).alias("content"))


def _fonts(pages: DataFrame, objects: DataFrame, key: str) -> DataFrame:
    """key, path, font (its name on the page), width (bytes a code), number of its ToUnicode map, body and encoding."""
    on_page = pages.select(key, "path", "resources", found(F.col("resources"), r"^/ (\d+)").try_cast("int").alias("number"))
    on_page = on_page.join(objects.select(key, "number", F.col("body").alias("held")), [key, "number"], "left").withColumn("resources", F.coalesce("held", "resources")).drop("held", "number")
    listed = on_page.select(key, "path", within(F.col("resources"), "Font").alias("fonts"), reference(F.col("resources"), "Font").alias("number"))
    listed = listed.join(objects.select(key, "number", F.col("body").alias("held")), [key, "number"], "left").select(key, "path", F.coalesce("held", "fonts").alias("fonts"))
    each = listed.select(key, "path", F.explode(pairs(F.col("fonts"))).alias("e")).select(key, "path", F.col("e.name").alias("font"), F.regexp_extract("e.raw", r"^(\d+)", 1).try_cast("int").alias("number"))
    each = each.join(objects.select(key, "number", "body"), [key, "number"]).drop("number")
    each = each.select(key, "path", "font", "body", F.when(F.col("body").rlike(r"/Subtype\s*/Type0\b"), 2).otherwise(1).alias("width"), reference(F.col("body"), "ToUnicode").alias("map"), reference(F.col("body"), "Encoding").alias("number"))
    each = each.join(objects.select(key, "number", F.col("body").alias("held")), [key, "number"], "left")
    return each.select(key, "path", "font", "width", "map", F.coalesce("held", "body").alias("encoding"))


def code_ranges(maps: DataFrame, key: str) -> DataFrame:
    """``maps`` (key, map, data): key, map, page (a code's upper bytes), low, high, text of its ToUnicode ranges. ``text`` is what the lowest code stands for, in UTF-16 as hexadecimal digits."""
    text = F.decode("data", "ISO-8859-1")
    hexed, list_ = r"<\s*([0-9A-Fa-f]+)\s*>", r"\[[^\]]*\]"
    section = lambda kind: F.array_join(F.regexp_extract_all(text, F.lit(rf"(?s)begin{kind}(.*?)end{kind}"), 1), "\n")
    single, spread = rf"{hexed}\s*{hexed}", rf"{hexed}\s*{hexed}\s*(<[^>]*>|{list_})"
    number = lambda x: F.conv(x, 16, 10).cast("long")
    chars = F.transform(F.regexp_extract_all(section("bfchar"), F.lit(single), 0), lambda p: F.struct(number(F.regexp_extract(p, single, 1)).alias("low"), number(F.regexp_extract(p, single, 1)).alias("high"), F.array(F.regexp_extract(p, single, 2)).alias("texts")))
    ranges = F.transform(F.regexp_extract_all(section("bfrange"), F.lit(spread), 0), lambda p: F.struct(number(F.regexp_extract(p, spread, 1)).alias("low"), number(F.regexp_extract(p, spread, 2)).alias("high"), F.regexp_extract_all(F.regexp_extract(p, spread, 3), F.lit(hexed), 1).alias("texts")))
    rows = maps.select(key, "map", F.explode(F.concat(chars, ranges)).alias("r")).select(key, "map", "r.*").where("size(texts) > 0 and high >= low and high < 65536")
    # A list gives a text for each code; other ranges are cut at full pages of 256 codes, so that a join finds them.
    listed = rows.where("size(texts) > 1").select(key, "map", "low", F.posexplode("texts").alias("at", "text")).select(key, "map", (F.col("low") + F.col("at")).alias("low"), (F.col("low") + F.col("at")).alias("high"), "text", F.lit(0).cast("long").alias("shift"))
    page = F.explode(F.sequence(F.shiftright("low", 8), F.shiftright("high", 8))).alias("page")
    whole = rows.where("size(texts) = 1").select(key, "map", "low", "high", F.element_at("texts", 1).alias("text"), page)
    whole = whole.select(key, "map", F.greatest("low", F.col("page") * 256).alias("first"), F.least("high", F.col("page") * 256 + 255).alias("high"), "text", "low").select(key, "map", F.col("first").alias("low"), "high", "text", (F.col("first") - F.col("low")).alias("shift"))
    every = listed.unionByName(whole)
    return every.select(key, "map", F.shiftright("low", 8).alias("page"), "low", "high", "text", "shift")


def _by_range(code: Column) -> Column:
    """The text of a code in a range: its last UTF-16 unit counts up."""
    last = F.conv(F.right("text", F.lit(4)), 16, 10).cast("long") + F.col("shift") + code - F.col("low")
    digits = F.when(F.length("text") <= 4, F.lpad(F.hex(F.conv("text", 16, 10).cast("long") + F.col("shift") + code - F.col("low")), 4, "0")).otherwise(F.concat(F.substring("text", 1, F.length("text") - 4), F.lpad(F.hex(last), 4, "0")))
    return F.decode(F.unhex(digits), "UTF-16BE")


def _differences(encoding: Column) -> Column:
    """code and glyph of an encoding's differences."""
    tokens = F.regexp_extract_all(found(encoding, r"/Differences\s*\[([^\]]*)\]"), F.lit(r"(\d+|/[^\s/\[\]]+)"), 1)
    start = F.struct(F.lit(-1).alias("code"), F.array().cast("array<struct<code:int,glyph:string>>").alias("out"))
    step = lambda a, t: F.when(~t.startswith("/"), F.struct(t.try_cast("int").alias("code"), a["out"].alias("out"))).otherwise(F.struct((a["code"] + 1).alias("code"), F.array_append(a["out"], F.struct(a["code"].alias("code"), F.substring(t, 2, 64).alias("glyph"))).alias("out")))
    return F.aggregate(tokens, start, step)["out"]


def _glyph(name: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in GLYPHS.items() for x in kv))
    coded = F.decode(F.unhex(F.regexp_extract(name, r"^uni([0-9A-F]{4})", 1)), "UTF-16BE")
    return F.coalesce(F.try_element_at(known, name), F.when(F.length(name) == 1, name), F.when(name.rlike("^uni[0-9A-F]{4}"), coded))


def pdf_text(objects: DataFrame, key: str = "id") -> DataFrame:
    """key, text of every file that shows some, cut as excerpts are.

    Codes become text by their font's ToUnicode ranges, else by its differences, else (one byte a code)
    by Windows-1252. Strings more than two units above or below the one before start a line, and a
    paragraph where the step is over one and a half times its height; a gap within an array is a space.
    """
    pages = _pages(objects, key)
    content = _contents(pages, objects, key)
    shown = kept(shown_strings(content, key, "path").join(_fonts(pages, objects, key), [key, "path", "font"], "left"))
    before = W.partitionBy(key).orderBy("path", "seq")
    codes = F.col("codes")
    width = F.coalesce("width", F.lit(1))
    shown = shown.withColumn("n", F.floor(F.octet_length(codes) / width).cast("int"))
    shown = shown.withColumn("k_before", F.sum("n").over(before.rowsBetween(W.unboundedPreceding, -1))).where(F.coalesce("k_before", F.lit(0)) < EXCERPT_CAP)
    one = shown.select(key, "path", "seq", "map", "width", "encoding", "codes", F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1))).alias("at"))
    one = one.withColumn("code", F.conv(F.hex(F.expr("substring(codes, at * coalesce(width, 1) + 1, coalesce(width, 1))")), 16, 10).cast("long")).withColumn("page", F.shiftright("code", 8))
    ranges = code_ranges(objects.select(key, F.col("number").alias("map"), "data").where("data is not null"), key)
    met = one.join(ranges, (one[key] == ranges[key]) & (one["map"] == ranges["map"]) & (one["page"] == ranges["page"]) & F.col("code").between(F.col("low"), F.col("high")), "left")
    other = F.try_element_at(F.transform(F.filter(_differences(F.col("encoding")), lambda d: d["code"] == F.col("code")), lambda d: _glyph(d["glyph"])), F.lit(-1))
    plain = F.when(F.coalesce("width", F.lit(1)) == 1, windows_1252(F.unhex(F.lpad(F.hex("code"), 2, "0"))))
    char = F.coalesce(F.when(F.col("text").isNotNull(), _by_range(F.col("code"))), other, plain, F.lit(""))
    strings = met.select(one[key], "path", "seq", "at", char.alias("c"), F.col("low")).groupBy(key, "path", "seq").agg(F.array_sort(F.collect_list(F.struct("at", "low", "c"))).alias("cs"))
    text = F.array_join(F.transform(F.filter("cs", lambda x, i: (i == 0) | (F.get("cs", i - 1)["at"] != x["at"])), lambda x: x["c"]), "")
    lines = shown.select(key, "path", "seq", "y", "height", "gap").join(strings.select(key, "path", "seq", text.alias("s")), [key, "path", "seq"])
    own = W.partitionBy(key, "path").orderBy("seq")
    step, high = F.abs(F.col("y") - F.lag("y").over(own)), F.when(F.col("height") > 0, F.col("height")).otherwise(F.coalesce(F.lag("height").over(own), F.lit(12.0)))
    lead = F.when(step.isNull(), "").when(step > 2, F.when(step > 1.5 * high, "\n\n").otherwise("\n")).when(F.col("gap"), " ").otherwise("")
    lines = lines.select(key, "path", "seq", F.concat(lead, "s").alias("s"))
    each = lines.groupBy(key, "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "s"))), lambda x: x["s"]), "").alias("s"))
    whole = each.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "s"))), lambda x: F.rtrim(F.regexp_replace(x["s"], r"\s+$", ""))), "\n\n").alias("s"))
    return whole.select(key, F.nullif(excerpt_of_text(F.regexp_replace("s", r"^\s+|\s+$", "")), F.lit("")).alias("text"))


def loose(objects: DataFrame, key: str = "id") -> DataFrame:
    """key, latin (bytes and inflated objects, a character each) and loose_text of files without a usable object graph."""
    return objects.where(F.col("number") == LOOSE).select(key, F.col("body").alias("latin"), F.nullif(F.make_valid_utf8(F.col("data").cast("string")), F.lit("")).alias("loose_text"))
