"""Type detection from names and leading bytes, as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import ARCHIVES, CATEGORIES, DETECTED, MEMBER_MIME, VIEWABLE


def _lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for x in chain.from_iterable(pairs.items())))


def file_extension(name: Column) -> Column:
    """What follows the last dot, in lower case; empty without a dot."""
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def category(extension: Column) -> Column:
    """The category of an extension, else Other."""
    known = {e: c for c, names in CATEGORIES.items() for e in names.split()}
    return F.coalesce(F.try_element_at(_lookup(known), extension), F.lit("Other"))


def member_mime(name: Column) -> Column:
    """The MIME type of an archive member by its name."""
    return F.coalesce(F.try_element_at(_lookup(MEMBER_MIME), F.lower(F.substring_index(name, ".", -1))), F.lit("application/octet-stream"))


def head_hex(content: Column, n: int = 16) -> Column:
    return F.hex(F.substring(content, 1, n))


def _latin(content: Column, n: int) -> Column:
    """The first n bytes as a string with one character a byte."""
    return F.decode(F.substring(content, 1, n), "ISO-8859-1")


def magic(content: Column) -> Column:
    """The extension that the leading bytes speak for; null if unknown or under 4 bytes.

    The order of the tests decides between overlapping ones.
    """
    h = head_hex(content)
    starts = lambda *xs: [h.startswith(x) for x in xs]
    either = lambda tests: tests[0] if len(tests) == 1 else tests[0] | either(tests[1:])
    riff = lambda kind: h.startswith("52494646") & (F.substring(h, 17, 8) == kind)
    text = _latin(content, 16)
    printable = F.length(F.regexp_replace(text, r"[^\x20-\x7E\t\n\r]", ""))
    ftyp = F.substring(h, 9, 8) == "66747970"
    tests = [
        ("pdf", either(starts("25504446"))),
        ("doc", either(starts("D0CF11E0"))),
        ("zip", either(starts("504B0304"))),
        ("jpg", either(starts("FFD8FF"))),
        ("png", either(starts("89504E47"))),
        ("gif", either(starts("47494638"))),
        ("tiff", either(starts("49492A00", "4D4D002A"))),
        ("psd", either(starts("38425053"))),
        ("heic", ftyp & F.substring(h, 17, 8).isin(*(x.encode().hex().upper() for x in ("heic", "heix", "hevc", "mif1")))),
        ("mp4", ftyp),
        ("bmp", either(starts("424D"))),
        ("webp", riff("57454250")),
        ("wav", riff("57415645")),
        ("aiff", h.startswith("464F524D") & (F.substring(h, 17, 8) == "41494646")),
        ("flac", either(starts("664C6143"))),
        ("ogg", either(starts("4F676753"))),
        ("mp3", either(starts("494433", "FFFB", "FFFA", "FFF3", "FFF2"))),
        ("doc", either(starts("FE37001C"))),
        ("rtf", either(starts("7B5C727466"))),
        ("txt", printable >= 0.8 * F.length(text)),
    ]
    found = F.coalesce(*[F.when(test, F.lit(kind)) for kind, test in tests])
    return F.when(F.octet_length(content) >= 4, F.when((found == "zip") & (F.octet_length(content) >= 30), F.coalesce(zip_subtype(content), found)).otherwise(found))


def zip_subtype(content: Column) -> Column:
    """The office format of a ZIP by member names in its first 2,000 bytes, else null."""
    text = _latin(content, 2000)
    has = lambda x: F.contains(text, F.lit(x))
    odf = F.when(has("opendocument.text"), "odt").when(has("opendocument.spreadsheet"), "ods").when(has("opendocument.presentation"), "odp").otherwise("odt")
    return F.when(has("word/"), "docx").when(has("xl/"), "xlsx").when(has("ppt/"), "pptx").when(has("META-INF/manifest.xml") | has("content.xml"), odf)


def mime_of(kind: Column) -> Column:
    return F.try_element_at(_lookup({k: m for k, (m, _) in DETECTED.items()}), kind)


def detected_category(kind: Column) -> Column:
    return F.try_element_at(_lookup({k: c for k, (_, c) in DETECTED.items()}), kind)


def classified(name: Column, content: Column) -> tuple[Column, Column, Column]:
    """(extension, category, detected MIME type or null) at capture.

    Leading bytes count only without an extension or where its category is Other; then they replace
    both, so .log and .ini become txt, and .xlt becomes doc.
    """
    extension = file_extension(name)
    kind = F.when((extension == "") | (category(extension) == "Other"), magic(content))
    return F.coalesce(kind, extension), F.coalesce(detected_category(kind), category(extension)), mime_of(kind)


def is_os_artifact(name: Column) -> Column:
    """Whether an archive member is made by an operating system rather than by a user."""
    base = F.substring_index(name, "/", -1)
    own = (".DS_Store", ".Spotlight-V100", ".Trashes", ".fseventsd", "Thumbs.db", "desktop.ini")
    return (base == "") | F.contains(name, F.lit("__MACOSX/")) | base.startswith("._") | base.isin(*own)


def action_flags(extension: Column, has_file: Column, has_meta: Column, unpacked: Column) -> Column:
    """The row's actions, comma-joined: view, meta, and unpack or unpacked."""
    e = F.lower(extension)
    return F.concat_ws(
        ",",
        F.when(has_file & e.isin(*VIEWABLE), "view"),
        F.when(has_meta, "meta"),
        F.when(has_file & e.isin(*ARCHIVES), F.when(F.coalesce(unpacked, F.lit(False)), "unpacked").otherwise("unpack")),
    )
