"""Statistics of text files as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import windows_1252


FALLBACK = "ISO-8859-1 (fallback)"


def encoding(content: Column) -> Column:
    """By byte order mark, else UTF-8 where valid, else latin1.

    What looks like an encoding and doesn't decode as such (overlong forms, surrogates, a bad byte after a
    UTF-8 mark, half a unit of UTF-16) is the fallback.
    """
    h = F.hex(F.substring(content, 1, 3))
    valid = F.is_valid_utf8(content.cast("string"))
    shaped = F.regexp_replace(F.decode(content, "ISO-8859-1"), r"[\x00-\x7F]+|[\xC2-\xDF][\x80-\xBF]|[\xE0-\xEF][\x80-\xBF]{2}|[\xF0-\xF4][\x80-\xBF]{3}", "") == ""
    whole = F.octet_length(content) % 2 == 0
    return (
        F.when(h.startswith("EFBBBF"), F.when(valid, "utf-8").otherwise(FALLBACK)).when(h.startswith("FFFE"), F.when(whole, "utf-16le").otherwise(FALLBACK))
        .when(h.startswith("FEFF"), F.when(whole, "utf-16be").otherwise(FALLBACK)).when(valid, "utf-8").when(shaped, FALLBACK).otherwise("latin1")
    )


def bom(content: Column) -> Column:
    h = F.hex(F.substring(content, 1, 3))
    return F.when(h.startswith("EFBBBF"), "UTF-8 BOM").when(h.startswith("FFFE"), "UTF-16 LE BOM").when(h.startswith("FEFF"), "UTF-16 BE BOM")


def decoded(content: Column) -> Column:
    """The text by its encoding, without a byte order mark."""
    kind = encoding(content)
    text = (
        F.when(kind == "utf-8", F.make_valid_utf8(content.cast("string"))).when(kind == "utf-16le", F.decode(content, "UTF-16LE"))
        .when(kind == "utf-16be", F.decode(content, "UTF-16BE")).otherwise(windows_1252(content))
    )
    return F.regexp_replace(text, "^\ufeff", "")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, wherever the expression stands."""
    return F.get(F.transform(F.array(value), body), 0)


def _units(text: Column) -> Column:
    """UTF-16 units: characters, and one more for each beyond the basic plane."""
    return (F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))).cast("long")


def text_stats(content: Column) -> Column:
    """A struct of a text file's statistics; null for an empty file."""
    latin = F.decode(content, "ISO-8859-1")
    wide = F.regexp_count(latin, F.lit(r"[^\x00-\x7F]")).cast("long")
    nulls = F.contains(F.decode(F.substring(content, 1, 8192), "ISO-8859-1"), F.lit("\0"))

    def stats(text: Column, plain: Column, lines: Column, units: Column, wide: Column) -> Column:
        endings = (
            F.when(F.contains(text, F.lit("\r\n")), "CRLF (Windows)").when(F.contains(text, F.lit("\r")), "CR (Classic Mac)")
            .when(F.contains(text, F.lit("\n")), "LF (Unix/macOS)").otherwise("None (single line)")
        )
        return F.struct(
            encoding(content).alias("encoding"),
            bom(content).alias("bom"),
            endings.alias("lineEndings"),
            F.size(lines).cast("long").alias("lineCount"),
            F.regexp_count(plain, F.lit(r"(?U)\S+")).cast("long").alias("wordCount"),
            units.alias("charCount"),
            (units - F.regexp_count(plain, F.lit(r"(?U)\s"))).alias("charCountNoSpaces"),
            F.when(wide > 0, wide).alias("nonAsciiBytes"),
            F.when(wide > 0, F.format_string("%.1f%%", wide / F.octet_length(content) * 100)).alias("nonAsciiPercent"),
            F.endswith(plain, F.lit("\n")).alias("endsWithNewline"),
            F.when(units == F.length(plain), F.array_max(F.transform(lines, F.length)).cast("long")).otherwise(F.array_max(F.transform(lines, _units))).alias("longestLine"),
            F.when(nulls, True).alias("containsNullBytes"),
            F.when(nulls, True).alias("possiblyBinary"),
        )

    of_plain = lambda text: _let(F.regexp_replace(text, r"\r\n?", "\n"), lambda plain: _let(F.split(plain, "\n"), lambda lines: _let(_units(plain), lambda units: _let(wide, lambda n: stats(text, plain, lines, units, n)))))
    return F.when(F.octet_length(content) > 0, _let(decoded(content), of_plain))
