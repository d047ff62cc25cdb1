"""Formatting, dates and identifiers as Column expressions.

Lengths are UTF-16 units where they are results. Local time is UTC.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import EXCERPT_CAP, PREVIEW, TRUNCATED


def windows_1252(content: Column) -> Column:
    """Bytes as windows-1252 text; its five undefined bytes stay control characters."""
    high = "".join(chr(b) for b in range(128, 160))
    named = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 160))
    return F.translate(F.decode(content, "ISO-8859-1"), high, named)


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def file_id(path: Column, size: Column, modified_ms: Column) -> Column:
    """A 32-bit rolling hash (times 31, over UTF-16 units) of path-size-time, base 36."""
    units = F.hex(F.encode(F.concat_ws("-", path, size.cast("string"), modified_ms.cast("string")), "UTF-16BE"))
    fold = F.aggregate(
        F.filter(F.split(F.regexp_replace(units, "(.{4})", "$1,"), ","), lambda u: u != ""),
        F.lit(0).cast("long"),
        lambda h, u: F.pmod(h * 31 + F.conv(u, 16, 10).cast("long") + 2**31, F.lit(2**32)) - 2**31,
    )
    return F.concat(F.lit("f_"), F.lower(F.conv(F.abs(fold), 10, 36)))


def format_bytes(size: Column) -> Column:
    """Bytes in the largest fitting unit up to TB; one decimal but for B."""
    x = size.cast("double")
    out = F.when(x == 0, "0 B").when(x < 1024, F.format_string("%.0f B", x))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        part = F.format_string(f"%.1f {unit}", x / float(1024**power))
        out = out.when(x < float(1024 ** (power + 1)), part) if unit != "TB" else out.otherwise(part)
    return out


def format_cache_size(size: Column) -> Column:
    """Like format_bytes, with two decimals from GB on."""
    x = size.cast("double")
    return (
        F.when(x < 1024, F.format_string("%.0f B", x)).when(x < 1024.0**2, F.format_string("%.1f KB", x / 1024))
        .when(x < 1024.0**3, F.format_string("%.1f MB", x / 1024.0**2)).otherwise(F.format_string("%.2f GB", x / 1024.0**3))
    )


def format_date(iso: Column) -> Column:
    """An ISO time for display; what can't be read is shown as it is."""
    return F.coalesce(F.date_format(F.try_to_timestamp(iso), "MMM d, y, hh:mm a"), iso)


def iso_ms(time: Column) -> Column:
    """A timestamp as ISO 8601 with milliseconds, in UTC."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def clock(seconds: Column) -> Column:
    """h:mm:ss, or m:ss below an hour."""
    s = F.floor(seconds)
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).when(seconds.isNotNull(), F.format_string("%d:%02d", m, r))


def minutes_clock(seconds: Column) -> Column:
    """m:ss with minutes beyond 59."""
    return F.when(seconds.isNotNull(), F.format_string("%d:%02d", F.floor(seconds / 60), F.floor(seconds % 60)))


def hours_minutes(minutes: Column) -> Column:
    """Hh Mm, or Mm below an hour; null for none."""
    m = F.round(minutes).cast("long")
    return F.when(m >= 60, F.concat(F.floor(m / 60).cast("string"), F.lit("h "), (m % 60).cast("string"), F.lit("m"))).when(m > 0, F.concat(m.cast("string"), F.lit("m")))


def ratio(width: Column, height: Column) -> Column:
    """w:h in lowest terms, by Euclid's steps (at most 64 for 32-bit sides)."""
    step = lambda p, _: F.when(p["b"] == 0, p).otherwise(F.struct(p["b"].alias("a"), (p["a"] % F.greatest(p["b"], F.lit(1))).alias("b")))
    start = F.struct(width.cast("long").alias("a"), height.cast("long").alias("b"))
    g = F.greatest(F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, step)["a"], F.lit(1))
    return F.concat_ws(":", F.floor(width / g).cast("string"), F.floor(height / g).cast("string"))


def decimal_degrees(degrees: Column, minutes: Column, seconds: Column, reference: Column) -> Column:
    x = degrees + minutes / 60 + seconds / 3600
    return F.when(reference.isin("S", "W"), -x).otherwise(x)


def pdf_date(text: Column) -> Column:
    """D:YYYYMMDDHHmmSS in ISO; missing parts are first ones; the zone is ignored; else the text."""
    part = lambda i, default: F.coalesce(F.nullif(F.regexp_extract(text, r"D:(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?", i), F.lit("")), F.lit(default)).cast("int")
    time = F.try_make_timestamp(part(1, "0"), part(2, "1"), part(3, "1"), part(4, "0"), part(5, "0"), part(6, "0").cast("decimal(8,6)"))
    return F.when(text.rlike(r"D:\d{4}"), F.coalesce(iso_ms(time), text)).otherwise(text)


def filetime(ticks: Column) -> Column:
    """100-ns ticks since 1601 as ISO; only years 1901 to 2099."""
    time = F.timestamp_millis(F.floor(ticks / 10_000).cast("long") - 11_644_473_600_000)
    return F.when((F.year(time) > 1900) & (F.year(time) < 2100), iso_ms(time))


def mac_date(seconds: Column) -> Column:
    """Seconds since 1904 as ISO; null before 1970."""
    s = seconds - 2_082_844_800
    return F.when(s >= 0, iso_ms(F.timestamp_seconds(s)))


def dos_date(date: Column, time: Column) -> Column:
    """A DOS date and time (two-second steps) as a timestamp."""
    bits = lambda c, shift, mask: F.shiftright(c, shift).bitwiseAND(mask)
    return F.try_make_timestamp(
        (bits(date, 9, 127) + 1980).cast("int"), bits(date, 5, 15).cast("int"), bits(date, 0, 31).cast("int"),
        bits(time, 11, 31).cast("int"), bits(time, 5, 63).cast("int"), (bits(time, 0, 31) * 2).cast("decimal(8,6)"),
    )


def rtf_date(group: Column) -> Column:
    """A group of yr, mo, dy, hr, min and sec control words as ISO; null without yr."""
    part = lambda w, d: F.coalesce(F.nullif(F.regexp_extract(group, rf"\\{w}(\d+)", 1), F.lit("")), F.lit(d)).cast("int")
    return F.when(group.rlike(r"\\yr\d"), iso_ms(F.try_make_timestamp(part("yr", "0"), part("mo", "1"), part("dy", "1"), part("hr", "0"), part("min", "0"), part("sec", "0").cast("decimal(8,6)"))))


def preview(text: Column, mark: str = "…", length: int = PREVIEW) -> Column:
    return F.when(F.length(text) > length, F.concat(F.left(text, F.lit(length)), F.lit(mark))).otherwise(text)


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def humanised(key: Column) -> Column:
    """camelCase as Camel Case."""
    spaced = F.regexp_replace(key, "([A-Z])", " $1")
    return F.trim(F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 10_000)))


def channels_shown(n: Column) -> Column:
    return F.when(n == 1, "Mono").when(n == 2, "Stereo").otherwise(F.concat(n.cast("string"), F.lit("ch")))


def sample_rate_shown(rate: Column) -> Column:
    return F.concat(rate.cast("string"), F.lit(" Hz"))


def default_batch_name(day: Column) -> Column:
    return F.concat(F.lit("batch-"), F.date_format(day, "yyyy-MM-dd"))


def tidy_newlines(text: Column) -> Column:
    """Line feeds only, no blanks before them, at most one empty line, ends trimmed."""
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"(?m)[ \t]+$", "")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def excerpt_of_bytes(content: Column, cap: int = EXCERPT_CAP) -> Column:
    """The first ``cap`` bytes as text, bad bytes replaced, marked where cut."""
    text = F.make_valid_utf8(F.substring(content, 1, cap).cast("string"))
    text = F.regexp_replace(text, "^\ufeff", "")
    return F.when(F.octet_length(content) > cap, F.concat(text, F.lit(TRUNCATED))).otherwise(text)


def excerpt_of_text(text: Column, cap: int = EXCERPT_CAP) -> Column:
    """The first ``cap`` UTF-16 units of a text, marked where cut; null for none."""
    cut = F.decode(F.substring(F.encode(text, "UTF-16BE"), 1, 2 * cap), "UTF-16BE")
    return F.when(text == "", None).when(utf16_length(text) > cap, F.concat(cut, F.lit(TRUNCATED))).otherwise(text)
