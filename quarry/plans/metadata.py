"""Open metadata of container files: parts joined with what their codes mean, gathered per file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import headers as h
from ..functions import tags
from ..functions.markup import xmp_fields
from ..functions.scalars import clock, decimal_degrees, filetime, hours_minutes, mac_date, minutes_clock, windows_1252
from ..sources.chunks import WALKERS


def json_value(x: Column) -> Column:
    """A value as JSON text; null stays null."""
    return F.when(x.isNotNull(), F.regexp_replace(F.to_json(F.array(x)), r"(?s)^\[|\]$", ""))


def dictionary(spark: SparkSession) -> DataFrame:
    """kind, key, form: how the value of each coded part is to be read. About 250 rows."""
    rows = [("id3:" + k, v, "genre" if v == "genre" else "id3") for k, v in tags.ID3_FRAMES.items()]
    rows += [("vorbis:" + k, v, "utf8") for k, v in tags.VORBIS.items()]
    rows += [(k, v, "riff") for k, v in tags.RIFF_INFO.items()]
    rows += [(f"sum:{k}", v, "edit" if v == "editTime" else "ole") for k, v in tags.SUMMARY.items()]
    rows += [(f"doc:{k}", v, "ole") for k, v in tags.DOCUMENT_SUMMARY.items()]
    rows += [(f"iptc:{k}", v, "utf8") for k, v in tags.IPTC.items()]
    rows += [(f"tag:{k:04x}", v, "exif") for k, v in tags.EXIF.items()]
    rows += [("gps:001d", "GPSDateStamp", "exif"), ("gps:0007", "GPSTimeStamp", "exif"), ("gps:0006", "GPSAltitude", "exif")]
    return spark.createDataFrame(rows, "kind string, key string, form string")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it occurs there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _genres() -> Column:
    return F.split(F.lit("|".join(tags.GENRES)), r"\|")


def _genre(text: Column) -> Column:
    """A genre whose number stands in parentheses, by its name; what follows the number comes first."""
    number, rest = F.regexp_extract(text, r"^\((\d+)\)", 1), F.regexp_extract(text, r"^\(\d+\)(.*)$", 1)
    name = F.coalesce(F.get(_genres(), number.try_cast("int")), number)
    return F.when(number == "", text).when(rest == "", name).otherwise(F.concat(rest, F.lit(" ("), name, F.lit(")")))


def _clean(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(text, r"\x00+$", "")), F.lit(""))


def _tail(data: Column, at: int) -> Column:
    """The bytes from a place counted from 0 on."""
    return F.substring(data, at + 1, 1 << 20)


def _by_encoding(code: Column, data: Column) -> Column:
    return F.when(code == 1, F.decode(data, "UTF-16")).when(code == 2, F.decode(data, "UTF-16BE")).when(code == 3, F.make_valid_utf8(data.cast("string"))).otherwise(F.decode(data, "ISO-8859-1"))


def _id3(kind: Column, data: Column) -> Column:
    """A text frame, or the text after a comment's language and description."""
    long = kind.isin("id3:COMM", "id3:USLT")
    text = _by_encoding(h.big(data, 0, 1), F.when(long, _tail(data, 4)).otherwise(_tail(data, 1)))
    return _clean(F.when(long, F.regexp_replace(text, r"(?s)^[^\x00]*\x00﻿?", "")).otherwise(text))


def _exif_number(data: Column, i: Column, kind: Column) -> Column:
    """The i-th number of a tag's value: rationals as doubles, a zero denominator as 0."""
    wide = lambda x: F.when(kind.isin(9, 10), h.signed(x)).otherwise(x)
    long = lambda at: wide(h.big(data, at, 4))
    bottom = long(i * 8 + 10)
    ratio = F.when(bottom == 0, 0.0).otherwise(long(i * 8 + 6) / F.nullif(bottom, F.lit(0)))
    return F.when(kind == 3, h.big(data, i * 2 + 6, 2)).when(kind.isin(4, 9), long(i * 4 + 6)).when(kind.isin(5, 10), ratio).otherwise(h.big(data, i + 6, 1)).cast("double")


def _number_json(x: Column) -> Column:
    """A double as JSON, whole numbers without a point."""
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def _exif(data: Column) -> Column:
    """A tag's value as JSON: text, a number, or a list of numbers."""
    kind, count = h.big(data, 0, 2), h.big(data, 2, 4)
    text = F.decode(_tail(data, 6), "ISO-8859-1")
    short = F.when(count > 32, F.left(text, F.lit(32))).otherwise(text)
    list_ = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)).cast("int") - 1), lambda i: _number_json(_exif_number(data, i, kind)))
    numbers = F.nullif(F.regexp_replace(F.concat(F.lit("["), F.array_join(list_, ","), F.lit("]")), r"^\[([^,]*)\]$", "$1"), F.lit(""))  # cut off: null
    return F.when(kind == 2, json_value(_clean(text))).when(kind.isin(1, 7) & (count > 4), json_value(_clean(short))).otherwise(numbers)


def _ole(data: Column) -> Column:
    kind, value = h.big(data, 0, 1), _tail(data, 1)
    text = F.when(kind == 30, windows_1252(value)).when(kind == 31, F.decode(value, "UTF-16LE"))
    number = h.little(value, 0)
    return F.when(kind.isin(30, 31), json_value(_clean(text))).when(kind == 64, json_value(filetime(_ticks(value)))).when((kind == 3) & (number > 0) & (number < 2**31), number.cast("string"))


def _ticks(value: Column) -> Column:
    return h.little(value, 0) + h.little(value, 4) * 2**32


def _one(name: Column, value: Column) -> Column:
    return F.array(F.struct(F.col("seq").alias("seq"), name.alias("name"), value.alias("value")))


#: How coded parts' values are read, by the walkers that yield such.
FORMS_OF = {"mp3": ("id3", "genre"), "flac": ("utf8",), "ogg": ("utf8",), "wav": ("riff",), "psd": ("utf8",), "exif": ("exif",), "ole2": ("edit", "ole")}


def _coded(forms: set[str]) -> Column:
    """The entry of a part that the dictionary names."""
    data, form = F.col("data"), F.col("form")
    values = {
        "id3": lambda: json_value(_id3(F.col("kind"), data)), "genre": lambda: json_value(_let(_id3(F.col("kind"), data), _genre)), "utf8": lambda: json_value(_clean(F.make_valid_utf8(data.cast("string")))),
        "riff": lambda: json_value(_clean(F.decode(_tail(data, 4), "ISO-8859-1"))), "exif": lambda: _exif(data), "edit": lambda: json_value(hours_minutes(_ticks(_tail(data, 1)) / 600_000_000)), "ole": lambda: _ole(data),
    }
    return _one(F.col("k_name"), F.coalesce(*(F.when(form == k, v()) for k, v in values.items() if k in forms)))


def _fields(kind: str) -> dict[str, Column]:
    """Fields of a part that isn't a single value."""
    d = F.col("data")
    long = lambda at, n=4: h.big(d, at, n)
    if kind == "IHDR":
        return h.png_header(d)
    if kind == "gAMA":
        return {"Gamma": F.format_string("%.4f", long(0) / 100_000)}
    if kind == "cHRM":
        return {"Chromaticity": F.lit("Present")}
    if kind == "sRGB":
        return {"ColorSpace": F.lit("sRGB"), "RenderingIntent": h.named(long(0, 1), {0: "Perceptual", 1: "Relative colorimetric", 2: "Saturation", 3: "Absolute colorimetric"}, "Unknown")}
    if kind == "iCCP":
        return {"ICCProfile": _clean(F.substring_index(F.decode(F.substring(d, 1, 80), "ISO-8859-1"), "\0", 1))}
    if kind == "pHYs":
        metre = long(8, 1) == 1
        dpi = lambda at: F.when(metre, F.round(long(at) / 39.3701).cast("long"))
        return {"DpiX": dpi(0), "DpiY": dpi(4), "PixelsPerUnitX": F.when(~metre, long(0)), "PixelsPerUnitY": F.when(~metre, long(4))}
    if kind == "head:gif":
        flags = long(10, 1)
        return {"GIFVersion": F.decode(F.substring(d, 1, 6), "ISO-8859-1"), "Width": h.little(d, 6, 2), "Height": h.little(d, 8, 2), "ColorSpace": F.lit("Indexed"), "BitsPerPixel": flags.bitwiseAND(7) + 1, "ColorResolution": F.shiftright(flags, 4).bitwiseAND(7) + 1, "GlobalColorTable": F.when(flags >= 128, "Yes").otherwise("No"), "BackgroundColorIndex": long(11, 1), **h.picture(h.little(d, 6, 2), h.little(d, 8, 2))}
    if kind == "frames":
        return {"Animated": F.when(long(0) > 1, F.format_string("Yes (%d frames)", long(0))).otherwise("No")}
    if kind == "fmt ":
        return {"audioFormat": h.named(h.little(d, 4, 2), h.WAV_FORMATS, "Format %d"), "channels": h.little(d, 6, 2), "sampleRate": h.little(d, 8), "bitsPerSample": h.little(d, 18, 2), "bitrate": F.format_string("%d kbps", F.round(h.little(d, 12) * 8 / 1000).cast("long"))}
    if kind == "flac:0":
        rate, samples = F.shiftright(long(10, 3), 4), long(13, 5).bitwiseAND(2**36 - 1)
        seconds = F.when((rate > 0) & (samples > 0), samples / rate)
        return {"format": F.lit("FLAC"), "sampleRate": rate, "channels": F.shiftright(long(12, 1), 1).bitwiseAND(7) + 1, "bitsPerSample": F.shiftright(long(12, 2), 4).bitwiseAND(31) + 1, "duration": minutes_clock(seconds), "durationSeconds": F.round(seconds, 2)}
    if kind == "flac:6" or kind == "id3:APIC":
        return {"hasAlbumArt": F.lit(True)}
    if kind == "ogg:vorbis":
        rate = h.little(d, 13)
        return {"channels": long(4, 1), "sampleRate": h.little(d, 5), "bitrate": F.when((rate > 0) & (rate < 2**31), F.format_string("%d kbps", F.round(rate / 1000).cast("long")))}
    if kind == "ogg:opus":
        return {"channels": long(1, 1), "sampleRate": h.little(d, 4)}
    if kind == "COMM":
        exponent, mantissa = long(12, 2).bitwiseAND(0x7FFF) - 16383, long(14, 4).cast("double")
        rate = F.round(mantissa * F.pow(F.lit(2.0), exponent - 31)).cast("long")
        seconds = F.when(rate > 0, long(6) / rate)
        return {"channels": long(4, 2), "bitsPerSample": long(10, 2), "sampleRate": rate, "duration": minutes_clock(seconds), "durationSeconds": F.round(seconds, 2)}
    if kind == "id3":
        return {"id3Version": F.format_string("ID3v2.%d", long(0, 1))}
    if kind == "mpeg":
        version, layer = F.shiftright(long(1, 1), 3).bitwiseAND(3), 4 - F.shiftright(long(1, 1), 1).bitwiseAND(3)
        own = lambda k: (F.when(version == 3, 1).otherwise(2) == k[0]) & (layer == k[1])
        rate = F.get(F.coalesce(*(F.when(own(k), F.array(*map(F.lit, v))) for k, v in tags.MPEG_RATES.items())), F.shiftright(long(2, 1), 4).cast("int"))
        base = F.get(F.array(F.lit(44100), F.lit(48000), F.lit(32000)), F.shiftright(long(2, 1), 2).bitwiseAND(3).cast("int"))
        return {"mpegVersion": F.when(version == 3, "MPEG1").when(version == 2, "MPEG2").otherwise("MPEG2.5"), "layer": F.concat(F.lit("Layer "), F.repeat(F.lit("I"), layer.cast("int"))), "channelMode": F.get(F.array(*map(F.lit, ("Stereo", "Joint Stereo", "Dual Channel", "Mono"))), F.shiftright(long(3, 1), 6).cast("int")), "bitrate": F.when(rate > 0, F.format_string("%d kbps", rate)), "sampleRate": F.when(version == 3, base).when(version == 2, F.floor(base / 2)).otherwise(F.floor(base / 4)).cast("long")}
    if kind == "id3v1":
        text = lambda at, n: _clean(F.replace(F.decode(F.substring(d, at + 1, n), "ISO-8859-1"), F.lit("\0"), F.lit("")))
        return {"title": text(3, 30), "artist": text(33, 30), "album": text(63, 30), "year": text(93, 4), "comment": text(97, 30), "genre": F.get(_genres(), long(127, 1).cast("int")), "track": F.when((long(125, 1) == 0) & (long(126, 1) > 0), long(126, 1).cast("string"))}
    if kind == "ftyp":
        brand = F.trim(F.decode(F.substring(d, 1, 4), "ISO-8859-1"))
        known = F.create_map(*(F.lit(x) for kv in tags.BRANDS.items() for x in kv))
        return {"MajorBrand": brand, "Format": F.coalesce(F.try_element_at(known, brand), F.lit("MP4"))}
    if kind == "mvhd":
        new = long(0, 1) == 1
        made, scale, units = F.when(new, long(4, 8)).otherwise(long(4)), F.when(new, long(20)).otherwise(long(12)), F.when(new, long(24, 8)).otherwise(long(16))
        seconds = _let(F.struct(scale.alias("scale"), units.alias("units")), lambda x: F.when((x["scale"] > 0) & (x["units"] > 0), F.round(x["units"] / x["scale"], 2)))
        return {"CreationDate": _let(made, lambda x: F.when(x > 0, mac_date(x))), "DurationSeconds": seconds, "Duration": _let(seconds, clock), "Timescale": scale}
    if kind == "ispe":
        return {"Width": long(4), "Height": long(8), **h.picture(long(4), long(8))}
    if kind == "head:psd":
        return h.psd_header(d)
    if kind == "8bim:03ed":
        return {"HorizontalResolution": F.round(long(0) / 65536).cast("long"), "VerticalResolution": F.round(long(8) / 65536).cast("long")}
    if kind == "8bim:0424":
        return xmp_fields(F.make_valid_utf8(d.cast("string")))
    if kind == "app":
        return {"application": F.decode(d, "ISO-8859-1")}
    if kind == "8bim:040f":
        return {"ICCProfile": F.lit("Present")}
    raise KeyError(kind)


#: Parts of several fields, by the walker that yields them.
KINDS_OF = {
    "png": ("IHDR", "gAMA", "cHRM", "sRGB", "iCCP", "pHYs"), "gif": ("head:gif", "frames"), "wav": ("fmt ",), "aiff": ("COMM",),
    "flac": ("flac:0", "flac:6"), "ogg": ("ogg:vorbis", "ogg:opus"), "mp3": ("id3", "id3:APIC", "mpeg", "id3v1"),
    "boxes": ("ftyp", "mvhd", "ispe"), "psd": ("head:psd", "8bim:03ed", "8bim:0424", "8bim:040f"), "exif": (), "ole2": ("app",),
}


def _png_text() -> Column:
    """The entry PNG:<keyword> of an uncompressed text chunk."""
    latin = F.decode(F.col("data"), "ISO-8859-1")
    plain = F.regexp_replace(latin, r"(?s)^[^\x00]*\x00", "")
    wide = F.make_valid_utf8(F.encode(F.regexp_extract(latin, r"(?s)^[^\x00]*\x00..[^\x00]*\x00[^\x00]*\x00(.*)$", 1), "ISO-8859-1").cast("string"))
    return _one(F.concat(F.lit("PNG:"), F.substring_index(latin, "\0", 1)), json_value(F.when(F.col("kind") == "iTXt", wide).otherwise(plain)))


def _named(values: dict[str, Column], seq: Column) -> Column:
    """Entries (seq, name, value as JSON) of several fields."""
    return F.array(*(F.struct(seq.alias("seq"), F.lit(n).alias("name"), json_value(v).alias("value")) for n, v in values.items()))


def _own_entries(kinds: list[str], forms: set[str]) -> Column:
    """The entries that a part alone gives, or null; ``forms``: those that coded parts may have here."""
    found = F.when(F.col("form").isNotNull(), _coded(forms)) if forms else F
    found = found.when(F.col("kind").isin("tEXt", "iTXt") & F.contains(F.decode("data", "ISO-8859-1"), F.lit("\0")), _png_text())
    for k in kinds:
        first = F.lit(-1) if k == "8bim:0424" else F.col("seq")  # an XMP packet's words come before the picture's own
        found = found.when(F.col("k_kind") == k, _named(_fields(k), first))
    return found


TOGETHER = ("gps:0001", "gps:0002", "gps:0003", "gps:0004", "trak", "tkhd", "hdlr", "stsd", "fmt ", "data", "ds64")


def _first(kind: str, among: Column = None) -> Column:
    """The data of the first part of a kind, null without one."""
    return F.try_element_at(F.filter(F.col("k_parts") if among is None else among, lambda x: x["kind"] == kind), F.lit(1))["data"]


def _place() -> Column:
    """Latitude and longitude in degrees, from their four tags."""
    seq = F.array_min(F.transform(F.filter("k_parts", lambda x: x["kind"].startswith("gps:")), lambda x: x["seq"]))
    degree = lambda d, i: _exif_number(d, F.lit(i), F.lit(5))
    values = {}
    for name, at, of in (("GPSLatitude", "gps:0002", "gps:0001"), ("GPSLongitude", "gps:0004", "gps:0003")):
        d = _first(at)
        values[name] = decimal_degrees(degree(d, 0), degree(d, 1), degree(d, 2), F.decode(F.substring(_first(of), 7, 1), "ISO-8859-1"))
    return F.when(seq.isNotNull(), _named(values, seq))


def _tracks() -> Column:
    """Each track of a film: seq, type, codec, w, h and turn; the boxes between its start and the next one's."""
    starts = F.transform(F.filter("k_parts", lambda x: x["kind"] == "trak"), lambda x: x["seq"])
    shift = lambda d: F.when(h.big(d, 0, 1) == 1, 12).otherwise(0)
    at = lambda d, n: h.big(d, shift(d) + n)
    four = lambda d, n: F.nullif(F.trim(F.decode(F.substring(d, n + 1, 4), "ISO-8859-1")), F.lit(""))

    def track(start: Column, i: Column) -> Column:
        own = F.filter("k_parts", lambda x: (x["seq"] > start) & (x["seq"] < F.coalesce(F.get(starts, i + 1), F.lit(2**31 - 1))))
        head = _first("tkhd", own)
        turn = F.round(F.degrees(F.atan2(h.signed(at(head, 44)).cast("double"), h.signed(at(head, 40)).cast("double")))).cast("long")
        return F.struct(start.alias("seq"), four(_first("hdlr", own), 8).alias("type"), four(_first("stsd", own), 12).alias("codec"), F.round(at(head, 76) / 65536).cast("long").alias("w"), F.round(at(head, 80) / 65536).cast("long").alias("h"), turn.alias("turn"))

    return F.transform(starts, track)


def _film() -> Column:
    """Tracks of a film: count, picture size, rotation and codecs, each of the last track that has it."""
    last = lambda kind, f: F.try_element_at(F.filter(F.transform(F.filter("k_tracks", lambda t: t["type"] == kind), f), lambda x: x.isNotNull()), F.lit(-1))
    values = {
        "TrackCount": F.size("k_tracks"), "Width": last("vide", lambda t: F.nullif(t["w"], F.lit(0))), "Height": last("vide", lambda t: F.nullif(t["h"], F.lit(0))),
        "Rotation": last("vide", lambda t: F.when(t["turn"] != 0, F.concat(t["turn"].cast("string"), F.lit("°")))),
        "VideoCodec": last("vide", lambda t: t["codec"]), "AudioCodec": last("soun", lambda t: t["codec"]),
    }
    return F.when(F.size("k_tracks") > 0, _named(values, F.array_max(F.transform("k_tracks", lambda t: t["seq"]))))


def _wav_length() -> Column:
    """Duration of a WAV file: bytes of its data over bytes a second; those of data beyond four gigabytes stand in ds64."""

    def seconds(p: Column) -> Column:
        own, long = h.big(p["data"], 0), p["long"]
        n = F.when((own == 2**32 - 1) & long.isNotNull(), h.little(long, 12) + h.little(long, 16) * 2.0**32).otherwise(own)
        return _let(h.little(p["fmt"], 12), lambda rate: F.when(rate > 0, n / rate))

    seq = F.array_max(F.transform(F.filter("k_parts", lambda x: x["kind"].isin("fmt ", "data")), lambda x: x["seq"]))
    told = F.struct(_let(F.struct(_first("fmt ").alias("fmt"), _first("data").alias("data"), _first("ds64").alias("long")), seconds).alias("s"), seq.alias("seq"))
    return _let(told, lambda x: F.when(x["s"].isNotNull(), _named({"duration": minutes_clock(x["s"]), "durationSeconds": F.round(x["s"], 2)}, x["seq"])))


def entries(parts: DataFrame, key: str = "id", extensions: list[str] | None = None) -> DataFrame:
    """key and k_entries of each file of ``sources.chunks.parts``: its entries (seq, name, value), sorted.

    Where the files' ``extensions`` are known, only what these need is compiled.

    Files are walked once and their parts meet in one shuffle; what several parts say together is
    read from the few parts that it needs.
    """
    walkers = {w.__name__ for e, w in WALKERS.items() if extensions is None or e in extensions}
    forms = {f for w in walkers for f in FORMS_OF.get(w, () if w in KINDS_OF else sum(FORMS_OF.values(), ()))}  # a walker of one's own may yield any
    kinds = [k for w, own in KINDS_OF.items() if w in walkers for k in own]
    kind = F.when(F.col("kind") == "head", F.when(F.substring("data", 1, 4) == F.lit(b"8BPS"), "head:psd").otherwise("head:gif")).otherwise(F.col("kind"))
    names = dictionary(parts.sparkSession).withColumnRenamed("key", "k_name")
    rows = parts.withColumn("k_kind", kind)
    rows = rows.join(F.broadcast(names), "kind", "left") if forms else rows  # a fixed table
    rows = rows.select(key, _own_entries(kinds, forms).alias("k_own"), F.when(F.col("kind").isin(*TOGETHER), F.struct("seq", "kind", "data")).alias("k_part")).where("k_own is not null or k_part is not null")
    files = rows.groupBy(key).agg(F.flatten(F.collect_list("k_own")).alias("k_own"), F.sort_array(F.collect_list("k_part")).alias("k_parts"))  # one file's parts
    if "boxes" in walkers:
        files = files.withColumn("k_tracks", _tracks())
    together = [f() for w, f in (("exif", _place), ("boxes", _film), ("wav", _wav_length)) if w in walkers]
    none = F.array().cast("array<struct<seq:int,name:string,value:string>>")
    every = F.concat("k_own", *(F.coalesce(x, none) for x in together))
    return files.select(key, F.array_sort(F.filter(every, lambda e: e["value"].isNotNull() & (e["value"] != "null"))).alias("k_entries"))


def gathered(found: DataFrame, key: str = "id") -> DataFrame:
    """One JSON object a file, names in order of appearance; keyword lists are joined.

    Of a repeated name the first counts, but an ID3v1 tag, the last part of its file, replaces what
    ID3v2 frames said.
    """
    e = F.col("k_entries")
    last = F.element_at(e, -1)["seq"]

    def pair(name: Column) -> Column:
        own = F.filter(e, lambda x: x["name"] == name)
        words = F.to_json(F.array(F.array_join(F.transform(own, lambda x: F.get_json_object(F.concat(F.lit("["), x["value"], F.lit("]")), "$[0]")), ", ")))
        late = F.when(name.isin("title", "artist", "album", "year", "comment", "genre", "track"), F.try_element_at(F.filter(own, lambda x: x["seq"] == last), F.lit(-1))["value"])
        value = F.when(name == "IptcKeywords", F.regexp_replace(words, r"(?s)^\[|\]$", "")).otherwise(F.coalesce(late, F.element_at(own, 1)["value"]))
        return F.concat(json_value(name), F.lit(":"), value)

    pairs = F.transform(F.array_distinct(F.transform(e, lambda x: x["name"])), pair)
    return found.where(F.size(e) > 0).select(key, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")).alias("deepMeta"))
