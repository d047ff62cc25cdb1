"""Numbers at fixed places of binary files, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import ratio

# Names of header codes.
PNG_COLOURS = {0: ("Grayscale", 1), 2: ("RGB", 3), 3: ("Indexed (palette)", 1), 4: ("Grayscale + Alpha", 2), 6: ("RGBA", 4)}
BMP_COMPRESSION = {0: "None (BI_RGB)", 1: "RLE8", 2: "RLE4", 3: "Bitfields"}
BMP_HEADERS = {40: "BITMAPINFOHEADER", 108: "BITMAPV4HEADER", 124: "BITMAPV5HEADER"}
WAV_FORMATS = {1: "PCM", 3: "IEEE Float", 6: "A-law", 7: "µ-law"}
PSD_MODES = {0: "Bitmap", 1: "Grayscale", 2: "Indexed", 3: "RGB", 4: "CMYK", 7: "Multichannel", 8: "Duotone", 9: "Lab"}


def big(content: Column, at: int | Column, n: int = 4) -> Column:
    """An unsigned big-endian number of n bytes at a place counted from 0."""
    first = at + 1 if isinstance(at, int) else (at + 1).cast("int")
    return F.conv(F.nullif(F.hex(F.substring(content, first, n) if isinstance(first, int) else content.substr(first, F.lit(n))), F.lit("")), 16, 10).cast("long")


def little(content: Column, at: int | Column, n: int = 4) -> Column:
    total = big(content, at, 1)
    for i in range(1, n):
        total = total + big(content, at + i, 1) * 256**i
    return total


def signed(x: Column, bits: int = 32) -> Column:
    return F.when(x >= 2 ** (bits - 1), x - 2**bits).otherwise(x)


def named(code: Column, names: dict[int, str], other: str) -> Column:
    """A code's name, else ``other`` with the code in place of %d."""
    out = F.when(F.lit(False), F.lit(""))
    for k, v in names.items():
        out = out.when(code == k, v)
    return out.otherwise(F.format_string(other, code))


def picture(width: Column, height: Column) -> dict[str, Column]:
    """AspectRatio and Megapixels of a picture with both sides."""
    ok = (width > 0) & (height > 0)
    return {"AspectRatio": F.when(ok, ratio(width, height)), "Megapixels": F.when(ok, F.format_string("%.1f MP", width * height / 1_000_000))}


def png_header(ihdr: Column, at: int = 0) -> dict[str, Column]:
    """Fields of an IHDR chunk whose data start at ``at``."""
    depth, colour = big(ihdr, at + 8, 1), big(ihdr, at + 9, 1)
    channels = F.lit(1)
    for k, (_, n) in PNG_COLOURS.items():
        channels = F.when(colour == k, n).otherwise(channels)
    width, height = big(ihdr, at), big(ihdr, at + 4)
    return {
        "Width": width, "Height": height, "BitDepth": depth, "ColorType": named(colour, {k: v for k, (v, _) in PNG_COLOURS.items()}, "Unknown (%d)"),
        "AlphaChannel": F.when(colour.isin(4, 6), "Yes").otherwise("No"), "Compression": F.lit("Deflate"),
        "Interlaced": F.when(big(ihdr, at + 12, 1) == 1, "Adam7").otherwise("No"), "BitsPerPixel": depth * channels, **picture(width, height),
    }


def bmp_header(content: Column) -> dict[str, Column]:
    """Fields of a bitmap file; resolution is only read from headers longer than the basic one."""
    dib, bpp = little(content, 14), little(content, 28, 2)
    full = dib >= 40
    per_metre = lambda at: F.when((dib >= 48) & (signed(little(content, at)) > 0), F.round(little(content, at) / 39.3701).cast("long"))
    width, height = F.when(full, signed(little(content, 18))), F.when(full, F.abs(signed(little(content, 22))))
    used = little(content, 46)
    return {
        "DIBHeader": named(dib, BMP_HEADERS, "%d bytes"), "Width": width, "Height": height, "BitsPerPixel": F.when(full, bpp),
        "AlphaChannel": F.when(full, F.when(bpp == 32, "Likely").otherwise("No")), "Compression": F.when(full, named(little(content, 30), BMP_COMPRESSION, "Code %d")),
        "DpiX": per_metre(38), "DpiY": per_metre(42), "ColorsUsed": F.when((dib >= 52) & (used > 0), used),
        "ColorSpace": F.when(full, F.when(bpp <= 8, "Indexed").when(bpp == 24, "RGB").when(bpp == 32, "RGBA").otherwise(F.format_string("%d-bit", bpp))), **picture(width, height),
    }


def ico_fields(content: Column) -> dict[str, Column]:
    kind, n = little(content, 2, 2), little(content, 4, 2)
    whole = F.least(n, F.floor((F.octet_length(content) - 6) / 16))

    def entry(i: Column) -> Column:
        at = i * 16 + 6
        side = lambda k: F.when(big(content, at + k, 1) == 0, 256).otherwise(big(content, at + k, 1))
        bpp = little(content, at + 6, 2)
        return F.concat(side(0).cast("string"), F.lit("x"), side(1).cast("string"), F.when(bpp > 0, F.format_string(" (%dbpp)", bpp)).otherwise(""))

    sizes = F.when(whole > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(whole, F.lit(1)).cast("int") - 1), entry), ", "))
    return {"IconType": named(kind, {1: "Icon", 2: "Cursor"}, "Type %d"), "ImageCount": n, "Sizes": sizes}


def webp_fields(content: Column) -> dict[str, Column]:
    """Lossy, lossless and extended files; a lossless file's signature is looked for at its place."""
    kind = F.decode(F.substring(content, 13, 4), "ISO-8859-1")
    bits = little(content, 21)
    flags = big(content, 20, 1)
    flag = lambda mask: (kind == "VP8X") & (flags.bitwiseAND(mask) != 0)
    lossy = lambda at: little(content, at, 2).bitwiseAND(0x3FFF)
    width = F.when(kind == "VP8 ", lossy(26)).when(kind == "VP8L", bits.bitwiseAND(0x3FFF) + 1).when(kind == "VP8X", little(content, 24, 3) + 1)
    height = F.when(kind == "VP8 ", lossy(28)).when(kind == "VP8L", F.shiftright(bits, 14).bitwiseAND(0x3FFF) + 1).when(kind == "VP8X", little(content, 27, 3) + 1)
    return {
        "WebPFormat": F.when(kind == "VP8 ", "Lossy").when(kind == "VP8L", "Lossless").when(kind == "VP8X", "Extended"),
        "Compression": F.when(kind == "VP8 ", "Lossy (VP8)").when(kind == "VP8L", "Lossless (VP8L)"), "Width": width, "Height": height,
        "AlphaChannel": F.when(flag(0x10) | ((kind == "VP8L") & (F.shiftright(bits, 28).bitwiseAND(1) == 1)), "Yes").otherwise("No"),
        "Animated": F.when(flag(0x02), "Yes"), "ICCProfile": F.when(flag(0x20), "Present"), "EXIF": F.when(flag(0x08), "Present"), "XMP": F.when(flag(0x04), "Present"),
        "ColorSpace": F.lit("RGB"), **picture(width, height),
    }


def psd_header(content: Column) -> dict[str, Column]:
    return {
        "Format": F.when(big(content, 4, 2) == 2, "PSB").otherwise("PSD"), "Channels": big(content, 12, 2), "Height": big(content, 14), "Width": big(content, 18),
        "BitDepth": big(content, 22, 2), "ColorMode": named(big(content, 24, 2), PSD_MODES, "Unknown (%d)"),
    }
