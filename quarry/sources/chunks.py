"""Container files as rows of their parts.

A walker yields (kind, data) for the parts of one file; what the parts mean is left to columns
(``plans.metadata``). A damaged file gives the parts before the damage.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MOST = 65_536  # bytes of a part that are kept
Part = tuple[str, bytes]


def png(b: bytes) -> Iterator[Part]:
    at = 8 if b[:8] == b"\x89PNG\r\n\x1a\n" else len(b)
    while at + 8 < len(b):
        n, kind = struct.unpack_from(">I4s", b, at)
        if kind == b"IDAT" or at + 8 + n > len(b):
            return
        yield kind.decode("latin-1"), b[at + 8 : at + 8 + n]
        at += 12 + n


def gif(b: bytes) -> Iterator[Part]:
    if b[:4] != b"GIF8" or len(b) < 13:
        return
    yield "head", b[:13]
    at = 13 + (3 << (b[10] & 7) + 1 if b[10] & 128 else 0)
    frames = 0
    while at < len(b) and b[at] in (0x21, 0x2C):
        if b[at] == 0x2C:
            if at + 10 > len(b):
                break
            frames += 1
            at += 11 + (3 << (b[at + 9] & 7) + 1 if b[at + 9] & 128 else 0)
        else:
            at += 2
        while at < len(b) and b[at]:
            at += b[at] + 1
        at += 1
    yield "frames", struct.pack(">I", frames)


def _long_sizes(b: bytes) -> dict[bytes, int]:
    """Sizes of an RF64 file's chunks that have all ones in their own four bytes, from its first chunk."""
    if b[:4] not in (b"RF64", b"BW64") or b[12:16] != b"ds64":
        return {}
    n, _, data, _, count = struct.unpack_from("<IQQQI", b, 16)
    return dict(struct.unpack_from("<4sQ", b, 48 + 12 * i) for i in range(min(count, (n - 28) // 12))) | {b"data": data}


def riff(b: bytes, order: str = "<") -> Iterator[Part]:
    """RIFF, RF64 or FORM chunks after their four bytes of size; LIST-INFO members come as parts of their own."""
    stack, long = [(12, len(b))], _long_sizes(b)
    while stack:
        at, end = stack.pop()
        while at + 8 <= end:
            kind, size = struct.unpack_from(order + "4sI", b, at)
            n = long.get(kind, size) if size == 0xFFFFFFFF else size
            if kind == b"LIST" and b[at + 8 : at + 12] == b"INFO":
                stack.append((at + 8 + n + n % 2, end))
                at, end = at + 12, min(end, at + 8 + n)
                continue
            yield kind.decode("latin-1"), struct.pack(">I", size) + b[at + 8 : min(end, at + 8 + n)][:MOST]
            at += 8 + n + n % 2


def aiff(b: bytes) -> Iterator[Part]:
    yield from riff(b, ">") if b[:4] == b"FORM" else ()


def wav(b: bytes) -> Iterator[Part]:
    yield from riff(b) if b[:4] in (b"RIFF", b"RF64", b"BW64") and b[8:12] == b"WAVE" else ()


def vorbis(b: bytes) -> Iterator[Part]:
    """A Vorbis comment packet: its vendor, then each comment under its name; at most 200."""
    at = 4 + struct.unpack_from("<I", b)[0]
    yield "vorbis:encoder", b[4:at]
    count, at = struct.unpack_from("<I", b, at)[0], at + 4
    for _ in range(min(count, 200)):
        n = struct.unpack_from("<I", b, at)[0]
        name, _, value = b[at + 4 : at + 4 + n].partition(b"=")
        yield "vorbis:" + name.decode("utf-8", "replace").lower(), value
        at += 4 + n


def flac(b: bytes) -> Iterator[Part]:
    at, last = 4 if b[:4] == b"fLaC" else len(b), 0
    while at + 4 < len(b) and not last:
        last, kind, n = b[at] & 128, b[at] & 127, int.from_bytes(b[at + 1 : at + 4], "big")
        data = b[at + 4 : at + 4 + n]
        yield f"flac:{kind}", data[:MOST]
        if kind == 4:
            yield from vorbis(data)
        at += 4 + n


def _unpaged(b: bytes) -> bytes:
    """The packets of an Ogg file's first stream without page headers; other bytes as they are."""
    out, at, serial = [], 0, b[14:18]
    while b[at : at + 4] == b"OggS" and at + 27 <= len(b):
        start = at + 27 + b[at + 26]
        end = start + sum(b[at + 27 : start])
        if b[at + 14 : at + 18] == serial:
            out.append(b[start:end])
        at = end
    return b"".join(out) if out else b


def ogg(b: bytes) -> Iterator[Part]:
    packets = _unpaged(b)
    for mark, kind in ((b"\x01vorbis", "ogg:vorbis"), (b"OpusHead", "ogg:opus")):
        if (at := b.find(mark)) >= 0:
            yield kind, b[at + len(mark) : at + len(mark) + 32]
    for mark in (b"\x03vorbis", b"OpusTags"):
        source = packets if mark in packets else b  # a later stream's comments are read as they lie
        if (at := source.find(mark)) >= 0:
            yield from vorbis(source[at + len(mark) :])


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def mp3(b: bytes) -> Iterator[Part]:
    """ID3v2 frames, the first MPEG frame header and the ID3v1 tag."""
    start = 0
    if b[:3] == b"ID3" and len(b) >= 10:
        yield "id3", b[3:4]
        start = end = 10 + _syncsafe(b[6:10])
        at = 10 + (0 if not b[5] & 64 else _syncsafe(b[10:14]) if b[3] >= 4 else int.from_bytes(b[10:14], "big") + 4)
        while at + 10 < min(end, len(b)) and b[at : at + 4] != b"\0\0\0\0":
            n = _syncsafe(b[at + 4 : at + 8]) if b[3] >= 4 else int.from_bytes(b[at + 4 : at + 8], "big")
            if n <= 0 or at + 10 + n > min(end, len(b)):
                break
            yield "id3:" + b[at : at + 4].decode("latin-1"), b[at + 10 : at + 10 + n][:MOST]
            at += 10 + n
    elif b[:1] != b"\xff":
        return
    for at in range(start, max(start, len(b) - 4)):
        x = b[at : at + 4]
        if x[0] == 0xFF and x[1] & 0xE0 == 0xE0 and x[1] >> 3 & 3 != 1 and x[1] >> 1 & 3 and x[2] >> 4 != 15 and x[2] >> 2 & 3 != 3:
            yield "mpeg", x
            break
    if b[-128:-125] == b"TAG":
        yield "id3v1", b[-128:]


def boxes(b: bytes, start: int = 0, end: int | None = None, depth: int = 0) -> Iterator[Part]:
    """ISO media boxes, inner ones after their container."""
    at, end = start, len(b) if end is None else end
    while at + 8 <= end:
        n, kind = struct.unpack_from(">I4s", b, at)
        head = 8
        if n == 1 and at + 16 <= end:
            n, head = struct.unpack_from(">Q", b, at + 8)[0], 16
        n = end - at if n == 0 else n
        if n < head:
            return
        stop = min(end, at + n)
        yield kind.decode("latin-1"), b[at + head : min(stop, at + head + 256)]
        if kind in (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"meta", b"iprp", b"ipco") and depth < 12:
            yield from boxes(b, at + head + (4 if kind == b"meta" else 0), stop, depth + 1)
        at += n


def psd(b: bytes) -> Iterator[Part]:
    """The header and image resources; keyword records of a press resource one by one."""
    if b[:4] != b"8BPS" or len(b) < 30:
        return
    yield "head", b[:26]
    at = 30 + int.from_bytes(b[26:30], "big")
    end = min(len(b), at + 4 + int.from_bytes(b[at : at + 4], "big"))
    at += 4
    while at + 12 <= end and b[at : at + 4] == b"8BIM":
        kind = b[at + 4 : at + 6].hex()
        at += 6 + (b[at + 6] + 2 & ~1)
        n = int.from_bytes(b[at : at + 4], "big")
        data = b[at + 4 : at + 4 + n]
        yield "8bim:" + kind, data[:MOST]
        k = 0
        while kind == "0404" and data[k : k + 1] == b"\x1c" and k + 5 <= n:
            size = int.from_bytes(data[k + 3 : k + 5], "big")
            if data[k + 1] == 2:
                yield f"iptc:{data[k + 2]}", data[k + 5 : k + 5 + size]
            k += 5 + size
        at += 4 + n + n % 2


def exif(b: bytes) -> Iterator[Part]:
    """Entries of the tag directories of a TIFF or JPEG file: "tag:hhhh" or "gps:hhhh", value bytes.

    A part's data are type, count, then the value, all big-endian.
    """
    if b[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(b) and b[at] == 0xFF and b[at + 1] != 0xDA:
            n = int.from_bytes(b[at + 2 : at + 4], "big")
            if b[at + 1] == 0xE1 and b[at + 4 : at + 10] == b"Exif\0\0":
                b = b[at + 10 : at + 2 + n]
                break
            at += 2 + n
        else:
            return
    if b[:4] not in (b"II*\0", b"MM\0*"):
        return
    o = "<" if b[:2] == b"II" else ">"
    size = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
    open_, seen = [("tag", struct.unpack_from(o + "I", b, 4)[0])], set()
    while open_:
        space, at = open_.pop(0)
        if at in seen or at + 2 > len(b):
            continue
        seen.add(at)
        for k in range(struct.unpack_from(o + "H", b, at)[0]):
            if at + 14 + 12 * k > len(b):
                return
            tag, kind, count = struct.unpack_from(o + "HHI", b, at + 2 + 12 * k)
            n = size.get(kind, 0) * count
            where = at + 10 + 12 * k if n <= 4 else struct.unpack_from(o + "I", b, at + 10 + 12 * k)[0]
            if tag in (0x8769, 0x8825):
                open_.append(("gps" if tag == 0x8825 else "tag", struct.unpack_from(o + "I", b, at + 10 + 12 * k)[0]))
            elif n > 0 and tag != 0x927C:
                unit = {3: 2, 4: 4, 5: 4, 9: 4, 10: 4}.get(kind, 1)
                value = b[where : where + n]
                if o == "<":
                    value = b"".join(value[i : i + unit][::-1] for i in range(0, n, unit))
                yield f"{space}:{tag:04x}", struct.pack(">HI", kind, count) + value


def _word(d: bytes, i: int) -> int:
    return int.from_bytes(d[i : i + 4], "little")


def ole2_streams(b: bytes) -> Callable[[str], bytes] | None:
    """A reader of an OLE2 file's streams by name (empty for an unknown one); null for other files."""
    if b[:8] != bytes.fromhex("D0CF11E0A1B11AE1"):
        return None
    big, small = 1 << int.from_bytes(b[30:32], "little"), 64
    word = _word
    sector = lambda i: b[(i + 1) * big : (i + 2) * big]
    held, at, seen = list(struct.unpack("<109I", b[76:512].ljust(436, b"\0"))), word(b, 68), set()
    while at < 0xFFFFFFFC and at not in seen and len(more := sector(at)) == big:  # further FAT sectors' numbers
        seen.add(at)
        held += [word(more, i) for i in range(0, big - 4, 4)]
        at = word(more, big - 4)
    fat = b"".join(sector(i) for i in held if i < 0xFFFFFFFC)

    def chain(first: int, table: bytes, read: Callable[[int], bytes]) -> bytes:
        out, at = [], first
        while at < 0xFFFFFFFC and len(out) < 10_000:
            out.append(read(at))
            at = word(table, 4 * at) if 4 * at + 4 <= len(table) else 0xFFFFFFFE
        return b"".join(out)

    tree = chain(word(b, 48), fat, sector)
    entries = {tree[i : i + 64].decode("utf-16le", "replace").split("\0")[0]: (word(tree, i + 116), word(tree, i + 120)) for i in range(0, len(tree) - 127, 128)}
    mini = chain(entries.get("Root Entry", (0xFFFFFFFE, 0))[0], fat, sector)
    minifat = chain(word(b, 60), fat, sector)

    def read(name: str) -> bytes:
        first, size = entries.get(name, (0xFFFFFFFE, 0))
        return (chain(first, fat, sector) if size >= 4096 else chain(first, minifat, lambda i: mini[i * small : (i + 1) * small]))[:size]

    return read


def ole2(b: bytes) -> Iterator[Part]:
    """Properties of an OLE2 file's two summary streams: "sum:n" or "doc:n", type and value bytes; without any, the application's name as it stands in the file."""
    stream, word = ole2_streams(b), _word
    found = False
    for space, name in (("sum", "\x05SummaryInformation"), ("doc", "\x05DocumentSummaryInformation")) if stream else ():
        data = stream(name)
        base = word(data, 44) if len(data) >= 48 else len(data)
        for k in range(min(word(data, base + 4), 50) if base + 8 <= len(data) else 0):
            number, at = word(data, base + 8 + 8 * k), base + word(data, base + 12 + 8 * k)
            kind = word(data, at)
            n = {30: word(data, at + 4), 31: 2 * word(data, at + 4), 64: 8, 3: 4}.get(kind, 0)
            start = at + (8 if kind in (30, 31) else 4)
            if n:
                found = True
                yield f"{space}:{number}", bytes([kind]) + data[start : start + n][:MOST]
    for name in (b"Word", b"Excel", b"PowerPoint") if stream and not found else ():
        if m := re.search(b"Microsoft (?:Office )?" + name, b):
            yield "app", m[0]
            return


WALKERS: dict[str, Callable[[bytes], Iterator[Part]]] = {
    "png": png, "gif": gif, "wav": wav, "wave": wav, "aiff": aiff, "aif": aiff, "flac": flac, "ogg": ogg, "oga": ogg,
    "mp3": mp3, "aac": mp3, "mp4": boxes, "mov": boxes, "m4v": boxes, "heic": boxes, "heif": boxes, "psd": psd, "psb": psd,
    "jpg": exif, "jpeg": exif, "tiff": exif, "tif": exif, "doc": ole2, "dot": ole2, "xls": ole2, "xlt": ole2, "ppt": ole2, "pps": ole2,
}


def register_walker(extension: str, walker: Callable[[bytes], Iterator[Part]]) -> None:
    """Add a container format, or replace one."""
    WALKERS[extension] = walker


def parts(files: DataFrame, key: str = "id") -> DataFrame:
    """``files`` (key, extension, content): key, seq, kind, data of every part of known containers."""
    from pyspark.sql.pandas.types import to_arrow_type

    known = dict(WALKERS)
    kind_of_key = to_arrow_type(files.schema[key].dataType)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(key, kind_of_key), ("seq", pa.int32()), ("kind", pa.string()), ("data", pa.binary())])
        for batch in batches:
            rows = []
            for k, extension, content in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (key, "extension", "content")), strict=True):
                try:
                    for kind, data in known[extension](content or b""):
                        rows.append((k, len(rows), kind, data))
                except (struct.error, IndexError):  # damaged: the parts so far
                    pass
            yield pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(schema.names)}, schema=schema)

    chosen = files.where(files["extension"].isin(*known)).select(key, "extension", "content")
    return chosen.mapInArrow(walk, f"{key} {files.schema[key].dataType.simpleString()}, seq int, kind string, data binary")
