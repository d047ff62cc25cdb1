"""Container formats and documents built here, with known metadata."""

import io
import json
import struct
import zipfile

import pytest

from quarry.plans.extract import extract
from quarry.sources import chunks
from quarry.sources.archives import unzip


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + b"\0\0\0\0"


def box(kind, data):
    return struct.pack(">I4s", 8 + len(data), kind) + data


def text_frame(kind, text, enc=3):
    data = bytes([enc]) + text.encode({0: "latin-1", 1: "utf-16", 3: "utf-8"}[enc])
    return kind + struct.pack(">IH", len(data), 0) + data


def package(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def tiff(order="<"):
    def entry(tag, kind, count, value):
        return struct.pack(order + "HHI", tag, kind, count) + value

    short = lambda v: struct.pack(order + "HH", v, 0)
    long = lambda v: struct.pack(order + "I", v)
    head = (b"II*\0" if order == "<" else b"MM\0*") + long(8)
    main = [entry(0x0100, 3, 1, short(640)), entry(0x010F, 2, 6, long(200)), entry(0x011A, 5, 1, long(210)), entry(0x8769, 4, 1, long(100)), entry(0x8825, 4, 1, long(140))]
    sub = [entry(0x9003, 2, 20, long(220)), entry(0x829A, 5, 1, long(250))]
    gps = [entry(1, 2, 2, b"S\0\0\0"), entry(2, 5, 3, long(260)), entry(3, 2, 2, b"E\0\0\0"), entry(4, 5, 3, long(284))]
    body = bytearray(400)
    for at, rows in ((8, main), (100, sub), (140, gps)):
        data = struct.pack(order + "H", len(rows)) + b"".join(rows)
        body[at : at + len(data)] = data
    body[:8] = head
    ratio = lambda *xs: b"".join(struct.pack(order + "II", *x) for x in xs)
    for at, data in ((200, b"Canon\0"), (210, ratio((72, 1))), (220, b"2024:01:02 03:04:05\0"), (250, ratio((1, 0))), (260, ratio((33, 1), (30, 1), (0, 1))), (284, ratio((151, 1), (12, 1), (36, 1)))):
        body[at : at + len(data)] = data
    return bytes(body)


def ole2_file():
    text = lambda s: struct.pack("<II", 30, len(s) + 1) + s.encode() + b"\0" + b"\0" * (-(len(s) + 1) % 4)
    values = {2: text("Plan"), 4: text("Ann"), 12: struct.pack("<IQ", 64, (11_644_473_600 + 86_400) * 10**7), 14: struct.pack("<II", 3, 7), 10: struct.pack("<IQ", 64, 75 * 600_000_000)}
    table, data = b"", b""
    for k, v in values.items():
        table += struct.pack("<II", k, 8 + 8 * len(values) + len(data))
        data += v
    stream = b"\xfe\xff" + b"\0" * 26 + b"\0" * 16 + struct.pack("<I", 48)
    stream += struct.pack("<II", 8 + len(table) + len(data), len(values)) + table + data
    entry = lambda name, kind, first, size: (name.encode("utf-16le") + b"\0" * 64)[:64] + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<IQ", first, size)
    mini = stream + b"\0" * (-len(stream) % 64)
    sectors = [b"", b"", b"", mini + b"\0" * (-len(mini) % 512)]
    n = len(sectors[3]) // 512
    end, free = 0xFFFFFFFE, 0xFFFFFFFF
    fat = [0xFFFFFFFD, end, end, *range(4, 3 + n), end]
    sectors[0] = struct.pack("<128I", *(fat + [free] * (128 - len(fat))))
    sectors[1] = entry("Root Entry", 5, 3, len(mini)) + entry("\x05SummaryInformation", 2, 0, len(stream)) + b"\0" * 256
    k = len(mini) // 64
    sectors[2] = struct.pack("<128I", *([*range(1, k), end] + [free] * (128 - k)))
    head = bytes.fromhex("D0CF11E0A1B11AE1") + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6
    head += struct.pack("<IIIIIIIII", 0, 1, 1, 0, 4096, 2, 1, end, 0) + struct.pack("<109I", 0, *[free] * 108)
    return head + b"".join(sectors)


def fixtures():
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 640, 480, 8, 6, 0, 0, 1)) + chunk(b"gAMA", struct.pack(">I", 45455)) + chunk(b"tEXt", b"Author\0Ann") + chunk(b"iTXt", "Title\0\0\0en\0t\0Été".encode()) + chunk(b"IDAT", b"x")
    gif = b"GIF89a" + struct.pack("<HHBBB", 10, 5, 0x80, 0, 0) + b"\0" * 6 + (b"\x21\xf9\x04" + b"\0" * 4 + b"\0" + b"\x2c" + b"\0" * 9 + b"\x02\x01\0\0") * 2 + b"\x3b"
    info = b"INFO" + b"IART" + struct.pack("<I", 4) + b"Ann\0" + b"INAM" + struct.pack("<I", 5) + b"Song\0\0"
    wave = b"WAVE" + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 2, 44100, 176400, 4, 16) + b"LIST" + struct.pack("<I", len(info)) + info + b"data" + struct.pack("<I", 352800) + b"\0" * 8
    flac = b"fLaC" + b"\0\0\0\x22" + struct.pack(">HH", 16, 16) + b"\0" * 6 + ((44100 << 44) | (1 << 41) | (15 << 36) | 88200).to_bytes(8, "big") + b"\0" * 16
    vendor = struct.pack("<I", 3) + b"lib" + struct.pack("<I", 3) + b"".join(struct.pack("<I", len(c)) + c for c in (b"TITLE=One", b"title=Two", b"DATE=2001"))
    flac += b"\x84" + len(vendor).to_bytes(3, "big") + vendor
    frames = text_frame(b"TIT2", "Söng", 1) + text_frame(b"TPE1", "Ann") + b"COMM" + struct.pack(">IH", 8, 0) + b"\x00engd\0hi"
    mp3 = b"ID3\x03\0\0" + bytes([0, 0, len(frames) >> 7, len(frames) & 127]) + frames + b"\xff\xfb\x90\x44" + b"\0" * 300 + b"TAG" + b"Old".ljust(30, b"\0") + b"\0" * 30 + b"Alb".ljust(30, b"\0") + b"1999" + b"c".ljust(28, b"\0") + b"\0\x05\x11"
    aiff = b"FORM" + struct.pack(">I", 30) + b"AIFF" + b"COMM" + struct.pack(">IHIH", 18, 1, 16000, 16) + bytes.fromhex("400BFA00000000000000")
    track = box(b"tkhd", b"\0" * 40 + struct.pack(">ii", 0, 65536) + b"\0" * 28 + struct.pack(">II", 320 << 16, 240 << 16)) + box(b"mdia", box(b"hdlr", b"\0" * 8 + b"vide") + box(b"minf", box(b"stbl", box(b"stsd", b"\0" * 12 + b"avc1"))))
    mp4 = box(b"ftyp", b"isom\0\0\0\0") + box(b"moov", box(b"mvhd", b"\0" * 4 + struct.pack(">IIII", 2082844800 + 86400, 0, 1000, 65500) + b"\0" * 80) + box(b"trak", track))
    press = b"\x1c\x02\x05\x00\x05Title" + b"\x1c\x02\x19\x00\x01a" + b"\x1c\x02\x19\x00\x01b"
    resource = b"8BIM\x04\x04\0\0" + struct.pack(">I", len(press)) + press + b"\0" * (len(press) % 2)
    psd = b"8BPS\0\x01" + b"\0" * 6 + struct.pack(">HIIHH", 3, 20, 30, 8, 3) + b"\0" * 4 + struct.pack(">I", len(resource)) + resource
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", 2 + 6 + 400) + b"Exif\0\0" + tiff(">") + b"\xff\xd9"
    core = "<cp:coreProperties><dc:title>A &amp; B</dc:title><dc:creator>Ann</dc:creator><dcterms:created xsi:type='x'>2024-01-02</dcterms:created></cp:coreProperties>"
    app = "<Properties><Pages>0</Pages><Application>Writer</Application></Properties>"
    custom = '<Properties><property fmtid="1" name="Client"><vt:lpwstr>Acme</vt:lpwstr></property></Properties>'
    docx = package({"docProps/core.xml": core, "docProps/app.xml": app, "docProps/custom.xml": custom, "word/document.xml": "<w:p><w:r><w:t>One&lt;</w:t></w:r></w:p><w:p/><w:p/><w:p/><w:p><w:r><w:t>Two</w:t><w:tab/><w:t>x</w:t></w:r></w:p>"})
    xlsx = package({"xl/workbook.xml": '<workbook><sheets><sheet name="A" sheetId="1"/><sheet name="B" state="hidden"/></sheets><definedNames><definedName name="_x">1</definedName><definedName name="R">2</definedName></definedNames></workbook>'})
    pdf = b"%PDF-1.7\n1 0 obj<</Title (A \\(b\\)) /Author <FEFF00C9> /CreationDate (D:2023) /Producer (P)>>endobj 2 0 obj<</Type /Pages>> 3 0 obj<</Type /Page>> 4 0 obj<</Type/Page >>\n<x:xmpmeta><pdfaid:part>2</pdfaid:part><pdfaid:conformance>B</pdfaid:conformance><dc:subject><rdf:li>k1</rdf:li><rdf:li>k2</rdf:li></dc:subject></x:xmpmeta>"
    rtf = rb"{\rtf1\ansi\deflang1033{\info{\title My \b0 Plan}{\author Ann}{\creatim\yr2024\mo1\dy2\hr3}{\nofpages4}{\edmins75}}\pard One\par Two\line\'e9\u233?\tab{\fonttbl{\f0 X;}}z}"
    return {
        "a.png": (png, {"Width": 640, "Height": 480, "ColorType": "RGBA", "Interlaced": "Adam7", "BitsPerPixel": 32, "AspectRatio": "4:3", "Megapixels": "0.3 MP", "Gamma": "0.4546", "PNG:Author": "Ann", "PNG:Title": "Été"}),
        "a.gif": (gif, {"GIFVersion": "GIF89a", "Width": 10, "Height": 5, "Animated": "Yes (2 frames)"}),
        "a.wav": (b"RIFF" + struct.pack("<I", len(wave)) + wave, {"audioFormat": "PCM", "channels": 2, "sampleRate": 44100, "bitrate": "1411 kbps", "artist": "Ann", "title": "Song", "duration": "0:02", "durationSeconds": 2.0}),
        "a.flac": (flac, {"sampleRate": 44100, "channels": 2, "bitsPerSample": 16, "duration": "0:02", "title": "One", "year": "2001", "encoder": "lib"}),
        "a.mp3": (mp3, {"id3Version": "ID3v2.3", "title": "Old", "artist": "Ann", "album": "Alb", "year": "1999", "track": "5", "mpegVersion": "MPEG1", "layer": "Layer III", "bitrate": "128 kbps", "sampleRate": 44100, "channelMode": "Joint Stereo"}),
        "a.aiff": (aiff, {"channels": 1, "sampleRate": 8000, "duration": "0:02", "bitsPerSample": 16}),
        "a.mp4": (mp4, {"MajorBrand": "isom", "Format": "MP4", "CreationDate": "1970-01-02T00:00:00.000Z", "DurationSeconds": 65.5, "Duration": "1:05", "TrackCount": 1, "Width": 320, "Height": 240, "Rotation": "90°", "VideoCodec": "avc1"}),
        "a.psd": (psd, {"Format": "PSD", "Width": 30, "Height": 20, "ColorMode": "RGB", "IptcTitle": "Title", "IptcKeywords": "a, b"}),
        "a.tif": (tiff(), {"ImageWidth": 640, "Make": "Canon", "XResolution": 72, "DateTimeOriginal": "2024:01:02 03:04:05", "ExposureTime": 0, "GPSLatitude": -33.5, "GPSLongitude": 151.21}),
        "a.jpg": (jpeg, {"ImageWidth": 640, "Make": "Canon", "GPSLatitude": -33.5}),
        "a.doc": (ole2_file(), {"title": "Plan", "author": "Ann", "created": "1970-01-02T00:00:00.000Z", "pageCount": 7, "editTime": "1h 15m"}),
        "a.docx": (docx, {"title": "A &amp; B", "creator": "Ann", "created": "2024-01-02", "pages": "0", "application": "Writer", "customProperties": {"Client": "Acme"}}),
        "a.xlsx": (xlsx, {"sheetCount": 2, "sheetNames": "A, B", "namedRanges": "R", "namedRangeCount": 1, "hiddenSheets": 1}),
        "a.pdf": (pdf, {"Title": "A (b)", "Author": "É", "CreationDate": "2023-01-01T00:00:00.000Z", "Producer": "P", "pdfVersion": "1.7", "pageCount": 2, "encrypted": False, "pdfaConformance": "PDF/A-2b", "Keywords": "k1, k2"}),
        "a.rtf": (rtf, {"title": "My Plan", "author": "Ann", "created": "2024-01-02T03:00:00.000Z", "pageCount": 4, "totalEditingTime": "1h 15m", "rtfVersion": "1", "defaultLanguageId": 1033}),
        "a.svg": (b'<svg width="5" height=\'6\' viewBox="0 0 1 1"><title> T </title><g/></svg>', {"SVGWidth": "5", "SVGHeight": "6", "ViewBox": "0 0 1 1", "SVGTitle": "T", "ElementCount": 3, "Format": "SVG/XML"}),
        "a.bmp": (b"BM" + b"\0" * 12 + struct.pack("<IiiHHI", 40, 7, -9, 1, 24, 0) + b"\0" * 20, {"DIBHeader": "BITMAPINFOHEADER", "Width": 7, "Height": 9, "Compression": "None (BI_RGB)", "ColorSpace": "RGB"}),
        "a.ico": (struct.pack("<HHH", 0, 1, 2) + bytes([16, 16, 0, 0, 1, 0, 32, 0]) + b"\0" * 8 + bytes([0, 0, 0, 0, 1, 0, 0, 0]) + b"\0" * 8, {"IconType": "Icon", "ImageCount": 2, "Sizes": "16x16 (32bpp), 256x256"}),
        "a.webp": (b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + struct.pack("<I", 99 | 49 << 14 | 1 << 28) + b"\0" * 10, {"WebPFormat": "Lossless", "Width": 100, "Height": 50, "AlphaChannel": "Yes"}),
        "a.txt": (b"one two\r\nthree\r\n", {"encoding": "utf-8", "lineEndings": "CRLF (Windows)", "lineCount": 3, "wordCount": 3, "endsWithNewline": True, "longestLine": 7}),
        "b.png": (png[:25], None),
        "c.gif": (b"no picture", None),
        "d.tif": (tiff()[:60], {"ImageWidth": 640}),
        "e.zip": (b"", None),
    }


@pytest.fixture(scope="module")
def found(spark):
    rows = [(n, n.split(".")[-1], b) for n, (b, _) in fixtures().items()]
    return {r["id"]: r for r in extract(spark.createDataFrame(rows, "id string, extension string, content binary")).collect()}


@pytest.mark.parametrize("name", list(fixtures()))
def test_metadata(found, name):
    want = fixtures()[name][1]
    got = json.loads(found[name]["deepMeta"] or "{}")
    if want is None:
        assert not got
    else:
        assert {k: got.get(k) for k in want} == {k: pytest.approx(v) if isinstance(v, float) else v for k, v in want.items()}


def test_excerpts_and_canonical_fields(found):
    assert found["a.docx"]["excerpt"] == "One<\n\nTwo\tx" and found["a.rtf"]["excerpt"] == "One\nTwo\néé\tz" and found["a.txt"]["excerpt"].startswith("one two")
    assert (found["a.docx"]["author"], found["a.docx"]["extent"], found["a.pdf"]["createdDate"], found["a.doc"]["extent"]) == ("Ann", "0", "2023-01-01T00:00:00.000Z", "7")
    assert found["a.mp4"]["extent"] == "1:05" and found["a.png"]["author"] is None


def test_unzip(spark):
    good = package({"x/a.txt": "hello", "__MACOSX/a": "1", "x/._b": "2", "x/": "", "Thumbs.db": "3", "b.json": "{}"})
    cut = bytearray(package({"c.txt": "".join(map(str, range(5000)))}))
    at = 30 + 5 + 4000
    cut[at : at + 200] = bytes(200)
    rows = [(1, "in/pack.v1.zip", good), (2, "cut.zip", bytes(cut)), (3, "no.zip", b"PK\3\4 nothing"), (4, "d.docx", good), (5, "empty.zip", None)]
    got = {(r["id"], r["path"]): r for r in unzip(spark.createDataFrame(rows, "id long, path string, content binary")).collect()}
    assert set(got) == {(1, "in/pack.v1/x/a.txt"), (1, "in/pack.v1/b.json"), (2, "cut/c.txt")}
    assert bytes(got[1, "in/pack.v1/x/a.txt"]["content"]) == b"hello" and got[1, "in/pack.v1/b.json"]["type"] == "application/json"
    assert bytes(got[2, "cut/c.txt"]["content"])[:100] == "".join(map(str, range(5000))).encode()[:100]
    assert got[1, "in/pack.v1/b.json"]["modificationTime"].year >= 1980


def test_large_parts_are_read_whole():
    # an OLE2 file whose summary lies beyond the FAT sectors that the header names
    small, free, end, far = ole2_file(), 0xFFFFFFFF, 0xFFFFFFFE, 13_960
    sectors = [small[512 * (i + 1) : 512 * (i + 2)] for i in range(len(small) // 512 - 1)]
    fat = [free] * (110 * 128)
    fat[111] = fat[112] = end
    mini = [b"\0" * 512, *sectors[3:]]  # the summary starts in its second sector
    minifat = struct.pack("<128I", *[free] * 8, *(x + 8 if x < 128 else x for x in struct.unpack("<120I", sectors[2][:480])))
    fat[far : far + len(mini)] = [*range(far + 1, far + len(mini)), end]
    body = bytearray(512 * (far + len(mini)))
    body[: 110 * 512] = struct.pack(f"<{110 * 128}I", *fat)
    body[110 * 512 : 111 * 512] = struct.pack("<128I", 109, *[free] * 126, end)
    tree = bytearray(sectors[1])
    tree[116:120], tree[244:248] = struct.pack("<I", far), struct.pack("<I", 8)
    body[111 * 512 : 113 * 512] = bytes(tree) + minifat
    body[far * 512 :] = b"".join(mini)
    head = bytearray(small[:512])
    head[48:52], head[60:64] = struct.pack("<I", 111), struct.pack("<I", 112)
    head[68:76], head[76:512] = struct.pack("<II", 110, 1), struct.pack("<109I", *range(109))
    assert list(chunks.ole2(bytes(head + body))) == list(chunks.ole2(small)) != []

    # an EXIF text of 3,000 bytes
    text = b"d" * 2999 + b"\0"
    image = b"II*\0" + struct.pack("<IHHHIII", 8, 1, 0x010E, 2, len(text), 26, 0) + text
    assert dict(chunks.exif(image))["tag:010e"][6:] == text

    # Vorbis comments over several pages, with a picture of 150,000 bytes before the title
    comment = lambda x: struct.pack("<I", len(x)) + x
    packet = b"\x03vorbis" + comment(b"lib") + struct.pack("<I", 2) + comment(b"PICTURE=" + b"p" * 150_000) + comment(b"TITLE=Last")
    page = lambda data: b"OggS" + b"\0" * 22 + bytes([-(-len(data) // 255)]) + b"\xff" * (len(data) // 255) + bytes([len(data) % 255] * (len(data) % 255 > 0)) + data
    pages = page(b"\x01vorbis" + b"\0" * 30) + b"".join(page(packet[i : i + 65_025]) for i in range(0, len(packet), 65_025))
    got = dict(chunks.ogg(pages))
    assert got["vorbis:title"] == b"Last" and got["vorbis:picture"] == b"p" * 150_000
