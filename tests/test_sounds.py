"""Genres, bit rates and formats of sounds; applications, XMP and sizes of other containers; exports as an array; children of archives."""

import json
import struct

from pyspark.sql import functions as F

from quarry.functions.tags import GENRES
from quarry.operators import merge, sinks
from quarry.plans.extract import extract
from quarry.plans.metadata import entries, gathered
from quarry.sources.archives import unzip
from quarry.sources.chunks import WALKERS, parts, register_walker
from quarry.sources.files import capture

from .test_formats import package
from .test_office import ole2_with

SCHEMA = "id string, extension string, content binary"


def mp3(genre, last=b""):
    text = b"\0" + genre
    frame = b"TCON" + struct.pack(">IH", len(text), 0) + text
    return b"ID3\3\0\0" + bytes([0, 0, len(frame) >> 7, len(frame) & 127]) + frame + b"\xff\xfb\x90\x44" + bytes(60) + last


def box(kind, *data):
    data = b"".join(data)
    return struct.pack(">I4s", len(data) + 8, kind) + data


def test_containers(spark):
    v1 = b"TAG" + b"Name".ljust(30, b"\0") + bytes(60) + b"1999" + bytes(30) + b"\x08"
    comm = struct.pack(">hIh", 2, 44100, 16) + bytes.fromhex("400EAC44000000000000")
    aiff = b"AIFF" + b"COMM" + struct.pack(">I", len(comm)) + comm
    page = b"\x01vorbis" + struct.pack("<IBIiii", 0, 2, 48000, 0, 128_000, 0) + b"\xb8\1"
    ogg = b"OggS\0\2" + bytes(8) + b"abcd" + bytes(8) + b"\1" + bytes([len(page)]) + page
    heic = box(b"ftyp", b"heic" + bytes(4)) + box(b"meta", bytes(4), box(b"iprp", box(b"ipco", box(b"ispe", bytes(4) + struct.pack(">II", 640, 480)))))
    xmp = b'<x:xmpmeta><dc:format>image/x</dc:format><xmp:CreatorTool>Tool</xmp:CreatorTool></x:xmpmeta>'
    block = b"8BIM" + struct.pack(">HHI", 0x0424, 0, len(xmp)) + xmp + b"\0" * (len(xmp) % 2)
    psd = b"8BPS\0\1" + bytes(6) + struct.pack(">HIIHH", 3, 5, 7, 8, 3) + bytes(4) + struct.pack(">I", len(block)) + block
    indd = b"\x06\x06\xed\xf5" + bytes(40) + b"<x:xmpmeta><dc:title><rdf:Alt><rdf:li>Layout</rdf:li></rdf:Alt></dc:title></x:xmpmeta>"
    word = ole2_with({"WordDocument": b"Microsoft Office Word" + bytes(100), "A": b"x", "B": b"x"})
    files = {
        "one.mp3": mp3(b"(17)Foo"), "two.mp3": mp3(b"(8)"), "odd.mp3": mp3(b"(999)"), "last.mp3": mp3(b"Mine", v1), "a.aiff": b"FORM" + struct.pack(">I", len(aiff)) + aiff, "a.oga": ogg,
        "a.heic": heic, "a.psd": psd, "a.indd": indd, "a.doc": word,
    }
    rows = spark.createDataFrame([(k, k.split(".")[1], v) for k, v in files.items()], SCHEMA)
    found = {r["id"]: json.loads(r["deepMeta"]) for r in extract(rows).collect()}
    pick = lambda name, *keys: [found[name].get(k) for k in keys]
    assert len(GENRES) == 192 and [found[f"{n}.mp3"]["genre"] for n in ("one", "two", "odd", "last")] == ["Foo (Rock)", "Jazz", "999", "Jazz"]
    assert pick("last.mp3", "title", "year", "format") == ["Name", "1999", "MP3"] and found["one.mp3"]["bitrate"] == "128 kbps"
    assert pick("a.aiff", "durationSeconds", "bitrate", "format") == [1.0, f"{int(len(files['a.aiff']) * 8 / 1000 + 0.5)} kbps", "AIFF"]
    assert pick("a.oga", "channels", "sampleRate", "bitrate", "format") == [2, 48000, "128 kbps", "OGA"]
    assert pick("a.heic", "Width", "Height", "AspectRatio") == [640, 480, "4:3"]
    assert pick("a.psd", "Format", "CreatorTool", "Channels", "Width", "Height") == ["image/x", "Tool", 3, 7, 5]
    assert pick("a.indd", "Format", "Title") == ["InDesign", "Layout"] and found["a.doc"]["application"] == "Microsoft Office Word"


def test_macintosh_text_and_loose_encodings(spark):
    from quarry.functions.markup import mac_word_text
    from quarry.functions.textstats import text_stats

    head = b"\xfe7\0\x1c" + bytes(252)
    whole, cut = head + b"One\r\r\r\rtwo \xd2q\xd3\t\x01\xe9", head + b"Text that stays" + b"x" * 20 + bytes(25) + b"lost"
    cases = [("mac", whole), ("cut", cut), ("no", b"\xd0\xcf"), ("empty", b""), ("null", None)]
    df = spark.createDataFrame(cases, "id string, content binary")
    assert {r["id"]: r["t"] for r in df.select("id", mac_word_text(F.col("content")).alias("t")).collect()} == {"mac": "One\n\ntwo “q”\té", "cut": "Text that stays", "no": None, "empty": None, "null": None}
    texts = {"plain": b"a", "utf": "é".encode(), "latin": b"\xe9t", "long": b"\xe0\x80\x80", "half": b"\xff\xfea\0b", "wide": b"\xff\xfea\0", "bad": b"\xef\xbb\xbf\xff"}
    df = spark.createDataFrame(list(texts.items()), "id string, content binary").select("id", text_stats(F.col("content"))["encoding"].alias("e"))
    other = "ISO-8859-1 (fallback)"
    assert {r["id"]: r["e"] for r in df.collect()} == {"plain": "utf-8", "utf": "utf-8", "latin": "latin1", "long": other, "half": other, "wide": "utf-16le", "bad": other}


def test_json_array(spark, tmp_path):
    rows = spark.createDataFrame([(2, 'x"y', None), (1, "é\n", "z")], "n int, name string, note string").repartition(2)
    assert sinks.write_json_array(rows, f"{tmp_path}/json", [F.col("n")]) == 2
    text = "".join(p.read_text() for p in sorted((tmp_path / "json").glob("part-*")))
    want = [{"n": "1", "name": "é\n", "note": "z"}, {"n": "2", "name": 'x"y', "note": ""}]
    assert text == json.dumps(want, indent=2, ensure_ascii=False) + "\n"
    assert sinks.write_json_array(rows.limit(0), f"{tmp_path}/none", [F.col("n")]) == 0 and not (tmp_path / "none").exists()


def test_children_of_an_archive_enter_the_catalogue(spark):
    content = package({"a/one.txt": "words here", "__MACOSX/x": "no", "two.csv": "a,b"})
    made = spark.createDataFrame([("box/old.zip", 0, len(content), content)], "path string, t long, length long, content binary")
    archives = made.select("path", F.timestamp_seconds("t").alias("modificationTime"), "length", "content")
    parent = capture(archives, keep=["content"])
    children = capture(unzip(parent.select("id", "path", "content")).select("path", "modificationTime", "length", "content"))
    rows = {r["path"]: r for r in merge.merge_records(parent.drop("content"), children, "path").collect()}
    assert set(rows) == {"box/old.zip", "box/old/a/one.txt", "box/old/two.csv"} and rows["box/old/two.csv"]["category"] and rows["box/old/a/one.txt"]["size"] == 10
    again = merge.merge_records(parent.drop("content").unionByName(children), children, "path")
    assert again.count() == 3


def test_own_walker(spark):
    register_walker("xyz", lambda b: iter([("IART", struct.pack(">I", 3) + b[:3])]))
    try:
        files = spark.createDataFrame([("w", "xyz", b"Ann and more")], SCHEMA)
        found = gathered(entries(parts(files), "id", ["xyz"])).first()["deepMeta"]
    finally:
        del WALKERS["xyz"]
    assert json.loads(found) == {"artist": "Ann"}
