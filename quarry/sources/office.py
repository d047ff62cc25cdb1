"""Bytes of workbooks, Word documents and damaged PDF files as rows: cells, text pieces.

A damaged file gives what could be read before the damage, or nothing.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .archives import members
from .chunks import ole2_streams

Cell = tuple[int, str, str, int, int, int | None, int | None, str | None, bool, str | None]
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))
#: Cell types of a workbook's XML by the names they are counted under; a cell without one holds a number.
KINDS = {"b": "boolean", "n": "number", "s": "string", "str": "string", "inlineStr": "string", "d": "date", "e": "error"}


def _plain(xml: str) -> str:
    for a, b in _ENTITIES:
        xml = xml.replace(a, b)
    return xml


def _texts(xml: str) -> str:
    return _plain("".join(re.findall(r"<t(?:\s[^>]*)?>([^<]*)</t>", xml)))


def _attribute(tag: str, name: str) -> str:
    found = re.search(rf'\b{name}="([^"]*)"', tag)
    return _plain(found[1]) if found else ""


def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n


def workbook_cells(content: bytes) -> Iterator[Cell]:
    """sheet, name, state, merges, rows and columns of the sheet, then row, column, kind, formula, text of each cell.

    A sheet without cells gives one row without a cell.
    """
    files = {n.lower(): (d or b"").decode("utf-8", "replace") for n, d, _, _ in members(content)}
    shared = [_texts(x) for x in re.findall(r"(?s)<si>(.*?)</si>", files.get("xl/sharedstrings.xml", ""))]
    targets = {_attribute(t, "Id"): _attribute(t, "Target") for t in re.findall(r"<Relationship\b[^>]*>", files.get("xl/_rels/workbook.xml.rels", ""))}
    for number, tag in enumerate(re.findall(r"<sheet\b[^>]*>", files.get("xl/workbook.xml", "")), 1):
        name, state = _attribute(tag, "name"), _attribute(tag, "state")
        target = targets.get(_attribute(tag, "r:id"), f"worksheets/sheet{number}.xml").lstrip("/")
        xml = files.get((target if target.startswith("xl/") else "xl/" + target).lower(), "")
        merges, found = xml.count("<mergeCell "), []
        for head, body in re.findall(r"(?s)<c\b([^>]*?)(?:/>|>(.*?)</c>)", xml):
            place = re.match(r"([A-Z]+)(\d+)$", _attribute(head, "r"))
            value, formula = re.search(r"<v>([^<]*)</v>", body), "<f" in body
            kind = _attribute(head, "t") or "n"
            if place and (value or formula or kind == "inlineStr"):
                text = _plain(value[1]) if value else _texts(body)
                if kind == "s" and text.isdigit() and int(text) < len(shared):
                    text = shared[int(text)]
                found.append((int(place[2]), _column(place[1]), KINDS.get(kind, "other"), formula, text))
        used = re.search(r'<dimension ref="([A-Z]+)(\d+)(?::([A-Z]+)(\d+))?"', xml)
        high = wide = 0
        if used and found:
            high = int(used[4] or used[2]) - int(used[2]) + 1
            wide = _column(used[3] or used[1]) - _column(used[1]) + 1
        elif found:
            high = max(x[0] for x in found) - min(x[0] for x in found) + 1
            wide = max(x[1] for x in found) - min(x[1] for x in found) + 1
        for cell in found or [(None, None, None, False, None)]:
            yield number, name, state, merges, high, wide, *cell


CELL = "sheet int, name string, state string, merges int, high int, wide int, row int, col int, kind string, formula boolean, text string"


def cells(files: DataFrame, key: str = "id") -> DataFrame:
    """``files`` (key, content): key and CELL of every cell of the workbooks among them."""
    return walked(files, key, CELL, workbook_cells)


def _text_runs(data: bytes) -> str:
    """Readable runs of eight characters or more, where at least half of the bytes are readable."""
    readable = sum(32 <= c < 127 or c in (9, 10, 13) for c in data)
    return "\n".join(x.decode("latin-1") for x in re.findall(rb"[\x20-\x7e\t\r\n]{8,}", data)) if 2 * readable >= len(data) else ""


#: What a Word document's control characters stand for; others go.
_MARKS = {7: "\t", 9: "\t", 10: "\n", 11: "\n", 12: "\n", 13: "\n", 30: "-", 160: " "}


def _word_text(text: str) -> str:
    text = "".join(_MARKS.get(ord(c), c if ord(c) >= 32 else "") for c in text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"(?m)[ \t]+$", "", text)).strip()


def word_text(content: bytes) -> Iterator[tuple[str]]:
    """The main text of a Word 97 document by its piece table, else its readable runs."""
    stream = ole2_streams(content)
    document = stream("WordDocument") if stream else b""
    if len(document) < 68:
        return
    flags = struct.unpack_from("<H", document, 10)[0]
    table = stream("1Table" if flags & 0x200 else "0Table")
    out = []
    if len(document) >= 0x1AA and table:
        at, size = struct.unpack_from("<II", document, 0x1A2)
        clx = table[at : at + size]
        at = 0
        while at + 3 <= len(clx) and clx[at] == 1:  # formatting before the pieces
            at += 3 + struct.unpack_from("<H", clx, at + 1)[0]
        if at + 5 <= len(clx) and clx[at] == 2:
            n = (struct.unpack_from("<I", clx, at + 1)[0] - 4) // 12
            ends = struct.unpack_from(f"<{n + 1}I", clx, at + 5)
            for k in range(n):
                place = struct.unpack_from("<I", clx, at + 5 + 4 * (n + 1) + 8 * k + 2)[0]
                count = ends[k + 1] - ends[k]
                if place & 1 << 30:
                    place = (place & (1 << 30) - 1) // 2
                    out.append(document[place : place + count].decode("cp1252", "replace"))
                else:
                    out.append(document[place : place + 2 * count].decode("utf-16le", "replace"))
    text = _word_text("".join(out))
    if len(text) <= 10:
        text = _word_text(_text_runs(document))
    if text:
        yield (text,)


def pdf_streams(content: bytes) -> Iterator[tuple[str, str]]:
    """objects: dictionaries held in compressed object streams; text: strings that the pages show. For files without a usable object graph."""
    objects, shown = [], []
    for m in re.finditer(rb"(?s)<<((?:[^<>]|<<.*?>>|<[^<>]*>)*)>>\s*stream\r?\n", content):
        end = content.find(b"endstream", m.end())
        if b"FlateDecode" not in m[1]:
            data = content[m.end() : end]
        else:
            engine, data = zlib.decompressobj(), b""
            packed = content[m.end() : end if end > 0 else len(content)]
            try:
                for i in range(0, len(packed), 4096):
                    data += engine.decompress(packed[i : i + 4096])
            except zlib.error:  # what came before the damage stays
                pass
        if re.search(rb"/Type\s*/ObjStm", m[1]):
            objects.append(data.decode("latin-1"))
        elif b"BT" in data and b"ET" in data:
            shown.append(_shown(data.decode("latin-1")))
    if content[:4] == b"%PDF" and (objects or shown):
        yield "\n".join(objects), "\n\n".join(x for x in shown if x)


_OPERATION = re.compile(r"(?s)\[((?:\((?:\\.|[^\\)])*\)|[^\]()])*)\]\s*TJ|\(((?:\\.|[^\\)])*)\)\s*(Tj|'|\")|(-?[\d.]+)\s+(-?[\d.]+)\s+T[dD]\b|(T\*)|-?[\d.]+\s+-?[\d.]+\s+-?[\d.]+\s+-?[\d.]+\s+-?[\d.]+\s+(-?[\d.]+)\s+Tm\b|\bT[fF]\b")


def _literal(text: str) -> str:
    named = {"n": "\n", "r": "\r", "t": "\t", "b": "", "f": ""}
    return re.sub(r"(?s)\\([0-7]{1,3}|.)", lambda m: chr(int(m[1], 8) & 255) if m[1][0] in "01234567" else named.get(m[1], m[1]), text)


def _shown(data: str) -> str:
    """The strings of a page in order; a line feed wherever the text position moves down or up."""
    out, last = [], None
    for m in _OPERATION.finditer(data):
        array, string, how, _, down, star, place = m.groups()
        if star or how in ("'", '"') or down and abs(float(down)) > 2 or place and last is not None and abs(float(place) - last) > 2:
            out.append("\n")
        last = float(place) if place else last
        for text in re.findall(r"(?s)\(((?:\\.|[^\\)])*)\)", m[0]) if array is not None else [string] if string is not None else []:
            out.append(_literal(text))
    return re.sub(r"\n{3,}", "\n\n", "".join(out)).strip()


def word_bodies(files: DataFrame, key: str = "id") -> DataFrame:
    """key and text of the Word 97 documents that have some."""
    return walked(files, key, "text string", word_text)


ROWS = 2_000  # of a batch that a walker yields, about


def walked(files: DataFrame, key: str, fields: str, walker: Callable[[bytes], Iterator[tuple]]) -> DataFrame:
    """key and ``fields`` of the rows that ``walker`` yields for each content, handed on as they come; a damaged content's rows up to the damage."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    names = StructType([files.schema[key], *StructType.fromDDL(fields).fields])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, rows, size = to_arrow_schema(names), [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

        for batch in batches:
            for k, content in zip(*(batch.column(c).to_pylist() for c in range(2)), strict=True):
                try:
                    for found in walker(content or b""):
                        rows.append((k, *found))
                        size += sum(len(x) for x in found if isinstance(x, (str, bytes)))
                        if len(rows) >= ROWS or size > 4_000_000:
                            yield out()
                            rows, size = [], 0
                except (struct.error, IndexError, ValueError):  # damaged
                    pass
        if rows:
            yield out()

    return files.select(key, "content").mapInArrow(walk, names)
