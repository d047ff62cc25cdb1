"""Workbooks of older and open formats as rows: BIFF records, OpenDocument cells with their repeats, CSV fields."""

from __future__ import annotations

import csv
import io
import re
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .archives import members
from .chunks import ole2_streams
from .office import walked

# Numbers of BIFF records that are read.
CONTINUE, SST, LABELSST, LABEL, RSTRING, NUMBER, RK, MULRK, BOOLERR, FORMULA, STRING, BOUNDSHEET, DIMENSIONS, MERGES, NAME = 0x3C, 0xFC, 0xFD, 0x204, 0xD6, 0x203, 0x27E, 0xBD, 0x205, 0x06, 0x207, 0x85, 0x200, 0xE5, 0x18
BOF = 0x809
RECORD = "sheet int, kind int, row int, col int, formula boolean, data binary"
Record = tuple[int, int, int | None, int | None, bool, bytes]


class _Pieces:
    """A record and its continuations, read as one; a string that is cut starts again with a byte that tells its width."""

    def __init__(self, pieces: list[bytes]):
        self.pieces, self.piece, self.at = pieces, 0, 0

    def _next(self) -> bool:
        self.piece, self.at = self.piece + 1, 0
        return self.piece < len(self.pieces)

    def take(self, n: int) -> bytes:
        out = b""
        while n > 0 and self.piece < len(self.pieces):
            got = self.pieces[self.piece][self.at : self.at + n]
            out, self.at, n = out + got, self.at + len(got), n - len(got)
            if n and not self._next():
                break
        return out

    def text(self, count: int, wide: bool) -> str:
        out = []
        while count > 0 and self.piece < len(self.pieces):
            left = len(self.pieces[self.piece]) - self.at
            n = min(count, left // 2 if wide else left)
            out.append(self.take(n * (2 if wide else 1)).decode("utf-16le" if wide else "latin-1", "replace"))
            count -= n
            if count:
                if not self._next() or not self.pieces[self.piece]:
                    break
                wide, self.at = bool(self.pieces[self.piece][0] & 1), 1
        return "".join(out)

    def string(self) -> str:
        """A string with its length, flags, and what formatting stands after it."""
        count, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        text = self.text(count, bool(flags & 1))
        self.take(4 * runs + extra)
        return text


_ZEROS = re.compile(rb"\0*")


def _records(stream: bytes) -> Iterator[tuple[int, int, list[bytes]]]:
    """Place, number and pieces (the record's own, then its continuations') of each record; the zeros that fill a stream's sectors are none."""
    at = 0
    while at + 4 <= len(stream):
        start, (kind, n) = at, struct.unpack_from("<HH", stream, at)
        if not kind and not n:
            at += (_ZEROS.match(stream, at).end() - at) // 4 * 4
            continue
        pieces, at = [stream[at + 4 : at + 4 + n]], at + 4 + n
        while at + 4 <= len(stream) and struct.unpack_from("<H", stream, at)[0] == CONTINUE:
            n = struct.unpack_from("<H", stream, at + 2)[0]
            pieces.append(stream[at + 4 : at + 4 + n])
            at += 4 + n
        yield start, kind, pieces


def biff_records(content: bytes) -> Iterator[Record]:
    """sheet (from 1; 0: the workbook's own), record number, row, column, whether a formula, value bytes.

    Shared strings and labels come as UTF-8, one row each (``row``: the shared string's number); a
    sheet's name comes as a BOUNDSHEET row (``col``: how it is hidden), its used range and merged
    regions as rows of their own. Numbers keep their eight or four bytes.
    """
    stream = ole2_streams(content)
    book = (stream("Workbook") or stream("Book")) if stream else b""
    starts: dict[int, int] = {}
    sheet, pending = 0, None
    for place, kind, pieces in _records(book):
        d = pieces[0]
        if kind == BOF:
            sheet = starts.get(place, sheet if place == 0 else 0)
            continue
        if kind == BOUNDSHEET:
            at, hidden, _, count, flags = struct.unpack_from("<IBBBB", d)
            starts[at] = len(starts) + 1
            name = d[8 : 8 + count * (2 if flags & 1 else 1)].decode("utf-16le" if flags & 1 else "latin-1", "replace")
            yield starts[at], kind, None, hidden & 3, False, name.encode("utf-8", "replace")
        elif kind == SST:
            text = _Pieces(pieces)
            for i in range(struct.unpack("<II", text.take(8))[1]):
                if text.piece >= len(pieces):
                    break
                yield 0, kind, i, None, False, text.string().encode("utf-8", "replace")
        elif kind == NAME:
            flags, _, count = struct.unpack_from("<HBB", d)
            wide = len(d) > 14 and d[14] & 1
            name = d[15 : 15 + count * (2 if wide else 1)].decode("utf-16le" if wide else "latin-1", "replace")
            yield 0, kind, None, flags & 0x20, False, name.encode("utf-8", "replace")
        elif not sheet:
            continue
        elif kind == DIMENSIONS and len(d) >= 12:
            yield sheet, kind, None, None, False, d[:12]
        elif kind == MERGES and len(d) >= 2:
            yield sheet, kind, struct.unpack_from("<H", d)[0], None, False, b""
        elif kind == MULRK:
            row, first = struct.unpack_from("<HH", d)
            for i in range((len(d) - 6) // 6):
                yield sheet, RK, row, first + i, False, d[6 + 6 * i : 10 + 6 * i]
        elif kind in (LABELSST, NUMBER, RK, BOOLERR):
            row, col = struct.unpack_from("<HH", d)
            yield sheet, kind, row, col, False, d[6:14]
        elif kind in (LABEL, RSTRING):
            row, col, _, count, flags = struct.unpack_from("<HHHHB", d)
            text = _Pieces([d[9:], *pieces[1:]]).text(count, bool(flags & 1))
            yield sheet, LABEL, row, col, False, text.encode("utf-8", "replace")
        elif kind == FORMULA:
            row, col = struct.unpack_from("<HH", d)
            value = d[6:14]
            if value[6:8] == b"\xff\xff" and value[0] == 0:
                pending = (row, col)  # its text follows
            elif value[6:8] == b"\xff\xff" and value[0] in (1, 2):
                yield sheet, BOOLERR, row, col, True, bytes([value[2], value[0] - 1])
            elif value[6:8] == b"\xff\xff":
                yield sheet, LABEL, row, col, True, b""
            else:
                yield sheet, NUMBER, row, col, True, value
        elif kind == STRING and pending:
            count, flags = struct.unpack_from("<HB", d)
            text = _Pieces([d[3:], *pieces[1:]]).text(count, bool(flags & 1))
            yield sheet, LABEL, *pending, True, text.encode("utf-8", "replace")
            pending = None


_TABLE = re.compile(r"(?s)<table:table\s([^>]*?)(?:/>|>(.*?)</table:table>)")
_ROW = re.compile(r"(?s)<table:table-row\b([^>]*?)(?:/>|>(.*?)</table:table-row>)")
_CELL = re.compile(r"(?s)<table:(covered-)?table-cell\b([^>]*?)(?:/>|>(.*?)</table:(?:covered-)?table-cell>)")
#: Cell types by what they are counted under.
_KINDS = {"float": "number", "currency": "number", "percentage": "number", "date": "date", "time": "date", "boolean": "boolean", "string": "string"}
SPANNED = "sheet int, name string, state string, merges int, row long, col long, rows int, cols int, kind string, formula boolean, text string"


def _attribute(tag: str, name: str, otherwise: str = "") -> str:
    found = re.search(rf'\b{name}="([^"]*)"', tag)
    return _plain(found[1]) if found else otherwise


def _plain(xml: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        xml = xml.replace(a, b)
    return xml


def _paragraphs(xml: str) -> str:
    xml = re.sub(r"(?s)<office:annotation\b.*?</office:annotation>", "", xml)
    lines = re.findall(r"(?s)<text:p\b[^>]*?(?:/>|>(.*?)</text:p>)", xml)
    spaced = [re.sub(r'<text:s(?:\s+text:c="(\d+)")?\s*/>', lambda m: " " * int(m[1] or 1), x).replace("<text:tab/>", "\t") for x in lines]
    return _plain("\n".join(re.sub(r"<[^>]+>", "", x) for x in spaced))


def opendocument_cells(content: bytes) -> Iterator[tuple]:
    """sheet, name, state, merges, then row, column, rows and columns covered, kind, formula, text of each run of equal filled cells.

    Rows and columns count from 1. Empty cells are only counted over, however often they repeat. A sheet
    without cells gives one row without a cell.
    """
    xml = next((d or b"" for n, d, _, _ in members(content) if n == "content.xml"), b"").decode("utf-8", "replace")
    hidden = {m[1] for m in re.finditer(r'(?s)<style:style\s[^>]*style:name="([^"]*)"[^>]*style:family="table"[^>]*>(?:(?!</style:style>).)*?table:display="false"', xml)}
    for number, table in enumerate(_TABLE.finditer(xml), 1):
        name, merges, found, at = _attribute(table[1], "table:name"), 0, 0, 1
        state = "hidden" if _attribute(table[1], "table:style-name") in hidden else ""
        body = table[2] or ""
        merges = len(re.findall(r'table:number-(?:columns|rows)-spanned="(?!1")', body)) and len(re.findall(r'<table:table-cell\b(?=[^>]*table:number-(?:columns|rows)-spanned="(?!1"))', body))
        for row in _ROW.finditer(body):
            rows, col = int(_attribute(row[1], "table:number-rows-repeated", "1")), 1
            for cell in _CELL.finditer(row[2] or ""):
                cols, kind, formula = int(_attribute(cell[2], "table:number-columns-repeated", "1")), _attribute(cell[2], "office:value-type"), "table:formula=" in cell[2]
                text = _paragraphs(cell[3] or "")
                if kind or formula or text:
                    value = _attribute(cell[2], "office:value") or _attribute(cell[2], "office:boolean-value") or _attribute(cell[2], "office:date-value") or _attribute(cell[2], "office:string-value")
                    found += 1
                    yield number, name, state, merges, at, col, rows, cols, _KINDS.get(kind, "string"), formula, text or value
                col += cols
            at += rows
        if not found:
            yield number, name, state, merges, None, None, None, None, None, False, None


def csv_cells(content: bytes) -> Iterator[tuple]:
    """The same of a CSV file, as one sheet: the separator is that which its first line has most of."""
    text = content.decode("utf-16" if content[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8-sig", "replace")
    first = text.partition("\n")[0]
    by = max(",;\t|", key=lambda c: (first.count(c), -",;\t|".index(c)))
    found = 0
    csv.field_size_limit(1 << 30)
    for at, fields in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=by), 1):
        for col, field in enumerate(fields, 1):
            if field:
                found += 1
                number = re.fullmatch(r"\s*[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?\s*", field)
                kind = "number" if number else "boolean" if field.upper() in ("TRUE", "FALSE") else "string"
                yield 1, "Sheet1", "", 0, at, col, 1, 1, kind, False, field
    if not found and text:
        yield 1, "Sheet1", "", 0, None, None, None, None, None, False, None


def records(files: DataFrame, key: str = "id") -> DataFrame:
    """key and RECORD of every record that is read of the BIFF workbooks among ``files``."""
    return walked(files, key, RECORD, biff_records)


def spanned(files: DataFrame, key: str = "id") -> DataFrame:
    """key and SPANNED of the cells of OpenDocument sheets."""
    return walked(files, key, SPANNED, opendocument_cells)


def fields(files: DataFrame, key: str = "id") -> DataFrame:
    """key and SPANNED of the fields of CSV files."""
    return walked(files, key, SPANNED, csv_cells)
