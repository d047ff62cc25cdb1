"""ZIP archives: members as rows, and single members of office files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import is_os_artifact, member_mime
from ..functions.scalars import dos_date

OFFICE = ("docx", "xlsx", "pptx", "odt", "ods", "odp", "jar", "apk", "ipa")
TAIL = 65_557  # bytes that can hold the end record and a comment


def inflated(data: bytes, method: int) -> bytes | None:
    """A member's bytes; of a damaged stream what could be read; null for nothing or other methods."""
    if method == 0:
        return data
    if method != 8:
        return None
    for bits in (-15, 15):
        engine, out = zlib.decompressobj(bits), b""
        try:
            for i in range(0, len(data), 4096):
                out += engine.decompress(data[i : i + 4096])
        except zlib.error:
            pass
        if out:
            return out
    return None


def members(content: bytes) -> Iterator[tuple[str, bytes | None, int, int]]:
    """name, bytes, DOS date and time of each entry of the central directory."""
    end = content.rfind(b"PK\5\6", max(0, len(content) - TAIL))
    if content[:4] != b"PK\3\4" or end < 0:
        return
    count, _, at = struct.unpack_from("<HII", content, end + 10) if end + 20 <= len(content) else (0, 0, 0)
    for _ in range(count):
        if content[at : at + 4] != b"PK\1\2" or at + 46 > len(content):
            return
        method, time, date, _, packed, _, n, extra, comment = struct.unpack_from("<HHHIIIHHH", content, at + 10)
        local = struct.unpack_from("<I", content, at + 42)[0]
        name = content[at + 46 : at + 46 + n].decode("utf-8", "replace")
        at += 46 + n + extra + comment
        if content[local : local + 4] == b"PK\3\4" and local + 30 <= len(content):
            first = local + 30 + sum(struct.unpack_from("<HH", content, local + 26))
            yield name, inflated(content[first : first + packed], method), date, time


def unzip(archives: DataFrame, key: str = "id") -> DataFrame:
    """``archives`` (key, path, content): key, path, name, type, modificationTime, length, content of members.

    A member's path is the archive's without its last extension, then its own. Folders, system
    files and members that can't be read are left out; office files aren't unpacked.
    """
    schema = f"{key} {archives.schema[key].dataType.simpleString()}, base string, member string, content binary, d int, t int"

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([(key, batch_type), ("base", pa.string()), ("member", pa.string()), ("content", pa.binary()), ("d", pa.int32()), ("t", pa.int32())])
        for batch in batches:
            for k, path, content in zip(*(batch.column(c).to_pylist() for c in (key, "path", "content")), strict=True):
                found = list(members(content or b""))
                rows = {key: [k] * len(found), "base": [path] * len(found)}
                rows |= {n: [m[i] for m in found] for i, n in enumerate(("member", "content", "d", "t"))}
                yield pa.RecordBatch.from_pydict(rows, schema=kinds)

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(archives.schema[key].dataType)
    plain = archives.where(~F.lower(F.substring_index("path", ".", -1)).isin(*OFFICE)).select(key, "path", "content")
    found = plain.mapInArrow(expand, schema).where("content is not null and right(member, 1) <> '/'").where(~is_os_artifact(F.col("member")))
    return found.select(
        key, F.concat_ws("/", F.regexp_replace("base", r"\.[^./]*$", ""), "member").alias("path"), F.substring_index("member", "/", -1).alias("name"),
        member_mime(F.col("member")).alias("type"), dos_date(F.col("d"), F.col("t")).alias("modificationTime"), F.octet_length("content").cast("long").alias("length"), "content",
    )


def zip_member(rows: DataFrame, names: dict[str, str], key: str = "id") -> DataFrame:
    """key, and the text of each named member of ``content`` (whatever its case) in the named column."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {n: [] for n in names}
            for content in batch.column("content").to_pylist():
                found = {m.lower(): data for m, data, _, _ in members(content or b"")}
                for n, member in names.items():
                    data = found.get(member.lower())
                    out[n].append(None if data is None else data.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(x, pa.string()) for x in out.values())], names=[key, *names])

    kinds = ", ".join(f"{n} string" for n in names)
    return rows.select(key, "content").mapInArrow(read, f"{key} {rows.schema[key].dataType.simpleString()}, {kinds}")
