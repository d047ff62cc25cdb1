"""Token ids in sorted-string-table shards.

A table file holds documents in ascending doc_id order: blocks of prefix-compressed entries, a
sparse index with each block's first key, a Bloom filter over keys, and a fixed footer. A lookup
asks the filter, searches the index by bisection and reads one block (more where a key repeats).

File layout, integers little-endian::

    block*   zstd of entries: varint shared, varint unshared, varint value bytes, key rest, value
    index    zstd of entries: key (8), offset u64, length u32, first entry u64, ids before u64
    bloom    bits
    footer   "<QQQQQQBI8s": index offset and length, bloom offset and length, entries, ids, id
             width in bytes, CRC-32 of index and bloom, magic

A key is the id with its sign bit turned, in 8 big-endian bytes; a value is the document's ids in
``width`` bytes each. A null text counts as empty (its value is the end id); a null doc_id is stored
as the smallest id and read back as such. Repeated ids all stay, next to each other. An empty table
gives no files and no rows.

Tasks write files under names of their own and report them; only reported files are read, so a
task that is run again leaves no trace in the result. Files go where ``pyarrow.fs`` can write: below
the shared folder.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import batch_rows, utf8_size, work_path, written
from .texts import BATCH_ROWS, slices
from .tokens import encoder

BLOCK_BYTES = 64_000
SHARD_TEXT_BYTES = 24_000_000  # of text in a shard, about
BLOOM_BITS, BLOOM_HASHES = 10, 7  # a key
GROUP = 1_000  # shards whose files are numbered together
MAGIC = b"QSSTABL1"
FOOTER = struct.Struct("<QQQQQQBI8s")
ENTRY = struct.Struct("<8sQIQQ")
LEAST = -(2**63)


def key_of(doc_id: int) -> bytes:
    return (doc_id - LEAST).to_bytes(8, "big")


def id_of(key: bytes) -> int:
    return int.from_bytes(key, "big") + LEAST


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Writes one table file; entries come in ascending key order."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.block, self.size, self.last, self.first = [], 0, b"", b""
        self.index, self.keys = [], []
        self.entries = self.ids = self.block_entries = self.block_ids = 0

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.block:
            while shared < 8 and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first, self.block_entries, self.block_ids = key, self.entries, self.ids
        self.block.append(_varint(shared) + _varint(8 - shared) + _varint(len(value)) + key[shared:] + value)
        self.size += len(self.block[-1])
        self.last = key
        self.keys.append(key)
        self.entries += 1
        self.ids += len(value) // self.width
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _put(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def _flush(self) -> None:
        if self.block:
            offset, length = self._put(zstandard.ZstdCompressor(level=1).compress(b"".join(self.block)))
            self.index.append(ENTRY.pack(self.first, offset, length, self.block_entries, self.block_ids))
            self.block, self.size = [], 0

    def close(self) -> None:
        self._flush()
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = np.zeros(bits, bool)
        for k in self.keys:
            bloom[_bloom_places(k, bits)] = True
        index, bloom = zstandard.ZstdCompressor(level=1).compress(b"".join(self.index)), struct.pack("<Q", bits) + np.packbits(bloom).tobytes()
        i, b = self._put(index), self._put(bloom)
        self._put(FOOTER.pack(*i, *b, self.entries, self.ids, self.width, zlib.crc32(bloom, zlib.crc32(index)), MAGIC))


class Reader:
    """Reads one table file through a seekable ``pyarrow`` input file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        *spans, self.entries, self.ids, self.width, crc, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a table file")
        index, bloom = self._read(*spans[:2]), self._read(*spans[2:])
        if zlib.crc32(bloom, zlib.crc32(index)) != crc:
            raise ValueError("damaged table file")
        index = zstandard.ZstdDecompressor().decompress(index)
        self.index = [ENTRY.unpack_from(index, i) for i in range(0, len(index), ENTRY.size)]
        self.bits, self.bloom = struct.unpack_from("<Q", bloom)[0], bloom[8:]

    def _read(self, at: int, length: int) -> bytes:
        self.source.seek(at)
        return self.source.read(length)

    def block(self, i: int) -> list[tuple[bytes, bytes]]:
        data = zstandard.ZstdDecompressor().decompress(self._read(*self.index[i][1:3]))
        at, last, out = 0, b"", []
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            last = last[:shared] + data[at : at + rest]
            out.append((last, data[at + rest : at + rest + length]))
            at += rest + length
        return out

    def may_have(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _bloom_places(key, self.bits))

    def get(self, doc_id: int) -> list[np.ndarray]:
        """The ids of every document with this id."""
        key = key_of(doc_id)
        if not self.index or not self.may_have(key):
            return []
        firsts = [x[0] for x in self.index]
        found = []
        for i in range(max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key)):
            found += [np.frombuffer(v, f"<u{self.width}") for k, v in self.block(i) if k == key]
        return found

    def __iter__(self) -> Iterator[tuple[int, int, bytes]]:
        """doc_id, ids before it in this file, its ids as little-endian unsigned 32-bit bytes."""
        for i, (_, _, _, _, before) in enumerate(self.index):
            for key, value in self.block(i):
                ids = np.frombuffer(value, f"<u{self.width}").astype("<u4")
                yield id_of(key), before, ids.tobytes()
                before += len(ids)


def write_tables(docs: DataFrame, tokenizer: str, end_id: int, out: str | None = None) -> DataFrame:
    """Write ``docs`` (doc_id, text) as table files below ``out``; returns shard, file, entries, ids, first, base.

    Spark's range partitioning by doc_id, then by place in the input, deals documents to shards, so a
    repeated id that fills shards is spread over them. first: ids in all files before this one.
    """
    spark = docs.sparkSession
    out = out or work_path(spark, "sstables")
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("doc_id"), F.monotonically_increasing_id().alias("k_row"), "text")
    shards = max(1, -(-(docs.agg(F.sum(utf8_size(F.col("text")))).first()[0] or 0) // SHARD_TEXT_BYTES))
    batch_rows(spark, BATCH_ROWS)
    width = 2 if max(encoder(tokenizer).whole.get_vocab_size() - 1, end_id) < 2**16 else 4
    rows = docs.repartitionByRange(shards, "doc_id", "k_row").sortWithinPartitions("doc_id", "k_row").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, shard, table = encoder(tokenizer), TaskContext.get().partitionId(), None
        for batch in batches:
            for part in slices(batch):
                if table is None:
                    fs, base = pafs.FileSystem.from_uri(out)
                    fs.create_dir(base, recursive=True)
                    name = f"{base}/{shard:06d}-{uuid.uuid4().hex}.sst"
                    stream = fs.open_output_stream(name)
                    table = Writer(stream, width)
                texts = [x or "" for x in part.column(1).to_pylist()]
                for doc_id, ids in zip(part.column(0).to_pylist(), code.encode(texts), strict=True):
                    table.add(key_of(doc_id), np.r_[np.frombuffer(ids, "<u4"), np.uint32(end_id)].astype(f"<u{width}").tobytes())
        if table is not None:
            table.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [name], "entries": [table.entries], "ids": [table.ids]}, schema=pa.schema([("shard", pa.int32()), ("file", pa.string()), ("entries", pa.int64()), ("ids", pa.int64())]))

    files = written(rows.mapInArrow(write, "shard int, file string, entries long, ids long"), "sstable-files").withColumn("k_group", F.expr(f"shard div {GROUP}"))
    # Running sums in two steps, so that no task orders all files: over groups of shards, and within each.
    groups = files.groupBy("k_group").agg(F.sum("ids").alias("k_ids"))
    groups = groups.withColumn("k_before", F.sum("k_ids").over(W.orderBy("k_group")) - F.col("k_ids")).drop("k_ids")
    own = F.sum("ids").over(W.partitionBy("k_group").orderBy("shard")) - F.col("ids")
    return files.withColumn("k_own", own).join(groups, "k_group").withColumn("first", F.col("k_before") + F.col("k_own")).withColumn("base", F.lit(out)).drop("k_group", "k_before", "k_own")


def read_tables(files: DataFrame) -> DataFrame:
    """All documents of the files: doc_id, start (ids of all before it) and ids (binary, 32 bits each)."""
    schema = "doc_id long, start long, ids binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first, base in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("file", "first", "base")), strict=True):
                with pafs.FileSystem.from_uri(base)[0].open_input_file(name) as source:
                    rows, size = [], 0
                    for doc_id, before, ids in Reader(source):
                        rows.append((doc_id, first + before, ids))
                        size += len(ids)
                        if size > 8_000_000:
                            yield _arrow(rows)
                            rows, size = [], 0
                    yield _arrow(rows)

    return files.repartition(max(1, files.count()), "file").mapInArrow(read, schema)


def _arrow(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "start", "ids"])
