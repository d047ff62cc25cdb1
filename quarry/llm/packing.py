"""Packing documents into training sequences: shortest pack first over the length histogram.

Token ids of a document, with its end id, are cut into pieces of the full length and a rest. The
histogram of rests (at most ``size`` - 1 bins) is packed on the driver: lengths are placed longest
first, each into the packs that are shortest so far, and counts of packing patterns are kept
rather than packs. Every place of a pattern then owns a range of ranks of its length, and pieces,
numbered within their length, are joined to their places by rank. Numbering is cut into buckets by
a hash, so a length that very many pieces share meets in no task.

Null text: empty (its end id is its only one). Repeated rows are packed each. An empty table gives
an empty result. Pieces carry any further columns along.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import batch_rows, written
from .texts import BATCH_ROWS, slices
from .tokens import encoder

SIZE = 2048
ROWS_PER_BUCKET = 4096
LEAST_BUCKETS = 64


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int = SIZE) -> DataFrame:
    """doc_id, start, length, doc_tokens and ids (binary, 32 bits each) of each piece."""
    batch_rows(docs.sparkSession, BATCH_ROWS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = encoder(tokenizer), int(end_id).to_bytes(4, "little")
        for batch in batches:
            for part in slices(batch):
                out = []
                ids = part.column(part.schema.get_field_index("doc_id")).to_pylist()
                texts = [x or "" for x in part.column(part.schema.get_field_index("text")).to_pylist()]
                for doc_id, got in zip(ids, code.encode(texts), strict=True):
                    got += end
                    n = len(got) // 4
                    out += [(doc_id, at, min(size, n - at), n, got[4 * at : 4 * (at + size)]) for at in range(0, n, size)]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                names = ["doc_id", "start", "length", "doc_tokens", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, ids binary")


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """Packs as (count, lengths in them), from counts of lengths: longest first, shortest pack first."""
    open_: list[tuple[int, int, int, tuple[int, ...]]] = []  # room (negated), order, count, lengths
    order = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        changed = []
        while left:
            if open_ and -open_[0][0] >= length:
                room, _, n, held = heapq.heappop(open_)
                now = min(n, left)
                if n > now:
                    heapq.heappush(open_, (room, order := order + 1, n - now, held))
                changed.append((room + length, now, (*held, length)))
                left -= now
                if left and (not open_ or -open_[0][0] < length):  # the changed ones may have room again
                    for r, k, h in changed:
                        heapq.heappush(open_, (r, order := order + 1, k, h))
                    changed = []
            else:
                changed.append((length - size, left, (length,)))
                left = 0
        for r, k, h in changed:
            heapq.heappush(open_, (r, order := order + 1, k, h))
    return [(n, held) for _, _, n, held in open_]


def places(packs: list[tuple[int, tuple[int, ...]]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, offset), sorted; ranks run on to the next row."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for n, held in packs:
        at = 0
        for length in held:
            rank = used.get(length, 0)
            rows.setdefault(length, []).append((rank, sequence, at))
            used[length] = rank + n
            at += length
        sequence += n
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` (length, more) with sequence_id and offset.

    Pieces of the full size are sequences of their own, numbered after the packs.
    """
    names = pieces.columns
    rows = written(pieces.withColumn("k_row", F.monotonically_increasing_id()), "pieces")
    buckets = max(LEAST_BUCKETS, rows.count() // ROWS_PER_BUCKET)
    marked = rows.withColumn("k_bucket", F.pmod(F.xxhash64("k_row"), F.lit(buckets)))
    counts = written(marked.groupBy("length", "k_bucket").agg(F.count("*").alias("k_n")), "piece-counts")
    first = counts.withColumn("k_first", F.sum("k_n").over(W.partitionBy("length").orderBy("k_bucket")) - F.col("k_n")).drop("k_n")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("k_n").alias("n")).collect()}  # at most ``size`` rows
    packs = patterns({k: n for k, n in histogram.items() if k < size}, size)
    table = places(packs)
    table[size] = np.array([(0, sum(n for n, _ in packs), 0)], np.int64)
    own = F.row_number().over(W.partitionBy("length", "k_bucket").orderBy("k_row")) - 1
    ranked = marked.withColumn("k_own", own).join(first, ["length", "k_bucket"]).withColumn("k_rank", F.col("k_first") + F.col("k_own")).select(*names, "k_rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch.column(batch.schema.get_field_index("length")), np.int64)
            ranks = np.asarray(batch.column(batch.schema.get_field_index("k_rank")), np.int64)
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                own = table[int(length)]
                at = np.searchsorted(own[:, 0], ranks[rows], "right") - 1
                sequence[rows] = own[at, 1] + ranks[rows] - own[at, 0]
                offset[rows] = own[at, 2]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names] + [pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    fields = [*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return ranked.mapInArrow(place, T.StructType(fields))
