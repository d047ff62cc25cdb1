"""Near-duplicates by SimHash, linked by meet-in-the-middle ball hashing.

Fingerprints have 64 bits and link at 3 or fewer differing bits. Every distinct fingerprint emits
variants of itself within half that radius, and linked fingerprints meet at a variant:

* all emit themselves and their 64 variants of one bit: those that differ in 1 or 2 bits meet;
* those with an even number of ones also emit variants of two bits. Two fingerprints that differ in
  3 bits differ in parity too, so the even one's two bits and the odd one's single bit meet. Of any
  3 bits, two lie in the same half of the fingerprint, so pairs of bits within a half suffice (992).

A member of a variant's bucket is 0, 1 or 2 bits away from it. Where a bucket has a member within
1 bit, every other one is within 3 bits of that member: the collision is its own verification, and
linking all to the smallest such member loses nothing and adds nothing. A bucket holds at most
1,057 fingerprints, whatever the corpus; no pairs are made. Copies fall together before that.

Null or wordless text: fingerprint 0. Fewer words than a shingle: the whole sequence is one. Null
doc_id: takes part, but is never a component's id unless all ids in it are null. Repeated rows get
the same answer. Other columns pass through; the operator's own columns replace input columns of
the same names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import batch_rows, spread_join, tasks_for, written
from .components import connected
from .texts import texts_of, with_columns

SHINGLE = 3  # words
SEED = 42
ROWS_A_TASK = 20_000  # fingerprints whose variants one task emits
NEAR = 1 + 64  # masks of at most one bit come first

_ONE = [1 << i for i in range(64)]
_TWO = [1 << i | 1 << j for half in (0, 32) for i in range(half, half + 32) for j in range(half, i)]
MASKS = np.array([0, *_ONE, *_TWO], np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text as an unsigned number."""
    words = text.lower().split()  # of bytes: lowers A-Z alone
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        digest, join = xxhash.xxh64_intdigest, b" ".join
        hashes = [digest(join(w), SEED) for w in zip(*(words[j:] for j in range(shingle)), strict=False)]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduce(bits, axis=0, dtype=np.int32) * 2 > len(hashes)
    return int(np.packbits(ones, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str] | None = None, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` (text, more), or their columns ``keep``, with k_fp: the fingerprint as a long."""

    def make():
        return lambda part: [np.array([fingerprint(t, shingle) for t in texts_of(part)], np.uint64).view(np.int64)]

    return with_columns(docs, make, [T.StructField("k_fp", T.LongType())], keep=keep)


def _signed(masks) -> str:
    return ",".join(f"{int(np.uint64(m).view(np.int64))}L" if int(m) != 1 << 63 else "-9223372036854775807L - 1L" for m in masks)


def _star(v: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of whole buckets; ``v`` is sorted."""
    first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    size = np.diff(np.r_[first, len(v)])
    rows = np.repeat(size > 1, size)
    if not rows.any():
        return v[:0], v[:0]
    v, tag, size = v[rows], tag[rows], size[size > 1]
    fp = (v.view(np.uint64) ^ MASKS[tag]).view(np.int64)
    top = np.iinfo(np.int64).max
    near = np.minimum.reduceat(np.where(tag < NEAR, fp, top), np.r_[0, np.cumsum(size)[:-1]])
    seen = np.add.reduceat((tag < NEAR).astype(np.int64), np.r_[0, np.cumsum(size)[:-1]])
    to, ok = np.repeat(near, size), np.repeat(seen > 0, size)
    ok &= fp != to
    pairs = np.unique(np.stack([fp[ok], to[ok]], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets come sorted by variant; the last one of a batch may go on in the next."""
    v, tag = np.zeros(0, np.int64), np.zeros(0, np.int16)
    for batch in batches:
        v = np.r_[v, batch.column(0).to_numpy(zero_copy_only=False)]
        tag = np.r_[tag, batch.column(1).to_numpy(zero_copy_only=False)]
        if not len(v):
            continue
        cut = int(np.searchsorted(v, v[-1], "left"))
        a, b = _star(v[:cut], tag[:cut])
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        v, tag = v[cut:], tag[cut:]
    a, b = _star(v, tag)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def links(fps: DataFrame) -> DataFrame:
    """``fps``: k_fp, distinct. Returns a, b: links whose components are those of all links."""
    near, far = _signed(MASKS[:NEAR]), _signed(MASKS)
    ball = F.when(F.expr("bit_count(k_fp) % 2 = 0"), F.expr(f"array({far})")).otherwise(F.expr(f"array({near})"))
    fps = fps.repartition(tasks_for(fps.sparkSession, fps.count(), ROWS_A_TASK), "k_fp")  # rows are few bytes here and 1,057 times as many below
    emitted = fps.select("k_fp", F.posexplode(ball).alias("tag", "mask")).select(F.col("k_fp").bitwiseXOR(F.col("mask")).alias("v"), F.col("tag").cast("short").alias("tag"))
    return emitted.repartition("v").sortWithinPartitions("v").mapInArrow(_edges, "a long, b long")


def near_duplicates(docs: DataFrame, keep: list[str] | None = None, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` (doc_id, text, more), or their columns ``keep``, with fingerprint and component_id."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("fingerprint", "component_id")]
    numbered = docs.withColumn("k_row", F.monotonically_increasing_id())
    marked = written(fingerprints(numbered, [*{**dict.fromkeys(keep), "doc_id": None, "k_row": None}], shingle), "fingerprints")
    fps = written(marked.groupBy("k_fp").agg(F.min("doc_id").alias("k_least")), "distinct-fingerprints")
    batch_rows(docs.sparkSession, 50_000)
    stars = connected(links(fps.select("k_fp")))
    rooted = fps.join(stars.select(F.col("a").alias("k_fp"), F.col("b").alias("k_root")), "k_fp", "left").withColumn("k_root", F.coalesce("k_root", "k_fp"))
    rooted = written(rooted, "rooted")
    least = rooted.groupBy("k_root").agg(F.min("k_least").alias("component_id"))
    member = spread_join(rooted, least, "k_root", ["k_fp"]).select("k_fp", "component_id")
    found = spread_join(marked, member, "k_fp", ["k_row"])  # a third of all rows may be copies of one text
    return found.select(*keep, F.lpad(F.lower(F.hex("k_fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One document of each component: the row with its smallest doc_id.

    Of rows that repeat that id one stays, whatever their texts, and rows with a null doc_id all stay.
    The pipeline uses neardup.drop_near_copies, which keeps one row of each component.
    """
    kept = near_duplicates(docs.select("doc_id", "text"), ["doc_id"], shingle).where("doc_id = component_id").select(F.col("doc_id").alias("k_id")).distinct()
    first = F.row_number().over(W.partitionBy("doc_id").orderBy(F.lit(0)))
    named = docs.where("doc_id is not null").withColumn("k_first", first)
    stay = named.join(kept, F.col("doc_id") == F.col("k_id"), "left_semi").where("k_first = 1").drop("k_first")
    return stay.unionByName(docs.where("doc_id is null"))
