"""Sharding by histogram sort.

Documents are ordered by (hash of the text, doc_id). The splitters between shards are found by
counting the exact bytes below candidate key boundaries over all partitions and looking closer, 12
bits of the key at a time, only where a splitter must lie; at most ``shards - 1`` ranges of 4,096
boundaries are open in a round, so what reaches the driver is bounded by the number of shards. Rows
then go to their shard in one exchange. Only DataFrame functions are used.

Law ``bytes``: the shards' sizes are near equal. With ``before`` = bytes of all rows with a smaller
key, a row's shard is ``floor(shards * before / total)``. Equal texts stay together, with the
``before`` of the group's first row, unless the group holds more than ``tolerance`` of a mean
shard; such a group is cut by doc_id.

Null text: empty. Null doc_id: as the smallest id. Rows equal in text and doc_id lie in one shard.
An empty table gives an empty result. Other columns pass through; the operator's own columns
replace input columns of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import utf8_size, written

BITS = 12  # of the key in a round
HASH_BITS = 60
ROWS_PER_SLICE = 65_536
LEAST_SLICES = 32
OWN = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _hash60(text: Column) -> Column:
    """The first 15 hex digits of the MD5, as a number; its order is that of the digits."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


FLIP = -(2**63)  # turns the sign bit: unsigned order of what results is the ids' order


def _unsigned(x: int) -> int:
    return x % 2**64


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


class _Probe:
    """Where splitter i is looked for: a range of keys, and the bytes below that range."""

    def __init__(self, target: int):
        self.target, self.below = target, 0
        self.level, self.prefix = 0, 0  # rounds done in the present key column, its leading bits
        self.hash: int | None = None  # set once the range is one group of equal texts
        self.found: tuple[int, int | None] | None = None  # last key below the splitter; None: its whole group


def _histogram(keys: DataFrame, probes: list[_Probe]) -> dict[tuple, list]:
    """One job: exact bytes, and the hashes met, of the 4,096 sub-ranges of each open range."""
    by_hash = sorted({(p.level, p.prefix) for p in probes if p.hash is None})
    by_id = sorted({(p.level, p.hash, p.prefix) for p in probes if p.hash is not None})
    bits = F.col("k_id").bitwiseXOR(F.lit(FLIP))
    parts = []
    for level in sorted({x[0] for x in by_hash}):
        shift = HASH_BITS - BITS * (level + 1)
        prefix = F.shiftright("k_hash", shift + BITS)
        rows = keys if level == 0 else keys.where(prefix.isin([p for x, p in by_hash if x == level]))
        parts.append(rows.select(F.lit(level).alias("level"), F.lit(None).cast("long").alias("h"), prefix.alias("prefix"), F.shiftright("k_hash", shift).alias("bin"), "size", "k_hash"))
    for level in sorted({x[0] for x in by_id}):
        top, shift = BITS * level, max(0, 64 - BITS * (level + 1))
        prefix = F.shiftrightunsigned(bits, 64 - top) if top else F.lit(0).cast("long")
        open_ = [(h, p) for x, h, p in by_id if x == level]
        here = F.lit(False)
        for h, p in open_:
            here = here | ((F.col("k_hash") == h) & (prefix == F.lit(_signed(p))))
        parts.append(keys.where(here).select(F.lit(level).alias("level"), F.col("k_hash").alias("h"), prefix.alias("prefix"), F.shiftrightunsigned(bits, shift).alias("bin"), "size", "k_hash"))
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    found: dict[tuple, list] = {}
    for r in rows.groupBy("level", "h", "prefix", "bin").agg(F.sum("size").alias("bytes"), F.min("k_hash").alias("lo"), F.max("k_hash").alias("hi")).collect():
        found.setdefault((r["level"], r["h"], _unsigned(r["prefix"])), []).append((_unsigned(r["bin"]), r["bytes"], r["lo"], r["hi"]))
    return {k: sorted(v) for k, v in found.items()}


def splitters(keys: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int | None]]:
    """The last key (hash, id bits or None) below each splitter; ``keys``: k_hash, k_id, size."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    if not total:
        return []
    probes = [_Probe(i * total) for i in range(1, shards)]  # targets times ``shards``: whole numbers
    while open_ := [p for p in probes if p.found is None]:
        bins = _histogram(keys, open_)
        for p in open_:
            below = p.below
            for at, size, lo, hi in bins[p.level, p.hash, p.prefix]:
                if below * shards >= p.target:
                    break
                chosen = (at, size, lo, hi, below)
                below += size
            at, size, lo, hi, p.below = chosen
            p.level, p.prefix = p.level + 1, at
            if p.hash is None and lo == hi:  # one group of equal texts
                if size * shards <= tolerance * total:
                    p.found = (lo, None)
                else:
                    p.hash, p.level, p.prefix = lo, 0, 0
            elif p.hash is not None and BITS * p.level >= 64:
                p.found = (p.hash, at)
    return [p.found for p in probes]


def shard_documents(docs: DataFrame, shards: int = 24, tolerance: float = 0.02, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (doc_id, text, more), or their columns ``keep``, with size, text_crc32, law, shard, slot and grown_shard.

    Hashes are computed once and written with the rows; ``keep`` without the text spares writing it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keep = [c for c in (docs.columns if keep is None else keep) if c not in OWN]
    keys = {"k_hash": _hash60(text), "k_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(FLIP)), "size": utf8_size(F.col("text")) + 8, "text_crc32": F.crc32(text), "k_row": F.monotonically_increasing_id()}
    rows = written(docs.select(*(F.col(f"`{c}`") for c in keep), *(v.alias(k) for k, v in keys.items())), "shard-keys")
    shard, cuts = F.lit(0), splitters(rows.select("k_hash", "k_id", "size"), shards, tolerance)
    for h, d in cuts:
        above = F.col("k_hash") > h
        if d is not None:
            above = above | ((F.col("k_hash") == h) & (F.col("k_id") > F.lit(_signed(d) ^ FLIP)))
        shard = shard + above.cast("int")
    slices = max(LEAST_SLICES, rows.count() // ROWS_PER_SLICE)
    # Slots: rows of a shard are numbered slice by slice, so that no task numbers a whole shard.
    placed = rows.withColumns({"shard": shard, "k_slice": F.pmod(F.xxhash64("k_row"), F.lit(slices))})
    first = placed.groupBy("shard", "k_slice").agg(F.count("*").alias("k_n"))
    first = first.withColumn("k_first", F.sum("k_n").over(W.partitionBy("shard").orderBy("k_slice")) - F.col("k_n")).drop("k_n")
    own = F.row_number().over(W.partitionBy("shard", "k_slice").orderBy("k_id", "k_hash", "k_row")) - 1
    placed = placed.withColumn("k_own", own).join(first, ["shard", "k_slice"])
    return placed.select(
        *(F.col(f"`{c}`") for c in keep), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("k_first") + F.col("k_own")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
