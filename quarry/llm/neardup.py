"""The pipeline's near-copies by SimHash: texts whose sets of five-word shingles have a Jaccard similarity >= 0.8.

Two such texts differ in 0.15 of their SimHash bits or less (shingles weigh alike; cosine 2J / (1 + J)), in 10
of 64 on average, so one fingerprint linked at 3 bits finds few of them. A text has TABLES independent
fingerprints of BITS bits instead, and one of 128 bits that names it. Each fingerprint is ball-hashed: it emits itself
and the PROBES - 1 variants with its weakest bits flipped (sums near zero differ first), and two texts meet in the
middle, at a variant of both. At similarity 0.8 that fails in all tables with probability 0.00003. Of those that meet,
names at more than FAR bits are no candidates (similarity 0.8: 19.4 expected, standard deviation 4.1; unrelated: 64).

A group of many near-copies meets in very many buckets. The links of a batch of buckets become as few that join the same
names, before and after they are dealt by their member. What the first tables have joined is one group from there on: its
members still meet all others, but links are made between groups, so that a large group isn't linked anew by each table.

Candidates are then compared exactly, by shingle sets: every pair of a component of candidates, whether it met or not, but
for those that links found already join. A component of up to MEMBERS sets is handled in one task. A larger one is
compared with one of its members first; only the sets not linked to it are compared with all others, in pairs of blocks.

Texts of equal sets fall together before that. Words are lowered (A-Z) and cut at ASCII white space;
fewer than five words are one shingle; null and wordless texts are copies of each other. Each row has
a key of its own, so repeated and null doc_ids neither lose nor keep rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_rows, condensed, in_files, picked, spread_join, written
from .components import connected
from .texts import rolled, texts_of, with_columns

SHINGLE = 5  # words
NAME = 128  # bits of the fingerprint that names a text
TABLES, BITS = 24, 26
DEALT = 13  # lower bits of a fingerprint by which keys are not dealt, so that a text's variants share rows
AT_ONCE = 4  # tables whose variants are on disk at the same time
FAR = 38  # bits in which the names of candidates differ at most
SIMILAR = (4, 5)  # Jaccard similarity of linked texts, as a fraction
MEMBERS = 1_000  # sets that one task compares, and twice a block of larger components
SET_ROWS = 200  # rows in an Arrow batch of shingle sets
ALL_PAIRS = 8  # of a bucket with at most so many members

_TIMES = np.random.default_rng(11).integers(0, 2**63, (NAME + TABLES * BITS) // 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LINKS = "a binary, b binary"
_LANES = np.uint64(0x00FF00FF00FF00FF)
# Weak bits flipped by each variant, as ranks: by the sum of (rank + 1) ** 2, as squares of sums grow.
_FLIPS = ((), (0,), (1,), (0, 1), (2,), (0, 2), (1, 2), (0, 1, 2), (3,), (0, 3), (1, 3), (0, 1, 3), (2, 3), (4,), (0, 2, 3), (0, 4))
PROBES, WEAK = len(_FLIPS), 5
_PATTERN = np.array([[rank in f for f in _FLIPS] for rank in range(WEAK)], np.int64)


def shingles(text: bytes) -> np.ndarray:
    """The sorted set of a text's hashed shingles."""
    words = text.lower().split()  # of bytes: lowers A-Z alone
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return np.unique(rolled(codes, min(SHINGLE, len(words)))) if words else codes


def sums(codes: np.ndarray) -> np.ndarray:
    """The sums of all fingerprints' bits: of a pseudo-random byte, less its mean, for each shingle and bit."""
    total = np.zeros((2, len(_TIMES) * 4), np.int64)
    for a in range(0, len(codes), 256):  # so many bytes add up to less than 2 ** 16
        mixed = codes[a : a + 256, None] * _TIMES
        mixed ^= mixed >> np.uint64(32)
        for k, shift in enumerate((0, 8)):
            total[k] += np.add.reduce(mixed >> np.uint64(shift) & _LANES, axis=0).view(np.uint16)
    return total.ravel() * 2 - 255 * len(codes)


def fingerprint(codes: np.ndarray) -> tuple[bytes, bytes]:
    """A text's name, and the sums of its tables' bits, as signed bytes (-127 to 127, never 0)."""
    found = sums(codes)
    size = np.abs(found[NAME:])
    size = 1 + size * 126 // max(1, int(size.max()))
    return np.packbits(found[:NAME] > 0).tobytes(), np.where(found[NAME:] > 0, size, -size).astype(np.int8).tobytes()


def variants(margins: np.ndarray, first: int) -> np.ndarray:
    """``margins``: texts x tables x BITS. Keys of each text: its fingerprints and their likeliest variants."""
    weak = np.argsort(np.abs(margins), axis=2, kind="stable")[:, :, :WEAK]
    base = (margins > 0).astype(np.int64) @ (1 << np.arange(BITS, dtype=np.int64))
    flips = np.einsum("ntw,wp->ntp", np.int64(1) << weak, _PATTERN)
    tables = np.arange(first, first + margins.shape[1], dtype=np.int64)[None, :, None] << BITS
    return ((base[:, :, None] ^ flips) | tables).reshape(len(margins), -1)


def _emitted(batches: Iterator[pa.RecordBatch], first: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if n:
            margins = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int8).reshape(n, TABLES, BITS)[:, first : first + AT_ONCE]
            keys = np.sort(variants(margins, first), axis=1)
            names = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64).reshape(n, 2)
            deal = keys >> DEALT
            new = np.flatnonzero(np.diff(deal, axis=1, prepend=-1).ravel())  # a row for each of a text's deals
            ends = [pa.array(names[new // keys.shape[1], k]) for k in (0, 1)]
            lower = (keys.ravel() & ((1 << DEALT) - 1)).astype("<u2")
            offsets = np.r_[new, keys.size].astype(np.int32) * 2
            lists = pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(offsets), pa.py_buffer(lower)])
            group = batch.column(2).take(pa.array(new // keys.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(deal.ravel()[new]), *ends, lists, group], names=["k_deal", "k_1", "k_2", "k_lower", "k_group"])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=-1, dtype=np.int64)  # of signed numbers it counts the absolute value's


def least_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each one's component, by links between 0 to n - 1."""
    least, last = np.arange(n), None
    while last is None or (least != last).any():
        last = least.copy()
        np.minimum.at(least, a, last[b])
        np.minimum.at(least, b, last[a])
        least = least[least]
    return least


def near_names(keys: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within buckets that join the members of each component by near names, as places. ``keys`` are sorted."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(keys)])
    rest = np.repeat(first + size, size) - np.arange(len(keys))  # members from each one on
    rest[np.repeat(size > ALL_PAIRS, size)] = 0
    a, b = [], []
    for step in range(1, ALL_PAIRS):
        at = np.flatnonzero(rest > step)
        at = at[_apart(names[at], names[at + step]) <= FAR]
        a.append(at)
        b.append(at + step)
    for start, n in zip(first[size > ALL_PAIRS].tolist(), size[size > ALL_PAIRS].tolist(), strict=True):
        left, queue = np.arange(start, start + n), []
        while len(left):
            at = queue.pop() if queue else int(left[0])
            near = _apart(names[left], names[at]) <= FAR
            found = left[near & (left != at)]
            queue += found.tolist()
            a.append(found)
            b.append(np.full(len(found), at))
            left = left[~near]
    a, b = (np.concatenate(x).astype(np.int64) for x in (a, b))
    return a, b


def group_links(a: np.ndarray, b: np.ndarray, names: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of as few links as join what the links ``a``, ``b`` (places) join, if names of one group, not 0, are joined already."""
    at, ends = np.unique(np.r_[a, b], return_inverse=True)
    order = np.lexsort((names[at, 1], names[at, 0]))
    at, rank = at[order], np.argsort(order)
    known = groups[at] != 0
    one, first, number = np.unique(np.c_[groups[at], np.where(known[:, None], 0, names[at])], axis=0, return_index=True, return_inverse=True)
    ends = number.ravel()[rank[ends]]
    least = least_linked(len(one), ends[: len(a)], ends[len(a) :])
    found = np.flatnonzero(least != np.arange(len(one)))
    return names[at[first[found]]], names[at[first[least[found]]]]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by deal; the last one of a batch may go on in the next."""

    def linked(keys: np.ndarray, names: np.ndarray, groups: np.ndarray) -> pa.RecordBatch:
        ends = [pa.array([r.tobytes() for r in x], pa.binary()) for x in group_links(*near_names(keys, names), names, groups)]
        return pa.RecordBatch.from_arrays(ends, names=["a", "b"])

    keys, names, groups = np.zeros(0, np.int64), np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
    for batch in batches:
        deal, *name = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        group = batch.column(4).fill_null(0).to_numpy(zero_copy_only=False)
        times = np.asarray(pc.binary_length(batch.column(3))).astype(np.int64) // 2
        lower = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u2")
        own = np.repeat(deal << DEALT, times) | lower
        keys, names, groups = np.r_[keys, own], np.r_[names, np.repeat(np.stack(name, 1), times, axis=0)], np.r_[groups, np.repeat(group, times)]
        if len(keys):
            order = np.lexsort((names[:, 1], names[:, 0], keys))
            keys, names, groups = keys[order], names[order], groups[order]
            cut = int(np.searchsorted(keys, keys[-1] >> DEALT << DEALT, "left"))
            if cut:
                yield linked(keys[:cut], names[:cut], groups[:cut])
            keys, names, groups = keys[cut:], names[cut:], groups[cut:]
    yield linked(keys, names, groups)


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a batch's names to the least one of their component by its links."""
    for batch in batches:
        both = pa.concat_arrays([batch.column(0), batch.column(1)]).dictionary_encode()
        order = pc.array_sort_indices(both.dictionary)
        names, rank = both.dictionary.take(order), np.argsort(order.to_numpy())
        ends = rank[both.indices.to_numpy()]
        least = least_linked(len(names), ends[: batch.num_rows], ends[batch.num_rows :])
        found = np.flatnonzero(least != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([names.take(pa.array(found)), names.take(pa.array(least[found]))], names=["a", "b"])


def thinned(links: DataFrame) -> DataFrame:
    """Links with the components of ``links`` (a, b), of which few have one a."""
    return links.repartition("a").mapInArrow(_thinned, _LINKS).distinct()


def links(named: DataFrame) -> DataFrame:
    """``named``: k_name, k_margins, distinct names. Returns a, b: candidates' names; their components are those of all that meet."""
    batch_rows(named.sparkSession, 20_000)
    count, found = named.count(), []
    rows = named.withColumn("k_group", F.lit(None).cast("long"))
    for first in range(0, TABLES, AT_ONCE):
        keys = rows.select("k_name", "k_margins", "k_group").mapInArrow(lambda b, first=first: _emitted(b, first), "k_deal long, k_1 long, k_2 long, k_lower binary, k_group long")
        met = keys.repartition("k_deal").sortWithinPartitions("k_deal").mapInArrow(_met, _LINKS)
        found.append(written(in_files(thinned(met), count), "candidates"))
        if first == 0:
            groups = found[0].unionByName(found[0].select(F.col("b").alias("a"), "b")).groupBy(F.col("a").alias("k_name")).agg(F.xxhash64(F.min("b")).alias("k_group"))
            rows = picked(named, written(in_files(groups, count), "groups"), "k_name", "left")
    return thinned(reduce(DataFrame.unionByName, found))


def tree_edges(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (found, finder) that join the members of each component of similar sets."""
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    size = np.array([len(s) for s in sets])
    ends = np.cumsum(size)
    own = [codes[e - n : e] for e, n in zip(ends, size, strict=True)]
    left, flat, starts = np.arange(len(sets)), codes, ends - size
    mark = np.zeros(int(codes.max()) + 1, np.int32)
    queue, out = [], []
    while len(left):
        if queue:
            at = queue.pop()
            mark[own[at]] = 1
            both = np.add.reduceat(mark[flat], starts)
            mark[own[at]] = 0
            near = both * SIMILAR[1] >= (size[left] + size[at] - both) * SIMILAR[0]
        else:
            at, near = int(left[0]), np.arange(len(left)) == 0
        if near.any():
            found = left[near].tolist()
            queue += found
            out += [(i, at) for i in found if i != at]
            left = left[~near]
            flat = np.concatenate([own[i] for i in left]) if len(left) else flat[:0]
            starts = np.cumsum(size[left]) - size[left]
    return out


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets come sorted by key; the last one of a batch may go on in the next."""
    key, held = None, []

    def links() -> pa.RecordBatch:
        pairs = tree_edges([np.frombuffer(s, "<u8") for _, s in held]) if len(held) > 1 else []
        ends = [pa.array([held[p[k]][0] for p in pairs], pa.binary()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays(ends, names=["a", "b"])

    for batch in batches:
        for k, name, found in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if k != key and held:
                yield links()
                held = []
            key = k
            held.append((name, found))
    if held:
        yield links()


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether each set is similar to its component's centre."""
    for batch in batches:
        pairs = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("k_content", "k_middle")), strict=True)
        near = [len(tree_edges([np.frombuffer(x, "<u8") for x in p])) == 1 for p in pairs]
        kept = [batch.column(batch.schema.get_field_index(c)) for c in ("k_comp", "k_set", "k_centre")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(near, pa.bool_())], names=["k_comp", "k_set", "k_centre", "k_near"])


def _compared(sets: DataFrame) -> DataFrame:
    """Links within components that one task compares. ``sets``: k_task, k_set, k_content."""
    dealt = sets.select("k_task", "k_set", "k_content").repartition("k_task").sortWithinPartitions("k_task")
    return dealt.mapInArrow(_verified, _LINKS)


def large_links(sets: DataFrame) -> DataFrame:
    """Links within components of any size, by blocks. ``sets``: k_comp, k_set, k_content.

    All sets meet one of their component, its centre. Those not similar to it then meet all others.
    """
    centres = sets.groupBy("k_comp").agg(F.min_by("k_set", "k_set").alias("k_centre"), F.min_by("k_content", "k_set").alias("k_middle"))
    beside = spread_join(sets, centres, "k_comp", ["k_set"]).mapInArrow(_beside, "k_comp binary, k_set binary, k_centre binary, k_near boolean")
    beside = written(beside, "beside-centres")
    found = beside.where("k_near and k_set <> k_centre").select(F.col("k_set").alias("a"), F.col("k_centre").alias("b"))
    block = lambda n: F.ceil(2 * F.col(n) / MEMBERS).cast("int")
    counts = beside.groupBy("k_comp").agg(F.count_if(~F.col("k_near")).alias("k_left"), F.count_if("k_near").alias("k_linked")).where("k_left > 0")
    counts = counts.select("k_comp", block("k_left").alias("k_left"), block("k_linked").alias("k_linked"))
    if counts.isEmpty():
        return found
    placed = spread_join(beside.select("k_comp", "k_set", "k_near"), counts, "k_comp", ["k_set"])
    own = F.when(F.col("k_near"), F.col("k_left") + F.pmod(F.xxhash64("k_set"), F.col("k_linked"))).otherwise(F.pmod(F.xxhash64("k_set"), F.col("k_left"))).cast("int")
    most = F.when(F.col("k_near"), F.col("k_left")).otherwise(F.col("k_left") + F.col("k_linked"))
    placed = placed.withColumn("k_own", own).select("k_comp", "k_set", "k_own", F.explode(F.sequence(F.lit(0), most - 1)).alias("k_with"))
    tasks = placed.select("k_set", F.xxhash64("k_comp", F.least("k_own", "k_with"), F.greatest("k_own", "k_with")).alias("k_task"))
    return found.unionByName(_compared(tasks.join(sets.select("k_set", "k_content"), "k_set")))


def _distinct(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct sets with their least row and name; distinct names with the sums of their tables' bits. ``rows``: doc_id, text, k_row."""

    def marks():
        def work(part: pa.RecordBatch) -> list:
            sets = [shingles(t) for t in texts_of(part)]
            found = [fingerprint(s) if len(s) else (None, None) for s in sets]
            return [[xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [f[0] for f in found], [f[1] for f in found]]

        return work

    fields = [T.StructField(c, T.BinaryType()) for c in ("k_set", "k_name", "k_margins")]
    marked = written(with_columns(rows.select("doc_id", "k_row", "text"), marks, fields, ["doc_id", "k_row"]), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k_row")
    least = marked.groupBy("k_set").agg(F.min(order).alias("k_least"), F.min("k_name").alias("k_name"))  # a set has one name
    least = written(in_files(least, rows.count()), "distinct-sets")
    one = least.where("k_name is not null").groupBy("k_name").agg(F.min("k_least.k_row").alias("k_row")).select("k_row")
    return least, written(marked.select("k_row", "k_name", "k_margins").join(one, "k_row", "left_semi"), "names")


def _candidates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct sets, and links of names to the least one of their component of candidates."""
    least, names = condensed(lambda: _distinct(rows))
    return least, connected(links(names))


def _copies(rows: DataFrame) -> DataFrame:
    """k_row of the rows that go."""

    def contents():
        return lambda part: [[shingles(t).astype("<u8").tobytes() for t in texts_of(part)]]

    least, stars = condensed(lambda: _candidates(rows))
    sets = least.where("k_name is not null").select("k_set", "k_name", F.col("k_least.k_row").alias("k_row"))
    grouped = sets.join(stars.select(F.col("a").alias("k_name"), F.col("b").alias("k_root")), "k_name", "left")
    count = least.count()
    grouped = written(in_files(grouped.select(F.coalesce("k_root", "k_name").alias("k_comp"), "k_set", "k_row"), count), "components")
    sizes = grouped.groupBy("k_comp").agg(F.count("*").alias("k_n")).where("k_n > 1")
    wanted = written(in_files(spread_join(grouped, sizes, "k_comp", ["k_set"]), count), "wanted-sets")
    texts = picked(rows.select("k_row", "text"), wanted.select("k_row"), "k_row", "left_semi").join(wanted, "k_row")
    sets = written(with_columns(texts, contents, [T.StructField("k_content", T.BinaryType())], ["k_comp", "k_set", "k_n"]), "compared-sets")
    batch_rows(rows.sparkSession, SET_ROWS)
    found = _compared(sets.where(F.col("k_n") <= MEMBERS).withColumn("k_task", F.col("k_comp")))
    large = sets.where(F.col("k_n") > MEMBERS)
    if not large.isEmpty():
        found = found.unionByName(large_links(large.drop("k_n")))
    stars = connected(found)
    rooted = least.join(stars.select(F.col("a").alias("k_set"), F.col("b").alias("k_root")), "k_set", "left")
    kept = rooted.groupBy(F.coalesce("k_root", "k_set")).agg(F.min("k_least").alias("k_least")).select("k_least.k_row")
    return rows.select("k_row").join(kept, "k_row", "left_anti")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each component: that with its smallest doc_id, null ids last."""
    rows = written(docs.withColumn("k_row", F.monotonically_increasing_id()), "keyed-rows")
    gone = condensed(lambda: written(in_files(_copies(rows), rows.count()), "copies"))
    return picked(rows, gone, "k_row", "left_anti").select(docs.columns)
