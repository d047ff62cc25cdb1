"""Substring dedup: suffix automata of reference passages, and spans of documents they match.

A window is WINDOW consecutive words. Every window has an anchor: its k-gram of smallest hash, so
equal windows have equal anchors. Anchors that occur twice or more are counted over all documents;
only their windows can repeat. All windows of an anchor go to the reference shard of the anchor's
first occurrence: the suffix automaton of such passages in one stretch of CHUNK words of a document,
so that an automaton is bounded however long a text is. Documents are streamed through it for
matching statistics, and windows that it has seen earlier are removed. Windows that repeat but not
in that stretch (variants that share an anchor) are settled by grouping them by a 128-bit hash; the
README gives their share. Both steps compare a window with its earliest occurrence, so nothing is lost.

Automata are routed by anchor instead of being broadcast: the reference is the corpus itself, so no
bound on it can be proven. A shard that very many documents ask is copied to several tasks, each
of which streams a part of them.

Order: doc_id, then (for rows that share an id but not a text) the text's hash, then position. Rows
equal in both count as one document and get the same answer. Texts of one id whose 32-bit hashes agree are
told apart by 128 bits and numbered. Null text: no words. A null doc_id counts as the smallest id. An
anchor that very many documents hold makes one large partition of two joins, which Spark splits as it runs
(``spark.sql.adaptive.skewJoin``). Other columns pass through; the operator's own columns replace input columns of
the same names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automaton import SuffixAutomaton
from .common import batch_rows, written
from .texts import BATCH_ROWS, covered, rolled, texts_of, window_starts, with_columns, words_of

WINDOW = 20
GRAM = 6  # words of an anchor
CHUNK = 1 << 16  # words of a document in one reference shard
MOST_BUSY = 1_000_000  # busy shards whose list is broadcast
ASKED = 512  # segments that one copy of a shard is asked about, about
LEAST = -(2**63)
CLASH_BITS = 8  # of a row's key, for texts of one id whose hashes agree


class _Codes(dict):
    """Words to 64-bit hashes that are the same in every process; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


def _anchors(texts: list[bytes], codes: _Codes, window: int, gram: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """words, first word of each text, window starts, their anchors' places, hashes of k-grams."""
    words, starts = words_of(texts)
    coded = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    grams = rolled(coded, gram)
    at, _ = window_starts(starts, window, len(words))
    if not len(at):
        return words, starts, at, at, grams
    # The leftmost smallest hash of the grams in each window: hashes' upper halves, then places.
    least = grams & np.uint64(0xFFFFFFFF << 32) | np.arange(len(grams), dtype=np.uint64)
    width, need = 1, window - gram + 1
    while width < need:
        step = min(width, need - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    places = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return words, starts, at, places, grams


def _anchor_rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """k_doc, k_row, h, p: each anchor of each document."""

    def make():
        codes = _Codes()

        def work(part: pa.RecordBatch) -> list:
            _, starts, _, places, grams = _anchors(texts_of(part), codes, window, gram)
            own = np.unique(places)
            cut = np.searchsorted(own, starts)
            hashes = grams[own].view(np.int64) if len(own) else np.zeros(0, np.int64)
            local = own - starts[np.searchsorted(starts, own, "right") - 1]
            offsets = pa.array(cut, pa.int32())
            return [pa.ListArray.from_arrays(offsets, pa.array(hashes)), pa.ListArray.from_arrays(offsets, pa.array(local.astype(np.int32)))]

        return work

    fields = [T.StructField("k_h", T.ArrayType(T.LongType())), T.StructField("k_p", T.ArrayType(T.IntegerType()))]
    each = with_columns(docs, make, fields, keep=["k_doc", "k_row"])
    return each.select("k_doc", "k_row", F.explode(F.arrays_zip("k_h", "k_p")).alias("a")).select("k_doc", "k_row", F.col("a.k_h").alias("h"), F.col("a.k_p").alias("p"))


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with k_doc and k_row, which rows share that are equal in doc_id and text, and no others do."""
    text = F.coalesce(F.col("text"), F.lit(""))
    doc, row = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)), F.hash(text).cast("long") * 2**CLASH_BITS
    wide = {"k_a": F.xxhash64(text), "k_b": F.xxhash64(F.lit(1), text)}
    rows = docs.withColumns({"k_doc": doc, "k_row": row})
    told = rows.select("k_doc", "k_row", *(v.alias(k) for k, v in wide.items()))
    apart = [F.min(c) != F.max(c) for c in wide]
    clash = told.groupBy("k_doc", "k_row").agg((apart[0] | apart[1]).alias("k_apart")).where("k_apart").select("k_doc", "k_row")
    if clash.isEmpty():
        return rows
    own = F.row_number().over(W.partitionBy("k_doc", "k_row").orderBy(*wide)) - 1  # few: their 32-bit hashes agree
    own = F.when(own < 2**CLASH_BITS, own).otherwise(F.raise_error(F.lit("over 256 texts of one doc_id have one 32-bit hash")).cast("int"))
    numbers = written(told.join(clash, ["k_doc", "k_row"], "left_semi").distinct().withColumn("k_own", own), "clashes")
    rows = rows.withColumns(wide).join(numbers, ["k_doc", "k_row", *wide], "left")
    return rows.withColumn("k_row", F.col("k_row") + F.coalesce("k_own", F.lit(0))).drop("k_own", *wide)


_SEGMENTS = T.ArrayType(T.StructType([T.StructField("shard", T.LongType()), T.StructField("query", T.BooleanType()), T.StructField("start", T.IntegerType()), T.StructField("asked", T.ArrayType(T.IntegerType())), T.StructField("words", T.BinaryType())]))


def _place(p: Column) -> Column:
    """The order of a stretch of words: by k_doc, k_row and CHUNK, as one number."""
    number = lambda x: F.lit(str(x)).cast("decimal(20,0)")
    document = (F.col("k_doc").cast("decimal(20,0)") + number(2**63)) * number(2**40) + F.col("k_row").cast("decimal(20,0)") + number(2**39)
    return (document * F.lit(2**22).cast("decimal(8,0)") + F.floor(p / CHUNK).cast("decimal(8,0)")).cast("decimal(38,0)")


def _segments(words: list[bytes], at: np.ndarray, shards: np.ndarray, query: np.ndarray, window: int) -> list[dict]:
    """Maximal runs of words under windows ``at`` of the same shard and part in it, with those windows."""
    order = np.lexsort((at, query, shards))
    at, shards, query = at[order], shards[order], query[order]
    cut = np.flatnonzero((np.diff(at) > window) | (np.diff(at) < 0) | (shards[1:] != shards[:-1]) | (query[1:] != query[:-1])) + 1
    ends = np.r_[cut, len(at)].tolist()
    out = []
    for i, j in zip([0, *ends[:-1]], ends, strict=True):
        if i < j:
            a, b = int(at[i]), int(at[j - 1]) + window
            out.append({"shard": int(shards[i]), "query": bool(query[i]), "start": a, "asked": (at[i:j] - a).tolist(), "words": b" ".join(words[a:b])})
    return out


def _hash(words: list[bytes]) -> tuple[int, int]:
    n = xxhash.xxh3_128_intdigest(b" ".join(words))
    return (n >> 64) - (1 << 63), (n & (1 << 64) - 1) - (1 << 63)


class _Shard:
    """One automaton, and where its reference segments lie in it."""

    def __init__(self, key: tuple):
        self.key, self.automaton, self.own, self.seen = key, SuffixAutomaton(), [], set()

    def learn(self, row: tuple, start: int, asked: list[int], words: list[bytes]) -> None:
        if (row, start) in self.seen:  # a repeated row
            return
        self.seen.add((row, start))
        self.own.append((row, start, asked, self.automaton.size, words))
        for w in words:
            self.automaton.add(w)
        self.automaton.add((len(self.own),))  # ends the segment; equals no word


def _stream(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard and copy, reference first. Yields removed windows and open ones."""
    names = ("k_doc", "k_row", "lo", "hi", "h1", "h2")
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    out: list[tuple] = []

    def removed(row: tuple, start: int, asked: list[int]) -> None:
        cut = np.array(asked)
        for run in np.split(cut, np.flatnonzero(np.diff(cut) > 1) + 1):
            if len(run):
                out.append((*row, start + int(run[0]), start + int(run[-1]), None, None))

    def settle(shard: _Shard | None) -> None:
        """The reference's own repeats, once."""
        for row, start, asked, base, words in shard.own if shard and shard.key[1] == 0 else ():
            ends = list(shard.automaton.matches(words, window))
            removed(row, start, [s for s in asked if ends[s + window - 1] < base + s + window - 1])

    shard = None
    for batch in batches:
        for key, copy, query, doc, row, start, asked, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if shard is None or shard.key != (key, copy):
                settle(shard)
                shard = _Shard((key, copy))
            words = words.split(b" ")
            if not query:
                shard.learn((doc, row), start, asked, words)
                continue
            ends = list(shard.automaton.matches(words, window))
            removed((doc, row), start, [s for s in asked if ends[s + window - 1] >= 0])
            for s in asked:
                if ends[s + window - 1] < 0:
                    out.append((doc, row, start + s, start + s, *_hash(words[s : s + window])))
        if len(out) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)
            out.clear()
    settle(shard)
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)


def remove_repeats(docs: DataFrame, keep: list[str] | None = None, window: int = WINDOW, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, more), or their columns ``keep``, with n_words, n_removed and kept.

    kept: the words that stay, joined by spaces, or with ``digest`` the SHA-256 of that.
    """
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "n_removed", "kept")]
    rows = _keyed(docs)
    anchors = written(_anchor_rows(rows.select("k_doc", "k_row", "text"), window, gram), "anchors")
    again = anchors.groupBy("h").agg(F.min(_place(F.col("p"))).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = written(again, "repeated-anchors")
    part = F.struct("p", F.xxhash64("first").alias("shard"), (F.col("first") != _place(F.col("p"))).alias("query"))
    asked = anchors.join(again, "h").groupBy("k_doc", "k_row").agg(F.sort_array(F.collect_set(part)).alias("k_a"))  # as many as its anchors
    asked = written(asked, "asked-anchors")

    def finish(words: list[bytes], cut: np.ndarray | None) -> tuple[int, int, str]:
        stay = words if cut is None else [w for w, c in zip(words, cut.tolist(), strict=True) if not c]
        text = b" ".join(stay)
        return len(words), len(words) - len(stay), hashlib.sha256(text).hexdigest() if digest else text.decode()

    def find():
        codes = _Codes()

        def work(part: pa.RecordBatch) -> list:
            texts = texts_of(part)
            lists = part.column(part.schema.get_field_index("k_a"))
            sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
            flat = lists.flatten()  # of the slice's rows, without those of nulls
            places_, shards_, query_ = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("p", "shard", "query"))
            stops = np.cumsum(sizes)
            asked_ = np.flatnonzero(sizes).tolist()
            words, starts, at, places, _ = _anchors([texts[i] for i in asked_], codes, window, gram)
            first = np.searchsorted(at, starts)
            segments: list = [None] * len(texts)
            done = [None if n else finish(t.split(), None) for t, n in zip(texts, sizes.tolist(), strict=True)]
            for j, i in enumerate(asked_):
                own = words[starts[j] : starts[j + 1]]
                p, s, q = (x[stops[i] - sizes[i] : stops[i]] for x in (places_, shards_, query_))
                mine, anchor = at[first[j] : first[j + 1]] - starts[j], places[first[j] : first[j + 1]] - starts[j]
                k = np.minimum(np.searchsorted(p, anchor), len(p) - 1)
                hit = p[k] == anchor
                segments[i] = _segments(own, mine[hit], s[k[hit]], q[k[hit]], window)
                done[i] = (len(own), None, None)
            left = [None if s is None else t.decode() for s, t in zip(segments, texts, strict=True)]
            return [left, segments, *([d[j] for d in done] for j in range(3))]

        return work

    done = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    fields = [T.StructField("k_text", T.StringType()), T.StructField("k_segments", _SEGMENTS), *done]
    found = written(with_columns(rows.join(asked, ["k_doc", "k_row"], "left"), find, fields, keep=[*keep, "k_doc", "k_row"]), "segments")
    parts = found.select("k_doc", "k_row", F.explode("k_segments").alias("s")).select("k_doc", "k_row", "s.*")
    busy = written(parts.groupBy("shard").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("copies")).where("copies > 1"), "busy-shards")
    parts = parts.join(F.broadcast(busy) if busy.count() <= MOST_BUSY else busy, "shard", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    one = F.pmod(F.xxhash64("k_doc", "k_row", "start"), F.col("copies")).cast("int")
    parts = parts.withColumn("copy", F.explode(F.when(F.col("query"), F.array(one)).otherwise(F.sequence(F.lit(0), F.col("copies") - 1))))
    batch_rows(spark, BATCH_ROWS)
    order = parts.select("shard", "copy", "query", "k_doc", "k_row", "start", "asked", "words").repartition("shard", "copy").sortWithinPartitions("shard", "copy", "query", "k_doc", "k_row", "start")
    told = written(order.mapInArrow(lambda b: _stream(b, window), "k_doc long, k_row long, lo int, hi int, h1 long, h2 long"), "told")
    open_ = told.where("h1 is not null")
    earliest = open_.groupBy("h1", "h2").agg(F.min(F.struct("k_doc", "k_row", "lo")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    late = open_.join(earliest, ["h1", "h2"]).where(F.struct("k_doc", "k_row", "lo") > F.col("first")).select("k_doc", "k_row", "lo", "hi")
    spans = told.where("h1 is null").select("k_doc", "k_row", "lo", "hi").unionByName(late)
    spans = spans.groupBy("k_doc", "k_row").agg(F.collect_set(F.struct("lo", "hi")).alias("k_spans"))  # as many as its windows

    def cut():
        def work(part: pa.RecordBatch) -> list:
            got = []
            for text, pairs in zip(texts_of(part, "k_text"), part.column(part.schema.get_field_index("k_spans")).to_pylist(), strict=True):
                words = text.split()
                at = np.concatenate([np.zeros(0, np.int64), *(np.arange(x["lo"], x["hi"] + 1) for x in pairs or ())])
                got.append(finish(words, covered(at, window, len(words))))
            return [[g[j] for g in got] for j in range(3)]

        return work

    searched = found.where("k_text is not null").select(*keep, "k_doc", "k_row", "k_text").join(spans, ["k_doc", "k_row"], "left")
    plain = found.where("k_text is null").select(*keep, "n_words", "n_removed", "kept")
    return plain.unionByName(with_columns(searched, cut, done, keep=keep, text="k_text"))
