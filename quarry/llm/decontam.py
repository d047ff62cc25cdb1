"""Benchmark decontamination with a distributed positional inverted index.

The index holds postings of all training words. It is partitioned by documents: a task numbers the
words of a block of documents (about BLOCK_BYTES of text, or one longer text) one after another,
with GAP empty places between documents, and writes one row for each of the block's terms with its
ascending places. No list is longer than its block, so frequent words need no task of their own.

Phrases are looked up from the term that is rarest in the training table. A join finds the blocks
that have it; in each of them its places, shifted by the term's offset, are candidate starts, which
are intersected with the shifted lists of the other terms, rarer ones first. Proximity matches
intersect lists on nearness instead. Phrases reach blocks by joins; nothing is collected. Up to MOST_TERMS
words of phrases are broadcast, so that other words' lists stay where they are; with more, all lists go to their blocks.

Words: A-Z lowered, runs of ASCII letters and digits and of all characters beyond ASCII. A phrase is
10 consecutive words of an item, or all words of a shorter one. Null text or item: no words.
Repeated rows are judged each. Empty tables give no hits or no rows. Null item ids are not named or
counted as items, but their words count as hit. Other columns pass through; the operator's own
columns replace input columns of the same names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import batch_rows, condensed, picked, spread_join, written
from .texts import BATCH_ROWS, slices, texts_of

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASE = 10
NEAR = 16  # words from a phrase's rarest term in which a proximity match has all its other terms
GAP = 64  # empty places between documents; more than any distance that is asked
BLOCK_BYTES = 32_000_000
MOST_TERMS = 200_000  # distinct words of phrases that are broadcast
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OWN = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near_items")

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_INDEX = [T.StructField("k_row", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("k_block", T.LongType()), T.StructField("k_term", T.StringType()), T.StructField("k_count", T.LongType()), T.StructField("k_places", T.BinaryType())]


def item_words(text: Column) -> Column:
    """The words of a text as an array, by built-in functions."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"({WORDS})"), 1)


def phrases_of(items: DataFrame, size: int = PHRASE) -> DataFrame:
    """phrase (its words, space-joined), n, terms, item_id: distinct. ``items``: item_id, text."""
    words = items.select("item_id", item_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(size))
    starts = F.sequence(F.lit(1), F.size("w") - n + 1)
    each = words.select("item_id", n.alias("n"), F.explode(F.transform(starts, lambda i: F.slice("w", i, n))).alias("terms"))
    return each.select(F.array_join("terms", " ").alias("phrase"), "n", "terms", "item_id").distinct()


class _Block:
    """Words of the documents of one block, as numbers of its terms."""

    def __init__(self, first: int):
        self.first, self.terms, self.ids, self.counts, self.size = first, {}, [], [], 0

    def add(self, texts: list[bytes]) -> None:
        each = [t.translate(_TABLE).split() for t in texts]
        for w in {w for x in each for w in x}.difference(self.terms):
            self.terms[w] = len(self.terms)
        self.counts += map(len, each)
        self.ids.append(np.fromiter((self.terms[w] for x in each for w in x), np.int32, sum(map(len, each))))
        self.size += sum(map(len, texts))

    def postings(self) -> pa.RecordBatch:
        """Rows of the terms, and one of no term with the documents' first places."""
        counts = np.array(self.counts, np.int64)
        bases = np.cumsum(counts + GAP) - counts - GAP
        ids = np.concatenate(self.ids)
        places = np.arange(len(ids)) + np.repeat(np.arange(len(counts)) * GAP, counts)
        order = np.argsort(ids, kind="stable")
        sizes = np.r_[len(bases), np.bincount(ids, minlength=len(self.terms))] if len(ids) else np.array([len(bases)])
        starts = np.cumsum(sizes) - sizes
        steps = np.diff(np.r_[bases, places[order]], prepend=0)  # a list is kept as its first place and steps
        steps[starts] = np.r_[bases, places[order]][starts]
        offsets = np.r_[starts, starts[-1] + sizes[-1]].astype(np.int32) * 4
        lists = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(steps.astype("<u4"))])
        names = pa.array([None, *(w.decode() for w in self.terms)], pa.string())
        return pa.RecordBatch.from_arrays([pa.array([self.first] * len(sizes), pa.int64()), names, pa.array(sizes, pa.int64()), lists], names=["k_block", "k_term", "k_count", "k_places"])


def _unpacked(steps: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps, "<u4").astype(np.int64))


def indexed_rows(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The index and its documents as one table, written once.

    A document's row has ``keep``, k_row and n_words; a posting list's k_block (the k_row of the
    block's first document), k_term (null: the documents' first places), k_count and k_places. The rest is null.
    """
    batch_rows(docs.sparkSession, BATCH_ROWS)
    kept = [f for f in docs.select(*keep).schema.fields]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in kept] + _INDEX)
    extra = [] if "text" in keep else ["text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        names = to_arrow_schema(schema)
        row = TaskContext.get().partitionId() << 33
        block = None

        def rows(found: pa.RecordBatch) -> pa.RecordBatch:
            have = set(found.schema.names)
            return pa.RecordBatch.from_arrays([found.column(f.name).cast(f.type) if f.name in have else pa.nulls(found.num_rows, f.type) for f in names], schema=names)

        for batch in batches:
            for part in slices(batch):
                block = block or _Block(row)
                block.add(texts_of(part))
                own = {f.name: part.column(part.schema.get_field_index(f.name)) for f in kept}
                own |= {"k_row": pa.array(np.arange(row, row + part.num_rows)), "n_words": pa.array(block.counts[-part.num_rows :], pa.int64())}
                yield rows(pa.RecordBatch.from_pydict(own))
                row += part.num_rows
                if block.size >= BLOCK_BYTES:
                    yield rows(block.postings())
                    block = None
        if block:
            yield rows(block.postings())

    return written(docs.select(*keep, *extra).mapInArrow(run, schema), "index")


def build_index(rows: DataFrame) -> DataFrame:
    """The posting lists of ``indexed_rows``: k_block, term, n, places."""
    return rows.where("k_block is not null").selectExpr("k_block", "k_term term", "k_count n", "k_places places")


def rarest_first(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """phrase, term (its rarest in the index) and k_order: offsets of its terms, rarest first.

    Phrases with a term that the index lacks are gone. ``phrases``: phrase, terms.
    """
    terms = phrases.select("phrase", "terms").distinct().select("phrase", F.posexplode("terms").alias("offset", "term"))
    df = index.where("term is not null").groupBy("term").agg(F.sum("n").alias("df"))
    known = spread_join(terms, df, "term", ["phrase", "offset"], "left")  # a word of very many phrases is dealt
    ranked = known.groupBy("phrase").agg(F.sort_array(F.collect_list(F.struct("df", "offset", "term"))).alias("t"), F.count("*").alias("n"), F.count("df").alias("k"))  # n terms
    return ranked.where("k = n").select("phrase", F.col("t")[0]["term"].alias("term"), F.array_join(F.transform("t", lambda x: x["offset"].cast("string")), " ").alias("k_order"))


def _looked_up(batches: Iterator[pa.RecordBatch], within: int | None) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block, posting lists first. Yields exact matches, and with ``within`` near ones."""
    block, lists, out = None, {}, []

    def places(term: str | None) -> np.ndarray:
        got = lists[term]
        if isinstance(got, bytes):
            got = lists[term] = _unpacked(got)
        return got

    def survivors(words: list[str], offsets: list[int], within: int | None) -> np.ndarray:
        """Starts of exact matches, or places of the rarest term that have all others near."""
        at = places(words[offsets[0]])
        if within is None:
            at = at - offsets[0]
            at = at[at >= 0]
        for o in offsets[1:]:
            if not len(at) or words[o] not in lists:
                return at[:0]
            own = places(words[o])
            asked = at + o if within is None else at - within
            there = own[np.minimum(np.searchsorted(own, asked), len(own) - 1)]
            at = at[there == asked if within is None else (there >= asked) & (there <= at + within)]
        return at

    def told() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
        made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["phrase", "n", "k_row", "start", "near"])
        out.clear()
        return made

    for batch in batches:
        for b, term, found, phrase, order in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != block:
                block, lists = b, {}
            if phrase is None:
                lists[term] = found
                continue
            words, offsets = phrase.split(" "), [int(x) for x in order.split(" ")]
            for distance in (None,) if within is None else (None, within):
                at = survivors(words, offsets, distance)
                if len(at):
                    bases = places(None)
                    doc = np.searchsorted(bases, at, "right") - 1
                    out += [(phrase, len(words), b + d, p, distance is not None) for d, p in zip(doc.tolist(), (at - bases[doc]).tolist(), strict=True)]
            if len(out) > 20_000:
                yield told()
    yield told()


def asked_lists(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """The terms' lists of ``index``: those of the phrases' words, or all where these are too many to broadcast."""
    lists = index.where("term is not null")
    terms = written(phrases.select(F.explode("terms").alias("term")).distinct(), "phrase-words")
    return lists.join(F.broadcast(terms), "term", "left_semi") if terms.count() <= MOST_TERMS else lists


def lookup(index: DataFrame, phrases: DataFrame, within: int | None = None) -> DataFrame:
    """phrase, n, k_row, start, near: exact matches, and places with a phrase's terms near each other.

    ``phrases``: phrase, terms. ``within`` is less than GAP.
    """
    lists = asked_lists(index, phrases)
    ranked = written(rarest_first(lists, phrases), "phrase-terms")
    asked = spread_join(lists.select("term", "k_block"), ranked, "term", ["k_block"])
    wanted = lists.unionByName(index.where("term is null")).select("term", "k_block", "places")
    both = wanted.unionByName(asked.select("k_block", "phrase", "k_order"), allowMissingColumns=True)
    batch_rows(index.sparkSession, BATCH_ROWS)
    sent = both.select("k_block", "term", "places", "phrase", "k_order").repartition("k_block").sortWithinPartitions("k_block", F.col("phrase").asc_nulls_first())
    return sent.mapInArrow(lambda b: _looked_up(b, within), "phrase string, n int, k_row long, start long, near boolean")


def phrase_matches(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """Exact matches: phrase, n, k_row, start (words before it)."""
    return lookup(index, phrases).select("phrase", "n", "k_row", "start")


def proximity_matches(index: DataFrame, phrases: DataFrame, within: int) -> DataFrame:
    """phrase, k_row, pos: places of a phrase's rarest term with all its terms at most ``within`` words away."""
    return lookup(index, phrases, within).where("near").select("phrase", "k_row", F.col("start").alias("pos"))


def contamination(docs: DataFrame, items: DataFrame, keep: list[str] | None = None, size: int = PHRASE, near: int | None = NEAR) -> DataFrame:
    """``docs`` (text, more), or their columns ``keep``, with n_words, n_hit, n_items, items_sha256, contaminated, n_near_items.

    n_near_items: items with a phrase all of whose words lie within ``near`` words of its rarest one,
    in any order (0 where ``near`` is None).
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in OWN]
    phrases = written(phrases_of(items, size), "phrases")
    rows = indexed_rows(docs, keep)
    matches = written(lookup(build_index(rows), phrases.select("phrase", "terms"), near), "matches")
    before = F.max(F.col("start") + F.col("n")).over(W.partitionBy("k_row").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    spans = matches.where("not near").groupBy("k_row", "start").agg(F.max("n").alias("n")).withColumn("k_new", F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest(F.col("start"), F.coalesce(before, F.col("start")))))
    hits = spans.groupBy("k_row").agg(F.sum("k_new").cast("long").alias("n_hit"))
    named = spread_join(matches.select("k_row", "phrase", "near").distinct(), phrases.select("phrase", "item_id"), "phrase", ["k_row"])
    item = lambda kind: F.collect_set(F.when(kind, F.col("item_id").cast("string")))  # noqa: E731  # at most all items
    named = named.groupBy("k_row").agg(item(~F.col("near")).alias("k_items"), item(F.col("near")).alias("k_near"))
    out = rows.where("k_row is not null").select(*keep, "k_row", "n_words").join(hits, "k_row", "left").join(named, "k_row", "left")
    none = F.array().cast("array<string>")
    return out.select(
        *(F.col(f"`{c}`") for c in keep), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("k_items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.coalesce("k_items", none)), ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), F.size(F.coalesce("k_near", none)).cast("long").alias("n_near_items"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = PHRASE) -> DataFrame:
    """``docs`` without the rows that hold a test phrase. Rows are told by their texts' SHA-256, so that no text is written or exchanged."""
    name = F.unhex(F.sha2("text", 256))

    def found() -> DataFrame:
        judged = contamination(docs.select(name.alias("k_text"), "text"), items, ["k_text"], size, None)
        return written(judged.where("contaminated").select("k_text").distinct(), "contaminated-texts")

    texts = condensed(found)
    return picked(docs, texts, name == texts["k_text"], "left_anti")
