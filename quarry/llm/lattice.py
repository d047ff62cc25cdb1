"""Language-model scores of texts: the marginal likelihood of a word's subword lattice.

Pieces and their first scores come from a public subword vocabulary file; its scores are merge ranks, which
Zipf's law turns into probabilities. Every segmentation of a word (with the space before it) into pieces and
single bytes is a path of a lattice over the word's bytes, and the forward recursion in log space sums the
paths' probabilities. ``ROUNDS`` rounds of expectation maximisation fit the pieces' probabilities to the
training words: a forward and backward pass gives each piece's expected count, which Spark adds up over all
distinct words with their counts; only a row for each piece of the vocabulary reaches the driver. A text's
score is the sum over its words, and an end.

The corpus is first reduced to a table of its distinct words with their counts. Words so frequent that at
most ``FREQUENT`` can be (more than one in ``FREQUENT`` tokens) are scored where the texts are read, from a
broadcast table of that size; all others meet their counts and lattice scores in a join, in which by that
bound no word is hot.

Null texts count as empty, and an empty text has the end alone; null ids train. Rows with equal ids are scored
each. Without training rows counts are zero and the vocabulary's own scores hold. An empty table stays empty.
Other columns pass through; the operator's own replace those of the same names.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .texts import slices, texts_of, with_columns

FREQUENT = 200_000
ROUNDS = 3
PRIOR = 100.0  # pieces that the vocabulary's own scores count as in each round
ZIPF_SHIFT = 10.0  # of ranks, as in Mandelbrot's form of the law
LONG_KEY = 40  # bytes; longer words are joined by a digest
HELD_COUNT = 400_000  # distinct words counted at once in a task
LATTICE_WORDS = 50_000  # taken together in a task
LATTICE_CELLS = 4_000_000
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
OWN = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
LN10 = math.log(10)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 7 == 2


def words(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def key_of(word: bytes) -> bytes:
    """A word as joined: itself, or a space and a digest of it; no word holds a space."""
    return word if len(word) <= LONG_KEY else b" " + hashlib.md5(word).digest()


class Vocabulary:
    """Pieces of a file as bytes (a leading word mark as a space), in a trie, with their prior log probabilities.

    Ids: the file's usable pieces, then the 256 single bytes, then the end.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        file = SentencePieceProcessor(model_file=path)
        ranked: dict[bytes, float] = {}
        for i in range(file.get_piece_size()):
            piece = file.id_to_piece(i)
            if file.is_control(i) or file.is_unknown(i) or file.is_byte(i) or file.is_unused(i) or "▁" in piece[1:]:
                continue
            found = piece.replace("▁", " ").encode()
            if found.translate(LOWER) == found and len((found + b".").split()) == 1:
                ranked[found] = -file.get_score(i)
        self.pieces = sorted(ranked, key=lambda p: (ranked[p], p))
        self.bytes_at, self.end = len(self.pieces), len(self.pieces) + 256
        last = max(ranked.values())
        weight = np.array([1 / (ranked[p] + ZIPF_SHIFT) for p in self.pieces] + [1 / (last + ZIPF_SHIFT)] * 256 + [1 / ZIPF_SHIFT])
        self.prior = weight / weight.sum()
        letters = sorted({b for p in self.pieces for b in p})
        self.letter = np.zeros(256, np.int64)  # 0: in no piece
        self.letter[letters] = np.arange(1, len(letters) + 1)
        nodes: list[dict[int, int]] = [{}, {}]  # 0: nowhere, 1: the root
        ends = [-1, -1]
        for i, piece in enumerate(self.pieces):
            at = 1
            for b in piece:
                if b not in nodes[at]:
                    nodes[at][b] = len(nodes)
                    nodes.append({})
                    ends.append(-1)
                at = nodes[at][b]
            ends[at] = i
        self.next = np.zeros((len(nodes), len(letters) + 1), np.uint16 if len(nodes) < 65536 else np.int32)
        for at, arcs in enumerate(nodes):
            for b, to in arcs.items():
                self.next[at, self.letter[b]] = to
        self.ends = np.array(ends)

    def arcs(self, raw: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """Of words of one length (rows of bytes): from, to, the words, their pieces; ascending by the first."""
        code, length, every = self.letter[raw], raw.shape[1], np.arange(len(raw))
        out = []
        for i in range(length):
            out.append((i, i + 1, every, self.bytes_at + raw[:, i].astype(np.int64)))
            at, j = every, i
            state = self.next[1, code[:, i]]
            while True:
                alive = np.flatnonzero(state)
                if not len(alive):
                    break
                at, state, j = at[alive], state[alive], j + 1
                piece = self.ends[state]
                whole = np.flatnonzero(piece >= 0)
                if len(whole):
                    out.append((i, j, at[whole], piece[whole]))
                if j == length:
                    break
                state = self.next[state, code[at, j]]
        return out

    def forward(self, raw: np.ndarray, score: np.ndarray, arcs: list | None = None) -> np.ndarray:
        """Log probabilities of the words' prefixes, by length."""
        alpha = np.full((raw.shape[1] + 1, len(raw)), -np.inf)
        alpha[0] = 0
        for i, j, at, piece in self.arcs(raw) if arcs is None else arcs:
            alpha[j, at] = np.logaddexp(alpha[j, at], alpha[i, at] + score[piece])
        return alpha

    def expected(self, raw: np.ndarray, counts: np.ndarray, score: np.ndarray, total: np.ndarray) -> None:
        """Adds the pieces' expected counts over all segmentations of words met ``counts`` times to ``total``."""
        arcs = self.arcs(raw)
        alpha = self.forward(raw, score, arcs)
        beta = np.full_like(alpha, -np.inf)
        beta[-1] = 0
        for i, j, at, piece in reversed(arcs):
            onward = score[piece] + beta[j, at]
            beta[i, at] = np.logaddexp(beta[i, at], onward)
            total += np.bincount(piece, counts[at] * np.exp(alpha[i, at] + onward - alpha[-1, at]), len(total))


@cache
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary a Python worker and file; it stays for the worker's later tasks."""
    return Vocabulary(path)


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and bytes (a space before each) of words of one length, few enough at a time."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(pc.binary_length(column)).astype(np.int64)
    starts = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column)].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    order = np.argsort(sizes, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        if not len(group):
            continue
        size = int(sizes[group[0]])
        step = max(1, LATTICE_CELLS // (size + 1))
        for a in range(0, len(group), step):
            at = group[a : a + step]
            raw = np.full((len(at), size + 1), 32, np.uint8)
            raw[:, 1:] = data[starts[at][:, None] + np.arange(size)]
            yield at, raw


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= LATTICE_WORDS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def word_counts(docs: DataFrame) -> DataFrame:
    """word (bytes), c (in training texts), n (in all) of every distinct word of ``docs`` (doc_id, text); written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        kept: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            every = list(seen)
            for a in range(0, len(every), 100_000):
                part = every[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([seen[w] - kept[w] for w in part], pa.int64()), pa.array([seen[w] for w in part], pa.int64())], names=["word", "c", "n"])

        for batch in batches:
            for part in slices(batch):
                for text, held in zip(texts_of(part), part.column("held_out").to_pylist(), strict=True):
                    found = words(text)
                    seen.update(found)
                    if held:
                        kept.update(found)
                if len(seen) > HELD_COUNT:
                    yield from out()
                    seen.clear()
                    kept.clear()
        yield from out()

    counted = docs.select("text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(run, "word binary, c long, n long")
    return written(counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "word-counts")


def expected_counts(train: DataFrame, path: str, score: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces over ``train`` (word, c): one job, a row for each piece and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        total = np.zeros(len(score))
        for part in _gathered(batches):
            counts = np.asarray(part.column("c").combine_chunks()).astype(float)
            for at, raw in by_length(part.column("word")):
                vocab.expected(raw, counts[at], score, total)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met])], names=["piece", "expected"])

    out = np.zeros(len(score))
    for piece, expected in train.select("word", "c").mapInArrow(run, "piece int, expected double").groupBy("piece").agg(F.sum("expected")).collect():
        out[piece] = expected
    return out


def fit_scores(counts: DataFrame, train_texts: int, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the pieces, the bytes and the end, after ``rounds`` of expectation maximisation."""
    vocab = vocabulary(path)
    score = np.log(vocab.prior)
    if not train_texts:
        return score
    for _ in range(rounds):
        expected = expected_counts(counts.where("c > 0"), path, score)
        expected[vocab.end] = train_texts
        score = np.log((expected + PRIOR * vocab.prior) / (expected.sum() + PRIOR))
    return score


def lattice_scores(counts: DataFrame, path: str, score: np.ndarray) -> DataFrame:
    """``counts`` (word, c, n) as key, c, n, lattice (log10 probability); written."""
    length = F.octet_length("word")
    keyed = counts.withColumn("key", F.when(length <= LONG_KEY, F.col("word")).otherwise(F.concat(F.lit(b" "), F.unhex(F.md5("word")))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for part in _gathered(batches):
            found = np.zeros(part.num_rows)
            for at, raw in by_length(part.column("word")):
                found[at] = vocab.forward(raw, score)[-1] / LN10
            yield from part.select(["key", "c", "n"]).append_column("lattice", pa.array(found)).to_batches()

    return written(keyed.mapInArrow(run, "key binary, c long, n long, lattice double"), "word-scores")


def score_texts(docs: DataFrame, path: str, rounds: int = ROUNDS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (doc_id, text, more), or their columns ``keep``, with held_out, n_tokens, n_known, train_tokens, base_score and score.

    base_score: add-one unigram probabilities of whole words. score: of the subword lattice.
    """
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c not in OWN]
    counts = word_counts(docs.select("doc_id", "text"))
    sums = counts.agg(F.sum("c").alias("c"), F.sum("n").alias("n"), F.sum(F.when(F.col("c") > 0, 1)).alias("v")).first()
    train_texts = docs.where(~held_out(F.col("doc_id"))).count()
    tokens, distinct = (sums["c"] or 0) + train_texts, (sums["v"] or 0) + (train_texts > 0)
    score = fit_scores(counts, train_texts, path, rounds)
    scored = lattice_scores(counts, path, score)
    hot = scored.where(F.col("n") * FREQUENT > (sums["n"] or 0)).select("key", "c", "lattice").toArrow()  # under FREQUENT rows
    hot = spark.sparkContext.broadcast({k: (math.log10(c + 1), x, c > 0) for k, c, x in zip(*(c.to_pylist() for c in hot.columns), strict=True)})

    def make() -> Callable[[pa.RecordBatch], list]:
        known = hot.value

        def run(part: pa.RecordBatch) -> list:
            n_tokens, n_known, base, lattice, keys, times, ends = [], [], [], [], [], [], [0]
            for text in texts_of(part):
                found = words(text)
                k, b, s = 0, [], []
                for word, n in Counter(found).items():
                    got = known.get(word if len(word) <= LONG_KEY else key_of(word))
                    if got is None:
                        keys.append(word if len(word) <= LONG_KEY else key_of(word))
                        times.append(n)
                    else:
                        b.append(n * got[0])
                        s.append(n * got[1])
                        k += n * got[2]
                n_tokens.append(len(found) + 1)
                n_known.append(k)
                base.append(math.fsum(b))
                lattice.append(math.fsum(s))
                ends.append(len(keys))
            offsets = pa.array(ends, pa.int32())
            return [n_tokens, n_known, base, lattice, pa.ListArray.from_arrays(offsets, pa.array(keys, pa.binary())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))]

        return run

    fields = [T.StructField(*f) for f in (("n_tokens", T.LongType()), ("k_known", T.LongType()), ("k_base", T.DoubleType()), ("k_lattice", T.DoubleType()), ("k_keys", T.ArrayType(T.BinaryType())), ("k_times", T.ArrayType(T.IntegerType())))]
    stay = [*keep, "k_held"]
    rows = with_columns(docs.withColumn("k_held", held_out(F.col("doc_id"))), make, fields, keep=stay)
    rows = written(rows.withColumn("k_row", F.monotonically_increasing_id()), "text-words")
    rare = rows.select("k_row", F.explode(F.arrays_zip("k_keys", "k_times")).alias("k")).select("k_row", F.col("k.k_keys").alias("key"), F.col("k.k_times").alias("k_n"))
    rare = rare.join(scored.select("key", "c", "lattice"), "key").groupBy("k_row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("k_n"))).alias("k_more_known"), F.sum(F.col("k_n") * F.log10(F.col("c") + 1)).alias("k_more_base"), F.sum(F.col("k_n") * F.col("lattice")).alias("k_more_lattice")
    )
    rows = rows.drop("k_keys", "k_times").join(rare, "k_row", "left")
    both = lambda c: F.col(f"k_{c}") + F.coalesce(F.col(f"k_more_{c}"), F.lit(0))
    end_base, end_lattice = math.log10(train_texts + 1), float(score[vocabulary(path).end]) / LN10
    return rows.select(
        *(F.col(f"`{c}`") for c in keep), F.col("k_held").alias("held_out"), "n_tokens",
        (both("known") + F.lit(int(train_texts > 0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (both("base") + end_base - F.col("n_tokens") * math.log10(tokens + distinct + 1)).alias("base_score"),
        (both("lattice") + end_lattice).alias("score"),
    )
