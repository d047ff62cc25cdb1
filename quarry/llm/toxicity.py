"""Toxicity scores by a bidirectional gated recurrent network over character and word inputs.

Every text is lowered and cut into words; runs of over LONGEST bytes (scripts without spaces) count as
several that overlap by two characters, so that all of their trigrams are seen. All windows of WINDOW
words that start STEP words apart are scored, so neighbours overlap by half and each word of a text
is scored, but for the edges in two contexts. A document's score is a logistic function of its highest
window logit and its windows' mean probability, fitted on the whole training documents.

A word's inputs: how much more often it occurs in toxic training documents than in others (shrunk
log-odds), the same of its character trigrams (highest and mean), and learned embeddings of the
word and of its trigrams. Learning uses the text and ``toxic`` label alone, of labelled documents
whose crc32(doc_id as text) mod 5 is not 0, at most MAX_DOCS of either label (smallest hashes of
their id). That is the only bound: their whole texts are counted and all their windows take part.

Null or wordless text: scored as a document without windows, from the share of toxic training
documents. Without training documents of both labels every score is 0. Labels that disagree for an
id count as the larger. Repeated rows get the same answer. Other columns pass through; the operator's
own columns replace input columns of the same names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import gru
from .texts import texts_of, with_columns

WINDOW, STEP = 32, 16
LONGEST = 64  # bytes of a token
MAX_DOCS = 2_000
WORDS, CHARS, WIDTH = 4096, 1024, 4  # rows and numbers of the embeddings
FIXED = 3  # features besides embeddings
REMEMBERED = 300_000  # words whose inputs a worker keeps

_CRC = np.array([zlib.crc32(bytes([b ^ 255])) ^ 0xFF000000 for b in range(256)], np.uint32)  # of the last byte, with none before it
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 5 == 0


def _back(run: bytes, at: int) -> int:
    """The start of the character that ``at`` is in."""
    least = max(at - 3, 0)
    while at > least and run[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _tokens(run: bytes) -> list[bytes]:
    """A run of letters in tokens of at most LONGEST bytes that overlap by two characters."""
    out, at = [], 0
    while len(run) - at > LONGEST:
        end = _back(run, at + LONGEST)
        out.append(run[at:end])
        at = _back(run, _back(run, end - 1) - 1)
    return [*out, run[at:]]


def words_in(text: bytes) -> list[bytes]:
    runs = text.translate(_TABLE).split()
    if max(map(len, runs), default=0) <= LONGEST:
        return runs
    return [w for run in runs for w in _tokens(run)]


def trigrams(word: bytes) -> list[bytes]:
    w = b"^" + word + b"$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


def trigrams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words' trigrams in a row: each as a number, its crc32; and how many each word has (as many as bytes)."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    text = np.frombuffer(b"^" + b"$^".join(words) + b"$", np.uint8)
    at = np.arange(size.sum()) + 2 * np.repeat(np.arange(len(words)), size)
    code, crc = np.zeros(len(at), np.uint32), np.full(len(at), 0xFFFFFFFF, np.uint32)
    for k in range(3):
        byte = text[at + k]
        code = code << np.uint32(8) | byte
        crc = _CRC[crc.astype(np.uint8) ^ byte] ^ crc >> np.uint32(8)
    return code, ~crc, size


def window_starts(n: int) -> range:
    """Starts of the overlapping windows of n words; together they cover them."""
    return range(0, max(n - WINDOW + STEP, STEP) if n else 0, STEP)


@dataclass
class Model:
    words: dict[bytes, float]  # shrunk log-odds of words and of trigrams
    chars: dict[bytes, float]
    weights: dict[str, np.ndarray]
    final: np.ndarray  # of (highest logit, mean probability, 1)
    empty: float  # score of a text without words
    seen: dict[bytes, int] = field(default_factory=dict)

    def inputs(self, word: bytes) -> tuple[float, ...]:
        """Fixed features, the word's embedding row, then its trigrams' rows."""
        grams = trigrams(word)
        odds = [self.chars.get(g, 0.0) for g in grams]
        return self.words.get(word, 0.0), max(odds), sum(odds) / len(odds), zlib.crc32(word) % WORDS, *(zlib.crc32(g) % CHARS for g in grams)


class Scorer:
    """Scores texts; tables of words' inputs and gates grow as words are met, up to REMEMBERED. Their first row stands for no word."""

    def __init__(self, model: Model):
        self.model, self.row = model, {}
        self.folded = gru.gate_weights(model.weights)
        self.odds = np.zeros(1 << 24, np.float32)  # of all trigrams; pages without any stay unused
        self.odds[[int.from_bytes(g) for g in model.chars]] = list(model.chars.values())
        self.table = np.zeros((1, FIXED + 2 * WIDTH), np.float32)
        self.gates = self.gates_of(self.table)

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """Fixed features and embeddings of each word, as ``Model.inputs`` has them, of all words at once."""
        code, crc, size = trigrams_of(words)
        first, odds, w = np.cumsum(size) - size, self.odds[code], self.model.weights
        x = np.empty((len(words), FIXED + 2 * WIDTH), np.float32)
        x[:, 0] = [self.model.words.get(k, 0.0) for k in words]
        x[:, 1] = np.maximum.reduceat(odds, first)
        x[:, 2] = np.add.reduceat(odds, first, dtype=np.float64) / size
        x[:, FIXED : FIXED + WIDTH] = w["words"][np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % WORDS]
        x[:, FIXED + WIDTH :] = np.add.reduceat(w["chars"][crc % np.uint32(CHARS)], first) / size[:, None]
        return x

    def gates_of(self, inputs: np.ndarray) -> np.ndarray:
        return inputs @ self.folded[0][:-1] + self.folded[0][-1]

    def rows_of(self, words: list[bytes]) -> np.ndarray:
        if len(self.row) > REMEMBERED:
            self.row = {}
        got = list(map(self.row.get, words))
        if None in got:
            new = list(dict.fromkeys(w for w, r in zip(words, got, strict=True) if r is None))
            n, end, x = len(self.row) + 1, len(self.row) + 1 + len(new), self.inputs(new)
            if end > len(self.table):  # they double, so that rows are seldom copied
                self.table, self.gates = (np.concatenate([t[:n], np.empty((2 * end - n, t.shape[1]), np.float32)]) for t in (self.table, self.gates))
            self.table[n:end], self.gates[n:end] = x, self.gates_of(x)
            self.row.update(zip(new, range(n, end), strict=True))
            got = list(map(self.row.__getitem__, words))
        return np.array(got, np.int64)

    def pooled(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(highest logit, mean probability, 1) of each text, and its number of windows."""
        words = [words_in(t) for t in texts]
        sizes = np.array([len(x) for x in words], np.int64)
        blocks = -(-sizes // STEP)
        counts = np.where(sizes > 0, np.maximum(blocks - 1, 1), 0)  # as many as window_starts has
        first = np.cumsum(blocks) - blocks
        at = np.arange(sizes.sum()) + np.repeat(first * STEP - np.cumsum(sizes) + sizes, sizes)
        placed = np.zeros((int(blocks.sum()) + 1) * STEP, np.int64)
        placed[at] = self.rows_of([w for x in words for w in x])
        placed = placed.reshape(-1, STEP)
        filled = np.full(len(placed), STEP, np.int64)
        filled[-1] = 0
        has = sizes > 0
        filled[(first + blocks - 1)[has]] = sizes[has] - STEP * (blocks[has] - 1)
        more = np.ones(len(placed) - 1, bool)
        more[(first + blocks - 1)[has]] = False
        every = np.zeros(len(placed) - 1, np.float32)
        for k in range(0, len(every), gru.CHUNK):
            part = slice(k, k + gru.CHUNK + 1)
            every[k : k + gru.CHUNK] = gru.half_overlapping(self.model.weights, self.folded, self.gates[placed[part]], filled[part], more[k : k + gru.CHUNK])
        last = np.zeros(len(every), bool)  # a text's last block starts no window, unless it is its only one
        last[(first + blocks - 1)[blocks > 1]] = True
        logits = every[~last]
        out = np.zeros((len(texts), 3))
        full = counts > 0
        if full.any():
            at = (np.cumsum(counts) - counts)[full]
            out[full] = np.stack([np.maximum.reduceat(logits, at), np.add.reduceat(1 / (1 + np.exp(-logits.astype(np.float64))), at) / counts[full], np.ones(full.sum())], 1)
        return out, counts

    def scores(self, texts: list[bytes]) -> np.ndarray:
        x, counts = self.pooled(texts)
        return np.where(counts > 0, 1 / (1 + np.exp(-(x @ self.model.final))), self.model.empty)


def _odds(toxic: Counter, clean: Counter, a: int, b: int, least: int = 3, shrink: float = 12.0) -> dict[bytes, float]:
    out = {}
    for w, n in toxic.items():
        m = clean.get(w, 0)
        if n + m >= least:
            odds = float(np.log((n + 0.5) / (a + 1)) - np.log((m + 0.5) / (b + 1))) * (n + m) / (n + m + shrink)
            if odds > 0.3:
                out[w] = min(odds, 4.0)
    return out


class _Lookup:
    """Inputs of the training words, by number; the last number stands for no word."""

    def __init__(self, model: Model, vocabulary: list[bytes]):
        found = [model.inputs(w) for w in vocabulary]
        self.fixed = np.array([x[:FIXED] for x in found] + [(0.0,) * FIXED], np.float32)
        self.word = np.array([x[FIXED] for x in found] + [0], np.int64)
        grams = [x[FIXED + 1 :] for x in found] + [(0,)]
        self.size = np.array([len(g) for g in grams], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.grams = np.array([g for x in grams for g in x], np.int64)

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words ``ids``: places of their trigrams' rows, whose each is, and its share of the mean."""
        size = self.size[ids]
        at = np.repeat(self.first[ids] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return self.grams[at], np.repeat(np.arange(len(ids)), size), np.repeat(1 / size, size).astype(np.float32)[:, None]


def _window_weights(model: Model, windows: list[list[bytes]], toxic: bool) -> np.ndarray:
    """How often each window of a document is learned from; they sum to 1.

    A toxic document's label is right for its windows with the most telling words. Of others such
    windows are half of what is learned, and all alike the other half.
    """
    telling = np.array([sum(sorted((model.words.get(w, 0.0) for w in x), reverse=True)[:3]) for x in windows])
    weight = np.exp(telling - telling.max())
    weight /= weight.sum()
    return weight if toxic else 0.5 * weight + 0.5 / len(windows)


def train(docs: list[tuple[int, list[bytes]]], epochs: int = 4, draws: int = 4, batch: int = 256, seed: int = 7) -> Model | None:
    """``docs``: (label, words) of each training document, in a fixed order.

    Words of whole documents are counted. A batch draws from all windows of all documents by their
    weights, ``draws`` a document and epoch on average.
    """
    labels = np.array([y for y, _ in docs])
    if len(set(labels.tolist())) < 2:
        return None
    counts = [[Counter(), Counter()] for _ in range(2)]
    for y, words in docs:
        distinct = set(words)
        counts[0][y].update(distinct)
        counts[1][y].update({g for w in distinct for g in trigrams(w)})
    a, b = int(labels.sum()), int((1 - labels).sum())
    model = Model(_odds(counts[0][1], counts[0][0], a, b), _odds(counts[1][1], counts[1][0], a, b), gru.new(FIXED, WORDS, CHARS, WIDTH, seed), np.array([1.0, 0.0, 0.0]), a / len(docs))
    number = {w: i for i, w in enumerate(sorted({w for _, x in docs for w in x}))}
    look, none = _Lookup(model, list(number)), len(number)
    places, target, weight = [], [], []
    for y, words in docs:
        windows = [words[s : s + WINDOW] for s in window_starts(len(words))]
        if windows:
            ids = np.array([number[w] for w in words] + [none] * WINDOW, np.int64)
            places.append(np.stack([np.where(np.arange(WINDOW) < len(words) - s, ids[s : s + WINDOW], none) for s in window_starts(len(words))]))
            target.append(np.full(len(windows), y, np.float32))
            weight.append(_window_weights(model, windows, bool(y)) * (0.5 / a if y else 0.5 / b))
    if not places:
        return model
    places, target, weight = np.concatenate(places), np.concatenate(target), np.concatenate(weight)
    rng = np.random.default_rng(seed)
    adam = gru.Adam(model.weights, 0.01)
    for _ in range(epochs * max(1, draws * len(docs) // batch)):
        rows = rng.choice(len(places), batch, p=weight / weight.sum())
        used, at = np.unique(places[rows].T, return_inverse=True)
        at = at.reshape(WINDOW, batch)
        gram, own, share = look.of(used)
        mean = np.zeros((len(used), WIDTH), np.float32)
        np.add.at(mean, own, model.weights["chars"][gram] * share)
        there = (used != none)[at][..., None].astype(np.float32)
        x = np.concatenate([look.fixed[used], model.weights["words"][look.word[used]], mean], 1)[at] * there
        logit, saved = gru.forward(model.weights, x, there, keep=True)
        g = ((1 / (1 + np.exp(-logit)) - target[rows]) / batch).astype(np.float32)
        grads, dx = gru.backward(model.weights, saved, g)
        dx = (dx * there).reshape(-1, dx.shape[2])
        order = np.argsort(at, axis=None, kind="stable")
        dx = np.add.reduceat(dx[order], np.searchsorted(at.ravel()[order], np.arange(len(used))))
        grads["words"], grads["chars"] = np.zeros_like(model.weights["words"]), np.zeros_like(model.weights["chars"])
        np.add.at(grads["words"], look.word[used], dx[:, FIXED : FIXED + WIDTH])
        np.add.at(grads["chars"], gram, dx[own, FIXED + WIDTH :] * share)
        adam.update(grads)
    scorer = Scorer(model)
    x, w = np.concatenate([scorer.pooled([b" ".join(words)])[0] for _, words in docs]), np.zeros(3)
    x[:, 2] = 1.0
    for _ in range(50):  # Newton's steps of a ridged logistic regression
        p = 1 / (1 + np.exp(-(x @ w)))
        grad = x.T @ (p - labels) + 0.5 * w * [1, 1, 0]
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag([0.5, 0.5, 1e-6]), grad)
    model.final = w
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Model | None:
    """A model from a bounded sample of the labelled documents that aren't held out."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("k_y"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = known.where("k_y > 0").orderBy(*order).limit(max_docs).union(known.where("k_y <= 0").orderBy(*order).limit(max_docs))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * max_docs ids

    def make():
        return lambda part: [[b" ".join(words_in(t)) for t in texts_of(part)]]

    got = with_columns(rows, make, [T.StructField("k_words", T.BinaryType())], keep=["doc_id", "k_y"]).dropDuplicates(["doc_id"]).orderBy("doc_id").limit(2 * max_docs).collect()
    return train([(int(r["k_y"] > 0), bytes(r["k_words"]).split()) for r in got])


def score_toxicity(docs: DataFrame, labels: DataFrame | None, model: Model | None = None) -> DataFrame:
    """``docs`` (doc_id, text, more) with held_out, score and predicted."""
    model = model or (fit_toxicity(docs, labels) if labels is not None else None)

    def make():
        scorer = Scorer(model) if model else None

        def work(part: pa.RecordBatch) -> list:
            texts = texts_of(part)
            score = scorer.scores(texts) if scorer else np.zeros(len(texts))
            return [score, (score >= 0.5).astype(np.int32)]

        return work

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return with_columns(docs, make, fields).withColumn("held_out", held_out(F.col("doc_id")))
