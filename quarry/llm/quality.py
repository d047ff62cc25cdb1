"""Quality rules: document statistics, base rules on them, and gradient-boosted trees for the rest.

Statistics are counted over every whole text. The trees learn ``labels.quality`` from a bounded
sample: the MAX_ROWS labelled documents with the smallest hash of their id. Scores never rise with
the share of symbols, repeated lines, repeated words, capitals or exclamation marks.

Null text: no words. Documents with fewer than 20 words, or with over 30 % of their words in
repeated 8-word windows, fail the base rules. Without labels of both kinds the verdict is the base
rules' alone. Labels that disagree for an id count as the smaller. Repeated rows get the same
answer. Other columns pass through; the operator's own columns replace input columns of the same
names. Windows are compared by 64-bit hashes of words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import boosting
from .texts import covered, hashed, rolled, texts_of, window_starts, with_columns, words_of

WINDOW = 8
MAX_ROWS = 20_000  # labelled documents that the trees learn from
KEEP_FROM = 0.5  # probability of good quality
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Feature and the sign in which a score may move with it (0: any).
FEATURES = (("log_words", 0), ("chars_a_word", 0), ("symbols_a_word", -1), ("dup_lines", -1), ("repeated", -1), ("capitals", -1), ("digits", 0), ("marks", -1), ("stops_a_word", 0), ("words_a_line", 0), ("non_ascii", 0))

_FIELDS = [*(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("base_failed", T.BooleanType())]


def _pick(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(chars, np.uint8)).astype(np.int64)


_CLASSES = np.stack([
    _pick(SYMBOLS), _pick(b" \t\n\v\f\r"), _pick(bytes(range(65, 91))), _pick(bytes(range(48, 58))), _pick(b"!"), _pick(b".,;:"),
    ((np.arange(256) < 0x80) | (np.arange(256) >= 0xC0)).astype(np.int64), (np.arange(256) >= 0xC0).astype(np.int64),
], 1)


def statistics(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: the base counts (COUNTS) and the features (FEATURES)."""
    words, starts = words_of(texts)
    n = np.diff(starts)
    codes = rolled(hashed(words), WINDOW)
    at, text = window_starts(starts, WINDOW, len(words))
    keys = rolled_with(codes[at], text)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    repeated = np.add.reduceat(np.r_[covered(at[twice], WINDOW, len(words)).astype(np.int64), 0], starts[:-1]) * (n > 0) if len(texts) else n
    chars = np.zeros((len(texts), _CLASSES.shape[1]), np.int64)
    lines, dups = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        chars[i] = np.bincount(np.frombuffer(t, np.uint8), minlength=256) @ _CLASSES
        own = [x for x in t.split(b"\n") if x.strip()]  # strips the same characters as split() cuts at
        lines[i], dups[i] = len(own), len(own) - len(set(own))
    symbols, blanks, capitals, digits, marks, stops, points, wide = chars.T
    counts = np.stack([n, points - blanks, symbols, dups, repeated], 1)
    w, c = np.maximum(n, 1), np.maximum(points - blanks, 1)
    features = np.stack([np.log1p(n), (points - blanks) / w, symbols / w, dups / np.maximum(lines, 1), repeated / w, capitals / c, digits / c, marks / w, stops / w, n / np.maximum(lines, 1), wide / c], 1)
    return counts, features


def rolled_with(codes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes of windows that differ between texts."""
    return codes ^ (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 20) | (100 * counts[:, 4] > 30 * counts[:, 0])


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> boosting.Trees | None:
    """Trees over a bounded sample of labelled documents; None without both kinds."""
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("k_y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_rows ids

    def make():
        return lambda part: [list(statistics(texts_of(part))[1])]

    got = with_columns(rows, make, [T.StructField("x", T.ArrayType(T.DoubleType()))], keep=["doc_id", "k_y"]).dropDuplicates(["doc_id"]).orderBy("doc_id").limit(max_rows).collect()
    x, y = np.array([r["x"] for r in got]), np.array([r["k_y"] for r in got])
    if len(set(y.tolist())) < 2:
        return None
    return boosting.fit(x, (y > 0).astype(float), np.array([s for _, s in FEATURES]))


def judge(docs: DataFrame, labels: DataFrame | None, model: boosting.Trees | None = None) -> DataFrame:
    """``docs`` (doc_id, text, more) with COUNTS, base_failed, quality_score and kept."""
    model = model or (fit_quality(docs, labels) if labels is not None else None)

    def make():
        def work(part: pa.RecordBatch) -> list:
            counts, features = statistics(texts_of(part))
            failed = base_failed(counts)
            score = model.scores(features) if model else np.ones(len(counts))
            return [*(counts[:, j] for j in range(5)), failed, score, ~failed & (score >= KEEP_FROM)]

        return work

    return with_columns(docs, make, [*_FIELDS, T.StructField("quality_score", T.DoubleType()), T.StructField("kept", T.BooleanType())])
