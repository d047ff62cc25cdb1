"""A linear-chain conditional random field over three tags, in numpy.

A token is described by a key (a tuple of features); its score for a tag sums weights of its own,
its left and its right neighbour's features and of features of the whole file.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

OUT, BEGIN, INSIDE = 0, 1, 2
TAGS = 3
NEVER = -1e4


@dataclass
class Chain:
    """weights: own, left and right features by tag; file features by tag; moves between tags."""

    features: dict[str, int]
    own: np.ndarray
    left: np.ndarray
    right: np.ndarray
    file: np.ndarray
    moves: np.ndarray

    def rows(self, keys: list[tuple[str, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores (own, left, right) that each key brings."""
        x = one_hot(keys, self.features)
        return x @ self.own, x @ self.left, x @ self.right

    @property
    def slack(self) -> float:
        """What a pair of moves can gain at most over staying outside."""
        return 2 * max(0.0, float(self.moves.max() - self.moves[OUT, OUT]))


def one_hot(keys: list[tuple[str, ...]], features: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(keys), len(features)))
    for i, key in enumerate(keys):
        for f in key:
            if f in features:
                x[i, features[f]] = 1
    return x


def fit(keys: list[tuple[str, ...]], tokens: np.ndarray, files: np.ndarray, tags: np.ndarray, lengths: np.ndarray, n_files: int, rounds: int = 60, rate: float = 0.15, ridge: float = 1e-3) -> Chain:
    """tokens, tags: (sequences, steps), padded; tokens index ``keys``; files: (sequences,) file features."""
    n, steps = tokens.shape
    features = {f: i for i, f in enumerate(sorted({f for k in keys for f in k}))}
    x = one_hot([*keys, ()], features)  # the last key stands for no neighbour
    there = np.arange(steps) < lengths[:, None]
    own = np.where(there, tokens, len(keys))
    left = np.concatenate([np.full((n, 1), len(keys)), own[:, :-1]], 1)
    right = np.concatenate([own[:, 1:], np.full((n, 1), len(keys))], 1)
    w = [np.zeros((len(features), TAGS)) for _ in range(3)] + [np.zeros((n_files, TAGS)), np.zeros((TAGS, TAGS))]
    moment, square = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    legal = np.zeros((TAGS, TAGS))
    legal[OUT, INSIDE] = NEVER
    gold = np.eye(TAGS)[tags] * there[..., None]
    pairs = there[:, 1:].ravel()
    before, after = (np.eye(TAGS)[x.ravel()[pairs]] for x in (tags[:, :-1], tags[:, 1:]))
    pairs_gold = before.T @ after
    first = np.array([1, 1, 0])
    for step in range(1, rounds + 1):
        score = (x @ w[0])[own] + (x @ w[1])[left] + (x @ w[2])[right] + w[3][files][:, None, :]
        psi = np.exp(score - score.max(2, keepdims=True))
        move = np.exp(w[4] + legal - w[4].max())
        alpha, beta = np.empty((n, steps, TAGS)), np.ones((n, steps, TAGS))  # each scaled to sum to 1
        alpha[:, 0] = psi[:, 0] * first
        alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
        for t in range(1, steps):
            a = (alpha[:, t - 1] @ move) * psi[:, t]
            alpha[:, t] = np.where(there[:, t, None], a / a.sum(1, keepdims=True), alpha[:, t - 1])
        for t in range(steps - 2, -1, -1):
            b = (psi[:, t + 1] * beta[:, t + 1]) @ move.T
            beta[:, t] = np.where(there[:, t + 1, None], b / b.sum(1, keepdims=True), 1)
        node = alpha * beta
        node = node / node.sum(2, keepdims=True) * there[..., None]
        a, b = alpha[:, :-1].reshape(-1, TAGS)[pairs], (psi * beta)[:, 1:].reshape(-1, TAGS)[pairs]
        edges = move * ((a / ((a @ move) * b).sum(1, keepdims=True)).T @ b)
        g = (node - gold).reshape(-1, TAGS)
        grads = []
        for at in (own, left, right):
            summed = np.stack([np.bincount(at.ravel(), g[:, k], len(keys) + 1) for k in range(TAGS)], 1)
            grads.append(x.T @ summed)
        by_file = np.stack([np.bincount(np.repeat(files, steps), g[:, k], n_files) for k in range(TAGS)], 1)
        grads += [by_file, edges - pairs_gold]
        for i, grad in enumerate(grads):
            grad = grad / n + ridge * w[i]
            moment[i] = 0.9 * moment[i] + 0.1 * grad
            square[i] = 0.999 * square[i] + 0.001 * grad**2
            w[i] = w[i] - rate * (moment[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
    return Chain(features, *w[:4], w[4] + legal)


def viterbi(score: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best tags of one sequence; score: (steps, tags)."""
    best = score[0] + np.array([0, 0, NEVER])
    back = np.zeros(score.shape, np.int8)
    for t in range(1, len(score)):
        got = best[:, None] + moves
        back[t] = got.argmax(0)
        best = got.max(0) + score[t]
    tags = np.zeros(len(score), np.int8)
    tags[-1] = best.argmax()
    for t in range(len(score) - 1, 0, -1):
        tags[t - 1] = back[t, tags[t]]
    return tags
