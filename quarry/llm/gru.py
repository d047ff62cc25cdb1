"""A bidirectional gated recurrent network with attention pooling, in numpy.

A step's input joins fixed features with a word's and its characters' embeddings; both directions'
states are pooled with learned attention into one logit. Training is back-propagation through time
with Adam; sequences shorter than a window are masked.
"""

from __future__ import annotations

import numpy as np

HIDDEN, ATTENTION = 8, 8
BLOCK = 4096  # windows scored at once
CHUNK = 1024  # windows scored at once by half-overlapping blocks


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def new(inputs: int, words: int, chars: int, width: int, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights; ``inputs`` counts the fixed features, ``width`` each embedding's numbers."""
    rng = np.random.default_rng(seed)
    d = inputs + 2 * width
    w = {"words": rng.normal(0, 0.05, (words, width)), "chars": rng.normal(0, 0.05, (chars, width))}
    for way in ("f", "b"):
        w |= {f"{way}x": rng.normal(0, d**-0.5, (d, 3 * HIDDEN)), f"{way}h": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN)), f"{way}o": np.zeros(3 * HIDDEN)}
    w |= {"aw": rng.normal(0, 0.25, (2 * HIDDEN, ATTENTION)), "av": rng.normal(0, 0.25, ATTENTION), "ow": rng.normal(0, 0.25, 2 * HIDDEN), "ob": np.zeros(1)}
    return {k: v.astype(np.float32) for k, v in w.items()}


def _run(w: dict, way: str, x: np.ndarray, there: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States at every step, in the text's order; x: (steps, n, inputs), there: (steps, n, 1)."""
    steps, n = x.shape[:2]
    h, out, saved = np.zeros((n, HIDDEN), np.float32), np.empty((steps, n, HIDDEN), np.float32), []
    wh = w[way + "h"]
    for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
        a, u = x[t] @ w[way + "x"] + w[way + "o"], h @ wh
        zr = _sigmoid(a[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(a[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
        if keep:
            saved.append((t, h, zr, c, u[:, 2 * HIDDEN :]))
        h = h + there[t] * (1 - z) * (c - h)
        out[t] = h
    return out, saved


def forward(w: dict, x: np.ndarray, there: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
    """Logits of n windows."""
    f, fs = _run(w, "f", x, there, keep)
    b, bs = _run(w, "b", x, there, keep)
    h = np.concatenate([f, b], 2)
    u = np.tanh(h @ w["aw"])
    e = u @ w["av"] + np.where(there[..., 0] > 0, 0, -1e9)
    e = np.exp(e - e.max(0))
    alpha = e / e.sum(0)
    pooled = (alpha[..., None] * h).sum(0)
    return pooled @ w["ow"] + w["ob"], (x, there, h, u, alpha, pooled, fs, bs)


def backward(w: dict, saved: tuple, g: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of weights and of the inputs; g: gradient of the logits."""
    x, there, h, u, alpha, pooled, fs, bs = saved
    grads = {"ow": pooled.T @ g, "ob": g.sum(keepdims=True)}
    dp = g[:, None] * w["ow"]
    dh = alpha[..., None] * dp
    da = (h * dp).sum(2)
    de = alpha * (da - (alpha * da).sum(0))
    grads["av"] = np.einsum("tna,tn->a", u, de)
    du = de[..., None] * w["av"] * (1 - u * u)
    grads["aw"] = np.einsum("tnh,tna->ha", h, du)
    dh = dh + du @ w["aw"].T
    dx = np.zeros_like(x)
    for way, rows, part in (("f", fs, dh[..., :HIDDEN]), ("b", bs, dh[..., HIDDEN:])):
        gx, gh, go = np.zeros_like(w[way + "x"]), np.zeros_like(w[way + "h"]), np.zeros_like(w[way + "o"])
        later = np.zeros_like(rows[0][1])
        for t, before, zr, c, un in reversed(rows):
            d = later + part[t]
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            m = there[t]
            dc = d * m * (1 - z) * (1 - c * c)
            dz = -d * m * (c - before) * z * (1 - z)
            dr = dc * un * r * (1 - r)
            ga = np.concatenate([dz, dr, dc], 1)
            gu = np.concatenate([dz, dr, dc * r], 1)
            gx += x[t].T @ ga
            gh += before.T @ gu
            go += ga.sum(0)
            dx[t] += ga @ w[way + "x"].T
            later = d * (1 - m * (1 - z)) + gu @ w[way + "h"].T
        grads |= {way + "x": gx, way + "h": gh, way + "o": go}
    return grads, dx


def gate_weights(w: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weights for ``half_overlapping``: of inputs (both directions' gates), states, attention.

    Signs and factors are folded in, so that a gate is 1 / (1 + exp(.)) and a tanh 1 - 2 / (1 + exp(.)).
    """
    fold = np.r_[-np.ones(2 * HIDDEN), 2 * np.ones(HIDDEN)].astype(np.float32)
    inputs = np.concatenate([np.concatenate([w[k + "x"], w[k + "o"][None]]) * fold for k in "fb"], 1)
    states = [np.ascontiguousarray((w[k + "h"] * fold).T) for k in "fb"]
    return inputs, states[0], states[1], np.ascontiguousarray(np.concatenate([2 * w["aw"], w["ow"][:, None]], 1).T)


def half_overlapping(w: dict, folded: tuple, gates: np.ndarray, sizes: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Logits of windows made of a block of words and, where ``more``, the next one.

    gates: (blocks + 1, words of a block, gates) of each word; sizes: words in each of the blocks + 1.
    The same numbers as ``forward``, laid out so that a step reads both its blocks in place.
    """
    blocks, half = len(gates) - 1, gates.shape[1]
    g = np.ascontiguousarray(gates.transpose(1, 2, 0))
    there = np.arange(half)[:, None] < sizes
    mask = np.concatenate([there[:, :-1], there[:, 1:] & more]).astype(np.float32)
    steps, n = 2 * half, 3 * HIDDEN
    states = np.empty((steps, 2 * HIDDEN, blocks), np.float32)
    u, zr, c = np.empty((n, blocks), np.float32), np.empty((2 * HIDDEN, blocks), np.float32), np.empty((HIDDEN, blocks), np.float32)
    with np.errstate(over="ignore"):
        for way in (0, 1):
            h = np.zeros((HIDDEN, blocks), np.float32)
            own = slice(way * HIDDEN, (way + 1) * HIDDEN)
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                a = g[t, way * n : (way + 1) * n, :-1] if t < half else g[t - half, way * n : (way + 1) * n, 1:]
                np.matmul(folded[1 + way], h, out=u)
                np.add(a[: 2 * HIDDEN], u[: 2 * HIDDEN], out=zr)
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                np.multiply(zr[HIDDEN:], u[2 * HIDDEN :], out=c)
                c += a[2 * HIDDEN :]
                np.exp(c, out=c)
                c += 1
                np.divide(-2, c, out=c)
                c += 1
                c -= h
                np.subtract(1, zr[:HIDDEN], out=zr[:HIDDEN])
                c *= zr[:HIDDEN]
                c *= mask[t]
                h = np.add(h, c, out=states[t, own])
        seen = np.matmul(folded[3], states)
        e = seen[:, :ATTENTION]
        np.exp(e, out=e)
        e += 1
        np.divide(-2, e, out=e)
        e += 1
    score = np.einsum("tan,a->tn", e, w["av"]) + np.where(mask > 0, 0, np.float32(-1e9))
    alpha = np.exp(score - score.max(0))
    return (alpha * seen[:, ATTENTION]).sum(0) / alpha.sum(0) + w["ob"]


class Adam:
    def __init__(self, w: dict, rate: float):
        self.w, self.rate, self.step = w, rate, 0
        self.m, self.v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))

    def update(self, grads: dict, decay: float = 1e-4) -> None:
        self.step += 1
        for k, g in grads.items():
            g = np.clip(g, -1, 1) + decay * self.w[k]
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.w[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.step)) / (np.sqrt(self.v[k] / (1 - 0.999**self.step)) + 1e-8)).astype(np.float32)
