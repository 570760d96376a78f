"""Hashed sparse features and a follow-the-regularised-leader logistic regression."""

from __future__ import annotations

import numpy as np

from tessera.llm import kernels as K

#: Classes of bytes for word shapes: runs of one class count once.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91] = 65
_SHAPE[97:123] = 97
_SHAPE[128:] = 97
_SHAPE[48:58] = 48


def shape_hashes(data: np.ndarray, words: K.Words) -> np.ndarray:
    """Hash of each word's shape: letters by case, digits, marks; repeats collapse ("IDEA!!" and "TO!" agree)."""
    shape = _SHAPE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[words.start] = True
    rank = np.concatenate([[0], np.cumsum(keep)])
    return K.span_hash(shape[keep], rank[words.start], rank[words.end], seed=11)


def style_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text index, 64-bit feature) of lower-cased word and word-shape uni- and bigrams."""
    plain = K.Words(data, offsets, K.ALNUM, lower=True)
    spaced = K.Words(data, offsets)
    docs, out = [], []
    for salt, words, h in ((1, plain, plain.hash), (2, spaced, shape_hashes(data, spaced))):
        doc = words.doc()
        two = K.same_text(words.first, 2, doc)
        docs += [doc, doc[: len(two)][two]]
        out += [K.mix64(h + np.uint64(salt)), K.mix64(K.grams(h, 2)[two] + np.uint64(salt))]
    return np.concatenate(docs), np.concatenate(out)


def normalised(doc: np.ndarray, feature: np.ndarray, bits: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, slot, value): damped counts of each text's distinct slots, scaled to unit length."""
    d, slot, count = K.unique_in_text(doc, (feature >> np.uint64(64 - bits)))
    value = 1 + np.log(count)
    norm = np.sqrt(np.bincount(d, value * value, minlength=n)) if len(d) else np.ones(n)
    return d, slot.astype(np.int32), (value / norm[d]).astype(np.float32)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, float]], bits: int, *, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.0, l2: float = 0.0, epochs: int = 3, seed: int = 7, prior: float | None = None) -> tuple[np.ndarray, float]:
    """Per-coordinate FTRL-proximal; rows are (slots, values, target in 0..1). Gives weights and the intercept."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    target = np.array([r[2] for r in rows]) if rows else np.zeros(0)
    mean = prior if prior is not None else float(np.clip(target.mean(), 1e-3, 1 - 1e-3)) if len(target) else 0.5
    intercept, g2 = float(np.log(mean / (1 - mean))), 0.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            slot, value, y = rows[r]
            zi, ni = z[slot], n[slot]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + root) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(intercept + w @ value, -35, 35)))
            g = (p - y) * value
            z[slot] += g - (np.sqrt(ni + g * g) - root) / alpha * w
            n[slot] += g * g
            g2 += (p - y) ** 2
            intercept -= 0.1 * (p - y) / (1 + np.sqrt(g2))
    root = np.sqrt(n)
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + root) / alpha + l2))
    return w.astype(np.float32), intercept


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
