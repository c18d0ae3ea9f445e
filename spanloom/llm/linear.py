"""Hashed byte n-gram features and small linear models in numpy, for the classifiers of this subpackage."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

from spanloom.llm.common import LOWER

#: Buckets of the hashed features.
BUCKETS = 1 << 12


def byte_grams(data: np.ndarray, sizes: tuple[int, ...] = (1, 2, 3), buckets: int = BUCKETS, lower: bool = True) -> Iterator[np.ndarray]:
    """For each size, the bucket of the n-gram that ends at each byte (int64)."""
    x = (LOWER[data] if lower else data).astype(np.uint32)
    h = np.zeros(len(x), np.uint32)
    for size in range(1, max(sizes) + 1):
        if size == 1:
            h = x + np.uint32(1)
        else:
            # the gram that is one byte shorter and begins one byte before
            h = np.concatenate([np.zeros(1, np.uint32), h[:-1]]) * np.uint32(0x9E3779B1) + x + np.uint32(1)
        if size in sizes:
            y = (h ^ np.uint32(size * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35)
            yield ((y ^ (y >> np.uint32(15))) >> np.uint32(32 - int(np.log2(buckets)))).astype(np.int64)


def text_vectors(data: np.ndarray, offsets: np.ndarray, sizes=(1, 2, 3), buckets: int = BUCKETS, lower: bool = True) -> Iterator[np.ndarray]:
    """For each text of a chunk, the square roots of the shares of its n-grams in each bucket: a vector of length
    one (zeros for a text of no bytes)."""
    grams = list(byte_grams(data, sizes, buckets, lower))
    for a, b in zip(offsets[:-1], offsets[1:] - 1, strict=True):
        counts = np.zeros(buckets, np.int64)
        if b > a:
            for g in grams:
                counts += np.bincount(g[a:b], minlength=buckets)
        yield np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, rounds: int = 12, strength: float = 1e-4, seed: int = 5) -> np.ndarray:
    """Weights and bias (last) of a linear support vector machine, y in {-1, 1}: averaged subgradient steps on
    balanced classes."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    y = y.astype(np.float32)
    rng = np.random.default_rng(seed)
    w = np.zeros(x.shape[1], np.float32)
    mean, seen, t = np.zeros_like(w), 0, 0
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    share = (share / share.mean()).astype(np.float32)
    for k in range(rounds):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 64):
            rows = order[at : at + 64]
            t += 1
            rate = 8.0 / (1 + 0.01 * t)
            bad = rows[y[rows] * (x[rows] @ w) < 1]
            w *= 1 - rate * strength
            if len(bad):
                w += rate / len(rows) * ((y[bad] * share[bad]) @ x[bad])
            if k >= rounds // 2:
                mean += w
                seen += 1
    return mean / max(1, seen)


def logistic(x: np.ndarray, p: np.ndarray, rounds: int = 300, strength: float = 1e-5, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights and bias (last) of a logistic regression on labels or probabilities p, by accelerated gradient steps
    on weighted rows."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.ones(len(x), np.float32) if weight is None else weight.astype(np.float32)
    weight = weight / weight.sum()
    p = p.astype(np.float32)
    # the curvature's bound, by power iteration
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):
        v = x.T @ (weight * (x @ v))
        v /= np.linalg.norm(v) + 1e-12
    rate = 1.0 / (0.25 * float(v @ (x.T @ (weight * (x @ v)))) + strength)
    w = np.zeros(x.shape[1], np.float32)
    last, t = w.copy(), 1.0
    ahead = w
    for _ in range(rounds):
        z = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        w = ahead - rate * (x.T @ (weight * (z - p)) + strength * ahead)
        t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        ahead = w + (before - 1) / t * (w - last)
        last = w
    return w


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
