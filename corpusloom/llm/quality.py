"""Quality by logistic regression on hashed word n-grams, fitted by follow-the-regularised-leader updates.

Features are the words and pairs of words of a text, and the same of the words' shapes (letters,
digits and cases folded, punctuation kept, a word that repeats the one before marked), all hashed into
one table of weights. A text's value for a feature is its share of the n-grams of that kind,
so a score is a sparse dot product that long and short texts pay alike.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SHAPES = [(re.compile(r"[^\W\d_]+"), lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "a"), (re.compile(r"\d+"), "0")]
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SAME = zlib.crc32(b"=")
SCALE = 8.0


@dataclass(frozen=True)
class Settings:
    """``most_rows`` bounds the labelled sample that is fetched; alpha, beta, l1 and l2 are those of the updates."""

    most_rows: int = 6000
    bits: int = 20
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    seed: int = 6


def shape(word: str) -> str:
    for pattern, to in _SHAPES:
        word = pattern.sub(to, word)
    return re.sub(r"(.)\1+", r"\1\1", word)


def features(text: str | None, bits: int, cache: dict, most_cached: int = 500_000) -> list[np.ndarray]:
    """Rows of the weights for the n-grams of each kind; empty for a text without words."""
    found = _WORD.findall(text) if text else []
    if not found:
        return []
    codes = np.empty((len(found), 2), dtype=np.uint64)
    for i, w in enumerate(found):
        c = cache.get(w)
        if c is None:
            c = zlib.crc32(w.lower().encode("utf-8", "surrogatepass")), zlib.crc32(shape(w).encode("utf-8", "surrogatepass"))
            if len(cache) < most_cached:
                cache[w] = c
        codes[i] = c
    word, form = codes[:, 0], codes[:, 1].copy()
    form[1:][word[1:] == word[:-1]] = _SAME
    out = []
    for kind, codes_of in enumerate((word, form)):
        one = codes_of + (np.uint64(kind + 1) << np.uint64(33))
        out.append(one)
        if len(found) > 1:
            out.append(one[:-1] * np.uint64(1000003) + one[1:] + (np.uint64(kind + 3) << np.uint64(33)))
    return [((x * _MIX) >> np.uint64(64 - bits)).astype(np.int64) for x in out]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    bits: int

    def scores(self, texts: Iterable[str | None], cache: dict | None = None) -> np.ndarray:
        cache = {} if cache is None else cache
        z = [self.bias + SCALE * sum(float(self.weights[rows].mean()) for rows in features(t, self.bits, cache)) for t in texts]
        return 1 / (1 + np.exp(-np.clip(np.array(z, dtype=float), -30, 30)))


def train(texts: list[str | None], labels: list[int], settings: Settings = Settings()) -> Model:
    """One FTRL-proximal pass an epoch. Without both labels, the score is the share of label 1."""
    y = np.asarray(labels, dtype=float)
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    size = 1 << settings.bits
    if len(set(labels)) < 2:
        return Model(np.zeros(size, dtype=np.float32), prior, settings.bits)
    z, n, weights = np.zeros(size), np.zeros(size), np.zeros(size)
    zb = nb = bias = 0.0
    cache: dict = {}
    rng = np.random.default_rng(settings.seed)
    sparse = []
    for t in texts:
        kinds = features(t, settings.bits, cache)
        rows, values = (np.concatenate(kinds), np.concatenate([np.full(len(k), SCALE / len(k)) for k in kinds])) if kinds else (np.zeros(0, dtype=np.int64), np.zeros(0))
        unique, back = np.unique(rows, return_inverse=True)
        sparse.append((unique.astype(np.int32), np.bincount(back, values, len(unique)).astype(np.float32)))
    for _ in range(settings.epochs):
        for k in rng.permutation(len(sparse)):
            rows, x = sparse[k]
            p = 1 / (1 + np.exp(-np.clip(bias + weights[rows] @ x, -30, 30)))
            g = (p - y[k]) * x
            sigma = (np.sqrt(n[rows] + g * g) - np.sqrt(n[rows])) / settings.alpha
            z[rows] += g - sigma * weights[rows]
            n[rows] += g * g
            zr = z[rows]
            weights[rows] = np.where(np.abs(zr) <= settings.l1, 0, -(zr - np.sign(zr) * settings.l1) / ((settings.beta + np.sqrt(n[rows])) / settings.alpha + settings.l2))
            gb = p - y[k]
            zb += gb - (np.sqrt(nb + gb * gb) - np.sqrt(nb)) / settings.alpha * bias
            nb += gb * gb
            bias = -zb / ((settings.beta + np.sqrt(nb)) / settings.alpha)
    return Model(weights.astype(np.float32), float(bias), settings.bits)
