"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character 3- to 5-grams (with edge marks) and itself, each hashed to a
row of one embedding table, so that unseen misspellings share vectors with words that were seen. A
segment of a text is the average of its words' vectors; a linear softmax tells its label. Texts
are labelled as a whole, so a toxic text teaches through its most toxic segment, a clean text
through all of its segments; a text's score is that of its most toxic segment. All
segments of the whole text are scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import groupby, islice

import numpy as np

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


@dataclass(frozen=True)
class Settings:
    """Parameters of training. ``most_rows`` bounds the labelled sample that is fetched; all of its texts are learnt from as a whole."""

    most_rows: int = 4000
    buckets: int = 1 << 17
    dim: int = 8
    segment: int = 40
    epochs: int = 5
    rate: float = 0.5
    seed: int = 5


def word_list(text: str | None) -> list[str]:
    """Lower-cased words in order; a word that repeats the one before counts once, so that runs of it don't fill a segment."""
    return [w for w, _ in groupby(_WORD.findall(text.lower()))] if text else []


def subwords(words: list[str], buckets: int, least: int = 3, most: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(rows, lengths): for each word in turn the rows of the character n-grams of ``<word>`` and of the word itself.

    Hashes are polynomials of the code points, taken over all words at once; of very long words, too.
    """
    marked = [f"<{w}>" for w in words]
    sizes = np.array([len(m) for m in marked])
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    whole = np.zeros(len(words), dtype=np.uint64)
    place = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    power = np.cumprod(np.full(int(sizes.max(initial=1)), 1099511628211, dtype=np.uint64))
    np.add.at(whole, owner, points * power[place])
    hashes, owners = [whole], [np.arange(len(words))]
    for n in range(least, most + 1):
        if len(points) < n:
            break
        h = np.full(len(points) - n + 1, n, dtype=np.uint64)
        for j in range(n):
            h = h * np.uint64(1000003) + points[j : len(points) - n + 1 + j]
        inside = owner[: len(h)] == owner[n - 1 :]
        hashes.append(h[inside])
        owners.append(owner[: len(h)][inside])
    h, o = np.concatenate(hashes), np.concatenate(owners)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    rows = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
    return rows[np.argsort(o, kind="stable")], np.bincount(o, minlength=len(words))


@dataclass
class Model:
    """Per bucket, the difference of the two classes' logits, which is all that scoring needs."""

    gain: np.ndarray
    bias: float
    settings: Settings

    def gains(self, words: list[str], part: int = 20_000) -> np.ndarray:
        """Mean gain of each word's subwords."""
        out = [np.zeros(0)]
        for at in range(0, len(words), part):
            rows, lengths = subwords(words[at : at + part], self.settings.buckets)
            out.append(np.add.reduceat(self.gain[rows], np.cumsum(lengths) - lengths) / lengths)
        return np.concatenate(out)

    def logits(self, texts: Iterable[str | None], cache: dict[str, float] | None = None, most_cached: int = 500_000) -> np.ndarray:
        cache = {} if cache is None else cache
        width, out = self.settings.segment, []
        texts = iter(texts)
        while some := list(islice(texts, 256)):
            found = [word_list(t) for t in some]
            if len(cache) > most_cached:
                cache.clear()
            new = list({w for ws in found for w in ws if w not in cache})
            cache.update(zip(new, self.gains(new).tolist(), strict=True))
            for ws in found:
                if not ws:
                    out.append(min(self.bias, -2.2))  # nothing in it is toxic: 0.1 at most
                    continue
                gains = np.fromiter(map(cache.__getitem__, ws), dtype=float, count=len(ws))
                starts = np.arange(0, len(gains), width)
                counts = np.minimum(width, len(gains) - starts)
                out.append(float((np.add.reduceat(gains, starts) / np.maximum(counts, width // 2)).max()) + self.bias)
        return np.array(out, dtype=float)

    def scores(self, texts: Iterable[str | None], cache: dict[str, float] | None = None) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts, cache), -30, 30)))


def train(texts: list[str | None], labels: list[int], settings: Settings = Settings()) -> Model:
    """Fits table and softmax jointly by AdaGrad. Without both labels, the score is the share of label 1."""
    y = np.asarray(labels, dtype=int)
    share = (y.sum() + 1) / (len(y) + 2)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(settings.buckets, dtype=np.float32), float(np.log(share / (1 - share))), settings)
    numbered: dict[str, int] = {}
    segments, owner = [], []
    for k, text in enumerate(texts):
        numbers = [numbered.setdefault(w, len(numbered)) for w in word_list(text)]
        for at in range(0, len(numbers), settings.segment):
            segments.append(np.array(numbers[at : at + settings.segment], dtype=np.int32))
            owner.append(k)
    owner = np.array(owner, dtype=np.int64)
    if not segments:
        return Model(np.zeros(settings.buckets, dtype=np.float32), float(np.log(share / (1 - share))), settings)
    vocabulary = list(numbered)
    pieces = [subwords(vocabulary[at : at + 20_000], settings.buckets) for at in range(0, len(vocabulary), 20_000)]
    flat, lengths = np.concatenate([r for r, _ in pieces]), np.concatenate([n for _, n in pieces])
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    rng = np.random.default_rng(settings.seed)
    table = rng.uniform(-1 / settings.dim, 1 / settings.dim, (settings.buckets, settings.dim)).astype(np.float32)
    weight, bias = np.zeros((2, settings.dim), dtype=np.float32), np.zeros(2, dtype=np.float32)
    weight[1], weight[0] = 0.1, -0.1
    seen_t, seen_w, seen_b = np.full(settings.buckets, 1e-6, np.float32), np.full_like(weight, 1e-6), np.full_like(bias, 1e-6)

    learnt = np.zeros(settings.buckets, dtype=bool)

    def sums(groups: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(groups, values[:, k], n) for k in range(values.shape[1])], axis=1).astype(np.float32)

    def bags(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of the segments, the segment of each, and the weight of each."""
        parts = [segments[i] for i in which]
        sizes = np.array([len(p) for p in parts])
        return np.concatenate(parts), np.repeat(np.arange(len(parts)), sizes), np.repeat(1 / np.maximum(sizes, settings.segment // 2), sizes).astype(np.float32)

    def word_vectors(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = lengths[numbers]
        at = np.repeat(begins[numbers] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        rows = flat[at]
        return np.add.reduceat(table[rows], np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0) / n[:, None], rows, n

    for epoch in range(settings.epochs):
        # Teachers: all segments of clean texts (thinned to the number of the others, anew each epoch), the most toxic of toxic texts.
        gain = table @ (weight[1] - weight[0])
        per_word = np.add.reduceat(gain[flat], begins) / lengths
        value = np.array([per_word[s].sum() / max(len(s), settings.segment // 2) for s in segments])
        toxic = np.flatnonzero(y[owner] == 1)
        if epoch:
            order = toxic[np.lexsort((-value[toxic], owner[toxic]))]
            toxic = order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])]
            toxic = np.repeat(toxic, 2)
        toxic = rng.permutation(toxic)
        clean = np.flatnonzero(y[owner] == 0)
        hard = clean[np.argsort(-value[clean], kind="stable")[: len(toxic)]]
        some = np.concatenate([toxic, rng.choice(clean, min(len(clean), 2 * len(toxic)), replace=False), hard if epoch else hard[:0]])
        rng.shuffle(some)
        for batch in np.array_split(some, max(1, len(some) // 64)):
            numbers, segment, share_of = bags(batch)
            unique, back = np.unique(numbers, return_inverse=True)
            vectors, rows, n = word_vectors(unique)
            h = sums(segment, vectors[back] * share_of[:, None], len(batch))
            z = h @ weight.T + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), y[owner[batch]]] -= 1
            grad_h = p @ weight
            grad_w, grad_b = p.T @ h / len(batch), p.mean(axis=0)
            grad_u = sums(back, grad_h[segment] * share_of[:, None], len(unique))
            hit, which = np.unique(rows, return_inverse=True)
            grad_t = sums(which, np.repeat(grad_u / n[:, None], n, axis=0), len(hit))
            learnt[hit] = True
            seen_t[hit] += (grad_t**2).mean(axis=1)
            table[hit] -= settings.rate * grad_t / np.sqrt(seen_t[hit])[:, None]
            seen_w += grad_w**2
            seen_b += grad_b**2
            weight -= 0.1 * grad_w / np.sqrt(seen_w)
            bias -= 0.1 * grad_b / np.sqrt(seen_b)
    table[~learnt] = 0  # rows that no segment taught would add noise only
    model = Model((table @ (weight[1] - weight[0])).astype(np.float32), float(bias[1] - bias[0]), settings)
    # A text is judged by its highest segment, so the cut is set on whole texts: the bias is moved to where both errors are least.
    z = model.logits(texts)
    order = np.argsort(z, kind="stable")
    errors = np.concatenate([[0], np.cumsum(y[order] == 1)]) + np.concatenate([np.cumsum((y[order] == 0)[::-1])[::-1], [0]])
    best = np.flatnonzero(errors == errors.min())
    cuts = np.concatenate([[z[order[0]] - 1], (z[order][1:] + z[order][:-1]) / 2, [z[order[-1]] + 1]])
    model.bias -= float(cuts[best].min() + 0.4 * (cuts[best].max() - cuts[best].min()))  # unseen toxic texts score lower than these
    return model
