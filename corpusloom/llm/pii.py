"""Personal data by patterns and a skip-chain conditional random field.

The patterns find emails, IP addresses, card numbers and phone numbers; what they find always
stays. Around them a conditional random field labels the tokens of each text: neighbours form
a chain, and tokens that are the same or similar (one shape and one long part in common), however
far apart, are joined by skip edges with potentials of their own. Marginals come from loopy
message passing, so that a token in a weak context takes the label that its double
has in a strong one. The field is trained in numpy on the patterns' own finds in a bounded sample
of texts; its finds that don't overlap a pattern's are added.

A token takes part only if it holds a digit, ``@`` or ``+``: no other token can be of a kind, and
texts without any are done at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match never starts within a run of digits, as the one before it ends with its run; to say so keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_CANDIDATE = re.compile(r"[0-9@+]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Leftmost matches that don't overlap, found from each ``@``: a search from every word would be far slower.

    The local part of a match is the longest run of its characters before the ``@``, so far as no earlier match holds them.
    """
    out, at, done = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            out.append(("email", m.start(), m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def _part(digits: str) -> bool:
    """Whether a part of an IP address is at most 255; leading zeros count for nothing, however many there are."""
    bare = digits.lstrip("0")
    return len(bare) <= 3 and int(bare or "0") <= 255


def base_spans(text: str | None) -> list[Span]:
    """The patterns' finds by kind in the order of KINDS, then start; code points, end exclusive."""
    if not text:
        return []
    out = _emails(text)
    digit = re.search("[0-9]", text)
    if not digit:
        return out
    first = digit.start()
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text, first) if all(_part(p) for p in m[0].split("."))]
    for m in CARD.finditer(text, first):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _shape(token: str) -> str:
    """The token with its runs of letters and digits folded; runs of digits keep their length up to 4."""
    return re.sub(r"[A-Z]+", "A", re.sub(r"[^\W\d_A-Z]+", "a", re.sub(r"[0-9]+", lambda m: "0" * min(len(m[0]), 4), token)))


def _features(tokens: list[str], k: int) -> list[str]:
    t = tokens[k]
    digits = sum("0" <= c <= "9" for c in t)
    return [f"s:{_shape(t)}", f"d:{min(digits, 20)}", f"n:{min(len(t) // 4, 12)}", f"at:{t.count('@')}", f"dot:{min(t.count('.'), 5)}", f"p:{t[0] == '+'}", f"b:{tokens[k - 1].lower() if k else ''}", "1"]


def _skips(tokens: list[str], where: list[int]) -> list[tuple[int, int]]:
    """Edges between each candidate and those before it that are the same or similar.

    A token is linked with the first and the last one of each of its keys (the token, its trimmed form, its shape with its
    longest part), so edges grow with the tokens, not with the pairs, and any two tokens of a key are two steps apart.
    """
    seen: dict[str, tuple[int, int]] = {}
    edges = set()
    for i, k in enumerate(where):
        t = tokens[k]
        bare = t.strip(".,;:!?()[]\"'<>")
        parts = [p for p in re.split(r"[^A-Za-z0-9]+", bare) if len(p) >= 4]
        keys = {f"t:{t}", f"b:{bare}"} | ({f"p:{max(parts, key=len)}:{_shape(bare)}"} if parts else set())
        for key in keys:
            first, last = seen.get(key, (i, i))
            edges.update((j, i) for j in {first, last} if k - where[j] > 1)
            seen[key] = (first, i)
    return sorted(edges)


@dataclass
class Field:
    """Weights of labels (O and the kinds) by feature, of neighbours, and of skip edges."""

    labels: int = len(KINDS) + 1
    names: dict[str, int] = field(default_factory=dict)
    unary: np.ndarray | None = None
    chain: np.ndarray | None = None
    skip: np.ndarray | None = None
    #: Messages stop sooner where they have settled.
    rounds: int = 30

    def potentials(self, tokens: list[str], where: list[int]) -> tuple[np.ndarray, list[list[int]]]:
        ids = [[self.names[f] for f in _features(tokens, k) if f in self.names] for k in where]
        return np.array([self.unary[i].sum(axis=0) for i in ids]).reshape(len(where), self.labels), ids

    def marginals(self, unary: np.ndarray, edges: list[tuple[int, int, bool]], joint: bool = True, part: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
        """Beliefs of the nodes and, if asked for, of the edges, by damped sum-product messages in the log domain.

        Messages are computed for ``part`` edges at a time, so that memory beyond two short vectors an edge doesn't grow.
        """
        n, m, labels = len(unary), len(edges), self.labels
        if not m:
            return _softmax(unary), np.zeros((0, labels, labels))
        a, b, far = (np.array(x) for x in zip(*edges, strict=True))
        pairs = np.stack([self.chain, self.skip])[:, None]
        parts = [slice(s, s + part) for s in range(0, m, part)]
        forth, back = np.zeros((m, labels)), np.zeros((m, labels))

        def beliefs() -> np.ndarray:
            out = unary.copy()
            np.add.at(out, b, forth)
            np.add.at(out, a, back)
            return out

        for _ in range(self.rounds):
            belief, moved = beliefs(), 0.0
            for s in parts:
                pair = pairs[far[s].astype(int), 0]
                new_forth = _logsum(pair + (belief[a[s]] - back[s])[:, :, None], 1)
                new_back = _logsum(pair + (belief[b[s]] - forth[s])[:, None, :], 2)
                new_forth -= new_forth.max(axis=1, keepdims=True)
                new_back -= new_back.max(axis=1, keepdims=True)
                moved = max(moved, np.abs(new_forth - forth[s]).max(), np.abs(new_back - back[s]).max())
                forth[s], back[s] = 0.3 * forth[s] + 0.7 * new_forth, 0.3 * back[s] + 0.7 * new_back
            if moved < 1e-3:
                break
        belief = beliefs()
        if not joint:
            return _softmax(belief), np.zeros((0, labels, labels))
        both = pairs[far.astype(int), 0] + (belief[a] - back)[:, :, None] + (belief[b] - forth)[:, None, :]
        both = np.exp(both - both.max(axis=(1, 2), keepdims=True))
        return _softmax(belief), both / both.sum(axis=(1, 2), keepdims=True)

    def label(self, tokens: list[str], where: list[int], edges: list[tuple[int, int, bool]]) -> np.ndarray:
        """Probabilities of the labels of the candidate tokens."""
        return self.marginals(self.potentials(tokens, where)[0], edges, joint=False)[0]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def lattice(text: str) -> tuple[list[tuple[int, int]], list[str], list[int], list[tuple[int, int, bool]]]:
    """Tokens near candidates with their places, the candidates among them, and the edges between candidates."""
    places, tokens, where = [], [], []
    for m in _TOKEN.finditer(text):
        places.append(m.span())
        tokens.append(m[0])
        if _CANDIDATE.search(m[0]):
            where.append(len(tokens) - 1)
    edges = [(i, i + 1, False) for i, (x, y) in enumerate(pairwise(where)) if y - x == 1]
    return places, tokens, where, edges + [(i, j, True) for i, j in _skips(tokens, where)]


def train(texts: Iterable[str | None], epochs: int = 6, rate: float = 0.3, l2: float = 1e-4, least: int = 2) -> Field:
    """Fits the field to the patterns' finds: stochastic gradients of the (Bethe) likelihood, AdaGrad steps."""
    examples, counts = [], {}
    for text in texts:
        if not text or not _CANDIDATE.search(text):
            continue
        spans = base_spans(text)
        places, tokens, where, edges = lattice(text)
        gold = np.zeros(len(where), dtype=int)
        for i, k in enumerate(where):
            for kind, start, end in spans:
                if start < places[k][1] and places[k][0] < end:
                    gold[i] = KINDS.index(kind) + 1
                    break
        examples.append((tokens, where, edges, gold))
        for k in where:
            for f in _features(tokens, k):
                counts[f] = counts.get(f, 0) + 1
    model = Field()
    model.names = {f: i for i, f in enumerate(sorted(f for f, c in counts.items() if c >= least))}
    shape = len(model.names), model.labels
    model.unary, model.chain, model.skip = np.zeros(shape), np.zeros((model.labels,) * 2), np.eye(model.labels) * 0.5
    seen = [np.full(x.shape, 1e-2) for x in (model.unary, model.chain, model.skip)]
    order = np.random.default_rng(10)
    for _ in range(epochs):
        for e in order.permutation(len(examples)):
            tokens, where, edges, gold = examples[e]
            unary, ids = model.potentials(tokens, where)
            node, joint = model.marginals(unary, edges)
            node[np.arange(len(gold)), gold] -= 1
            grads = {1: np.zeros_like(model.chain), 2: np.zeros_like(model.skip)}
            for (a, b, far), p in zip(edges, joint, strict=True):
                grads[2 if far else 1] += p
                grads[2 if far else 1][gold[a], gold[b]] -= 1
            for row, g in zip(ids, node, strict=True):
                if row:
                    seen[0][row] += g * g
                    model.unary[row] -= rate * (g + l2 * model.unary[row]) / np.sqrt(seen[0][row])
            for k, w in ((1, model.chain), (2, model.skip)):
                seen[k] += grads[k] ** 2
                w -= rate * (grads[k] + l2 * w) / np.sqrt(seen[k])
    return model


def find(text: str | None, model: Field, threshold: float = 0.9) -> tuple[list[Span], list[Span]]:
    """(base, all): the patterns' finds, and those with what the field adds, both by kind, then start.

    Null and empty texts have none. A token that the field is sure of, trimmed of punctuation around it, is
    added if it overlaps no pattern's find.
    """
    base = base_spans(text)
    if not text or not _CANDIDATE.search(text) or model.unary is None or not model.names:
        return base, base
    places, tokens, where, edges = lattice(text)
    chance = model.label(tokens, where, edges)
    added = []
    for i, k in enumerate(where):
        kind = int(chance[i].argmax())
        if not kind or chance[i, kind] < threshold:
            continue
        start, end = places[k]
        token = tokens[k]
        start += len(token) - len(token.lstrip("([{<\"'"))
        end -= len(token) - len(token.rstrip(")]}>\"'.,;:!?"))
        if start < end and not any(s < end and start < e for _, s, e in base):
            added.append((KINDS[kind - 1], start, end))
    both = sorted(set(base + added), key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return base, both
