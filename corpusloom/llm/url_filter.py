"""URL filter: rules by host and path, and gradient-boosted trees on lexical features for the rest.

The trees (depth-limited, fitted in numpy to the gradients of the log loss on binned features) learn from labelled URLs:
a table of them, or else the URLs that the rules judge, whose verdict is their label. What rules say of hosts and paths
can teach the trees nothing but how the two kinds of URLs differ in form (suffix, length, digits, parameters); they don't
know spam from news unless the labels do.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMES = ("length", "host_length", "path_length", "depth", "digit_ratio", "host_digits", "entropy", "host_entropy", "params", "labels", "hyphens", "host_hyphens", "suffix_odds", "suffix_share", "domain_odds", "domain_share", "longest_digits", "https", "fragment", "escapes", "vowels")


def parts(url: str | None) -> tuple[str, str]:
    """(host, path) as defined for the filter; both empty without ``://``."""
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values()) if s else 0.0


def suffixes(host: str) -> tuple[str, str]:
    """The last label of a host and its last two, by which statistics are kept."""
    labels = host.split(".")
    return labels[-1], ".".join(labels[-2:])


@dataclass
class Suffixes:
    """Of each suffix of the labelled URLs' hosts the smoothed log odds of the bad label, and its share of the URLs."""

    odds: dict[str, float] = field(default_factory=dict)
    share: dict[str, float] = field(default_factory=dict)
    #: Log odds of all labelled URLs, for suffixes that none of them has.
    prior: float = 0.0

    @classmethod
    def of(cls, urls: list[str], labels: list[int]) -> Suffixes:
        bad, all_ = Counter(), Counter()
        for u, y in zip(urls, labels, strict=True):
            for end in set(suffixes(parts(u)[0])):
                all_[end] += 1
                bad[end] += y
        prior = sum(labels) / max(1, len(labels))
        odds = {e: math.log((bad[e] + 5 * prior + 0.01) / (all_[e] - bad[e] + 5 * (1 - prior) + 0.01)) for e in all_}
        return cls(odds, {e: n / len(urls) for e, n in all_.items()}, math.log((sum(labels) + 1) / (len(labels) - sum(labels) + 1)))


def features(url: str | None, known: Suffixes) -> list[float]:
    """Numbers that the form of a whole URL gives. Null and odd strings have features, too."""
    url = url or ""
    host, path = parts(url)
    last, two = suffixes(host)
    return [
        len(url), len(host), len(path), path.count("/"), sum(c.isdigit() for c in url) / max(1, len(url)), sum(c.isdigit() for c in host), entropy(url), entropy(host),
        url.partition("?")[2].count("=") if "?" in url else 0, host.count(".") + 1 if host else 0, url.count("-"), host.count("-"), known.odds.get(last, known.prior), known.share.get(last, 0.0), known.odds.get(two, known.prior), known.share.get(two, 0.0),
        max((len(d) for d in re.findall(r"\d+", url)), default=0), url.startswith("https:"), "#" in url, url.count("%"), sum(c in "aeiou" for c in host) / max(1, len(host)),
    ]


@dataclass
class Trees:
    """Boosted trees: per tree, arrays of feature, cut, left child and value (a negative feature marks a leaf)."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    base: float
    suffixes: Suffixes

    def scores(self, urls: Iterable[str | None], cache: dict | None = None) -> np.ndarray:
        """Chance of the bad label."""
        rows = [features(u, self.suffixes) for u in urls]
        x = np.array(rows, dtype=float).reshape(len(rows), len(NAMES))
        z = np.full(len(x), self.base)
        for feature, cut, left, value in self.trees:
            at = np.zeros(len(x), dtype=int)
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                rows_in = np.flatnonzero(inner)
                node = at[rows_in]
                at[rows_in] = left[node] + (x[rows_in, feature[node]] > cut[node])
            z += value[at]
        return 1 / (1 + np.exp(-z))


def train(urls: list[str], labels: list[int], *, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, l2: float = 1.0, least: int = 8) -> Trees:
    """Second-order boosting of the log loss; cuts are searched over quantile bins of each feature."""
    known = Suffixes.of(urls, labels)
    x, y = np.array([features(u, known) for u in urls], dtype=float).reshape(len(urls), len(NAMES)), np.array(labels, dtype=float)
    share = (y.sum() + 1) / (len(y) + 2)
    base = math.log(share / (1 - share))
    if len(set(labels)) < 2:
        return Trees([], base, known)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    z, trees = np.full(len(y), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        feature, cut, left, value = [-1], [0.0], [0], [0.0]
        members = {0: np.arange(len(y))}
        level = [0]
        for d in range(depth + 1):
            following = []
            for node in level:
                rows = members.pop(node)
                total_g, total_h = g[rows].sum(), h[rows].sum()
                value[node] = -rate * total_g / (total_h + l2)
                best = (1e-6, -1, 0)
                if d < depth and len(rows) >= 2 * least:
                    for f, c in enumerate(cuts):
                        if not len(c):
                            continue
                        b = binned[rows, f]
                        gl, hl, n = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                        gain = gl**2 / (hl + l2) + (total_g - gl) ** 2 / (total_h - hl + l2) - total_g**2 / (total_h + l2)
                        gain[(n < least) | (len(rows) - n < least)] = 0
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (float(gain[k]), f, k)
                if best[1] < 0:
                    z[rows] += value[node]
                    continue
                _, f, k = best
                feature[node], cut[node], left[node] = f, float(cuts[f][k]), len(feature)
                goes_left = binned[rows, f] <= k
                for part in (rows[goes_left], rows[~goes_left]):
                    members[len(feature)] = part
                    following.append(len(feature))
                    feature.append(-1), cut.append(0.0), left.append(0), value.append(0.0)
            level = following
        trees.append((np.array(feature), np.array(cut), np.array(left), np.array(value)))
    return Trees(trees, base, known)


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule], what: str = "text") -> Column:
    """The text (or verdict) of the longest rule that fits, null if none does; of equally long ones, the earliest."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        out = F.when(fits, F.lit(getattr(rule, what))).otherwise(out)
    return out


def ruled_sample(urls: DataFrame, url: str, rules: list[Rule], most_rows: int = 8000) -> DataFrame:
    """(url, label): distinct URLs that a rule judges, label 1 for those it blocks; at most half of ``most_rows`` of either label,
    chosen by the hash of the URL, so the same at every run."""
    seen = urls.select(F.col(url).alias("url")).distinct()
    judged = seen.withColumn("verdict", rule_of(host_of(F.col("url")), path_of(F.col("url")), rules, "verdict")).where("verdict IS NOT NULL")
    labelled = judged.select("url", (F.col("verdict") == "block").cast("int").alias("label"))
    one, other = (labelled.where(F.col("label") == k).orderBy(F.xxhash64("url"), "url").limit(most_rows // 2) for k in (0, 1))
    return one.unionByName(other)


def held_out_url(url: Column) -> Column:
    """The fold of the labelled URLs that the trees don't learn from."""
    return F.crc32(url.cast("binary")) % 5 == 0
