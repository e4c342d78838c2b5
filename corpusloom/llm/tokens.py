"""Words of texts as 64-bit codes, for the operators that work on arrays in numpy."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Codes(dict):
    """Word -> code, remembered up to a bound."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        code = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) >= self.most:
            self.clear()
        self[word] = code
        return code

    def of(self, text: str | None) -> np.ndarray:
        """Codes of the lower-cased words (runs of letters, digits and ``_``) of the whole text."""
        found = _WORD.findall(text.lower()) if text else []
        return np.fromiter(map(self.__getitem__, found), dtype=np.uint64, count=len(found))


def shingles(codes: np.ndarray, k: int) -> np.ndarray:
    """Codes of the runs of k words; of all words, where there are fewer; none of none."""
    if not len(codes):
        return codes
    k = min(k, len(codes))
    out = codes[: len(codes) - k + 1].copy()
    for j in range(1, k):
        out = out * np.uint64(1099511628211) + codes[j : len(codes) - k + 1 + j]
    out ^= out >> np.uint64(32)
    out *= _MIX
    return out ^ (out >> np.uint64(29))
