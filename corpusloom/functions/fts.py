"""The full-text query language: sanitising, parsing, and the two analyzers."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

OPERATORS = ("AND", "OR", "NOT")
_STRIPPED = str.maketrans("", "", '"*^:{}()[]')


def safe_query(query: str) -> str:
    """Words quoted, stripped of the characters that mean something in the language; AND, OR and NOT kept; empty words dropped."""
    out = []
    for token in query.split():
        if token in OPERATORS:
            out.append(token)
        elif token := token.translate(_STRIPPED):
            out.append(f'"{token}"')
    return " ".join(out)


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]


@dataclass(frozen=True)
class Node:
    """An operator and its operands; ``none`` never matches."""

    kind: str
    parts: tuple = ()


EMPTY, NONE = Node("empty"), Node("none")


class QuerySyntaxError(ValueError):
    pass


def parse(query: str, analyze) -> Phrase | Node:
    """The tree of a sanitised query. Adjacent phrases bind closest, then NOT (to the left), AND, OR.

    A phrase without terms is ignored among adjacent ones and under OR, satisfies nothing under AND or
    left of NOT, and takes nothing away right of it.
    """
    tokens = re.findall(r'"[^"]*"|\S+', query)
    at = 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def run() -> Phrase | Node:
        nonlocal at
        phrases, any_ = [], False
        while (t := peek()) is not None and t not in OPERATORS:
            any_ = True
            terms = tuple(analyze(t.strip('"')))
            if terms:
                phrases.append(Phrase(terms))
            at += 1
        if not any_:
            raise QuerySyntaxError("a phrase is missing")
        return EMPTY if not phrases else phrases[0] if len(phrases) == 1 else Node("and", tuple(phrases))

    def level(operator: str, below, join) -> Phrase | Node:
        nonlocal at
        out = below()
        while peek() == operator:
            at += 1
            out = join(out, below())
        return out

    def but(a, b):
        return NONE if a in (EMPTY, NONE) else a if b in (EMPTY, NONE) else Node("not", (a, b))

    def both(a, b):
        return NONE if EMPTY in (a, b) or NONE in (a, b) else Node("and", (a, b))

    def either(a, b):
        kept = [x for x in (a, b) if x not in (EMPTY, NONE)]
        return NONE if not kept else kept[0] if len(kept) == 1 else Node("or", tuple(kept))

    tree = level("OR", lambda: level("AND", lambda: level("NOT", run, but), both), either)
    if at < len(tokens):
        raise QuerySyntaxError(f"unexpected {tokens[at]}")
    return tree


def phrases(tree: Phrase | Node) -> list[Phrase]:
    """The phrases of a tree, left to right, repeats kept."""
    return [tree] if isinstance(tree, Phrase) else [p for part in tree.parts for p in phrases(part)]


def plain(text: str) -> list[str]:
    """Runs of ASCII letters and digits, lower-cased; no stemming."""
    return re.findall(r"[a-z0-9]+", text.lower())


@lru_cache(maxsize=65536)
def _folded(ch: str) -> str:
    """A character as it is indexed: folded, without its mark; nothing for a lone mark; a blank if it separates."""
    kind = unicodedata.category(ch)
    if kind[0] == "M":
        return ""
    if kind[0] not in "LN" and kind != "Co":
        return " "
    low = ch.lower()
    low = low if len(low) == 1 else ch
    base = unicodedata.normalize("NFD", low)
    if len(base) > 1 and all(unicodedata.category(c) == "Mn" for c in base[1:]):
        return base[0]
    return low


def stemmed(text: str) -> list[str]:
    """Runs of letters and digits of any script, folded, without diacritics, stemmed."""
    return [stem(t) for t in "".join(map(_folded, text)).split()]


_VOWELS = "aeiou"


def _cons(w: str, i: int) -> bool:
    return w[i] not in _VOWELS and (w[i] != "y" or i == 0 or not _cons(w, i - 1))


def _measure(w: str) -> int:
    kinds = re.sub(r"(.)\1+", r"\1", "".join("c" if _cons(w, i) else "v" for i in range(len(w))))
    return kinds.count("vc")


def _vowel(w: str) -> bool:
    return any(not _cons(w, i) for i in range(len(w)))


def _cvc(w: str) -> bool:
    return len(w) >= 3 and _cons(w, len(w) - 1) and not _cons(w, len(w) - 2) and _cons(w, len(w) - 3) and w[-1] not in "wxy"


_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


@lru_cache(maxsize=262144)
def stem(word: str) -> str:
    """Porter's algorithm (1980), on the bytes of a word: those of letters beyond ASCII are consonants."""
    w = word.encode("utf-8", "surrogatepass").decode("latin-1")
    return _stem(w).encode("latin-1").decode("utf-8", "surrogatepass") if 2 < len(w) < 64 else word


def _stem(w: str) -> str:
    if w.endswith("s"):
        cut_two = (len(w) > 4 and w.endswith("sses")) or (len(w) > 3 and w.endswith("ies"))
        w = w[:-2] if cut_two else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = 2 if w.endswith("ed") and _vowel(w[:-2]) else 3 if w.endswith("ing") and _vowel(w[:-3]) else 0
        if cut:
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _cons(w, len(w) - 1) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        best = max((r for r in rules if w.endswith(r[0])), key=lambda r: len(r[0]), default=None)
        if best and _measure(w[: -len(best[0])]) > 0:
            w = w[: -len(best[0])] + best[1]
    best = max((e for e in _STEP4 if w.endswith(e)), key=len, default=None)
    if best and _measure(w[: -len(best)]) > 1 and (best != "ion" or w[: -len(best)].endswith(("s", "t"))):
        w = w[: -len(best)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w
