"""Porter's stemmer, from the algorithm as published (Program 14, 1980), with the usual departures of ROUGE: words of
three letters or fewer stay as they are."""

from __future__ import annotations

import re
from functools import lru_cache


def _kinds(w: str) -> str:
    """v or c for each letter; y is a vowel behind a consonant."""
    out = ""
    for i, c in enumerate(w):
        out += "v" if c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def measure(stem: str) -> int:
    """How many times vowels are followed by consonants."""
    return len(re.findall("v+c+", _kinds(stem)))


def _vowel(stem: str) -> bool:
    return "v" in _kinds(stem)


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _kinds(w)[-1] == "c"


def _cvc(w: str) -> bool:
    return _kinds(w)[-3:] == "cvc" and w[-1] not in "wxy"


_STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _longest(w: str, rules: list[tuple[str, str]]) -> tuple[str, str] | None:
    return max((r for r in rules if w.endswith(r[0])), key=lambda r: len(r[0]), default=None)


@lru_cache(100_000)
def stem(word: str) -> str:
    w = word.lower()
    if len(w) <= 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        if (r := _longest(w, rules)) and measure(w[: -len(r[0])]) > 0:
            w = w[: -len(r[0])] + r[1]
    if r := _longest(w, [(e, "") for e in _STEP4]):
        s = w[: -len(r[0])]
        if measure(s) > 1 and (r[0] != "ion" or s.endswith(("s", "t"))):
            w = s
    if w.endswith("e"):
        m = measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and measure(w) > 1:
        w = w[:-1]
    return w
