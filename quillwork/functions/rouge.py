"""ROUGE: n-gram overlap in SQL functions, longest common subsequences in an Arrow function."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .porter import stem
from .text import ngrams, safe_div, text_of

SCORES = "r1p double, r1r double, r1f double, r2p double, r2r double, r2f double, rlp double, rlr double, rlf double, rsp double, rsr double, rsf double"


def plain_tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits in lower case, as ROUGE takes them, without stemming."""
    return F.filter(F.split(F.regexp_replace(F.lower(text_of(c)), "[^a-z0-9]+", " "), " "), lambda t: t != "")


def _counts(a: Column) -> Column:
    """The multiset as a set: the third "a" becomes (a, 3)."""

    def numbered(s: Column) -> Column:
        return F.transform(s, lambda x, i: F.struct(x.alias("x"), (i - F.array_position(s, x) + 1).cast("int").alias("k")))

    return F.transform(F.array(F.sort_array(a)), numbered)[0]


def rouge_n(prediction: Column, target: Column, n: int) -> Column:
    """Precision, recall and F of the common n-grams, without stemming; repeats count."""

    def score(x: Column) -> Column:
        both = F.size(F.array_intersect(_counts(x["p"]), _counts(x["t"])))
        return F.struct(both.alias("n"), F.size(x["p"]).alias("p"), F.size(x["t"]).alias("t"))

    # as lambdas, so that the n-grams are made once
    token = F.array(F.struct(plain_tokens(prediction).alias("p"), plain_tokens(target).alias("t")))
    grams = F.transform(token, lambda x: F.struct(ngrams(x["p"], n).alias("p"), ngrams(x["t"], n).alias("t")))
    shares = F.transform(
        F.transform(grams, score),
        lambda c: F.struct(safe_div(c["n"], c["p"]).alias("precision"), safe_div(c["n"], c["t"]).alias("recall"), safe_div(2 * c["n"], c["p"] + c["t"]).alias("f")),
    )
    return shares[0]


def word_list(text: str | None, stemmed: bool = True) -> list[str]:
    found = re.findall("[a-z0-9]+", (text or "").lower())
    return [stem(w) if stemmed and len(w) > 3 else w for w in found]


def _table(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of all prefixes."""
    code = {w: i for i, w in enumerate(dict.fromkeys(a + b))}
    y = np.array([code[w] for w in b])
    out = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i, w in enumerate(a, 1):
        row = np.maximum(out[i - 1, 1:], out[i - 1, :-1] + (y == code[w]))
        out[i, 1:] = np.maximum.accumulate(row)
    return out


def lcs_length(a: list[str], b: list[str]) -> int:
    return int(_table(a, b)[-1, -1]) if a and b else 0


def _hit(a: list[str], b: list[str]) -> set[int]:
    """Places of ``a`` on a longest common subsequence with ``b``."""
    t, i, j, out = _table(a, b), len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.add(i - 1)
            i, j = i - 1, j - 1
        elif t[i - 1, j] > t[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return out


def _prf(both: float, p: int, t: int) -> list[float]:
    precision, recall = (both / p if p else 0.0), (both / t if t else 0.0)
    return [precision, recall, 2 * precision * recall / (precision + recall) if precision + recall else 0.0]


def rouge_scores(prediction: str | None, target: str | None, stemmed: bool = True) -> list[float]:
    """Precision, recall, F of ROUGE-1, -2, -L and -Lsum; the last joins the hits of each target line with all predicted lines."""
    p, t = word_list(prediction, stemmed), word_list(target, stemmed)
    out: list[float] = []
    for n in (1, 2):
        a, b = (Counter(zip(*(x[k:] for k in range(n)))) for x in (p, t))
        out += _prf(sum((a & b).values()), sum(a.values()), sum(b.values()))
    out += _prf(lcs_length(p, t), len(p), len(t))
    lines = [[word_list(s, stemmed) for s in (x or "").split("\n") if s] for x in (prediction, target)]
    left = [Counter(w for s in part for w in s) for part in lines]
    hits = 0
    for s in lines[1]:
        for i in sorted(set().union(*(_hit(s, q) for q in lines[0] if s and q))):
            if left[0][s[i]] > 0 and left[1][s[i]] > 0:
                hits += 1
                left[0][s[i]] -= 1
                left[1][s[i]] -= 1
    return out + _prf(hits, *(sum(map(len, part)) for part in lines))


def rouge(prediction: Column, target: Column, stemmed: bool = True) -> Column:
    """All scores, as a struct of ``SCORES``."""
    names = [f.split()[0] for f in SCORES.split(", ")]
    score = F.pandas_udf(lambda p, t: pd.DataFrame([rouge_scores(a, b, stemmed) for a, b in zip(p, t)], columns=names), SCORES)
    return score(prediction, target)
