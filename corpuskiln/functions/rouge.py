"""ROUGE-1, ROUGE-2 and ROUGE-L F1 with Porter stemming (Lin 2004; Porter 1980), as a pandas UDF."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOWELS = "aeiou"


def _shape(word: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in _VOWELS or c == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(word: str) -> bool:
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


#: Suffixes of Porter's steps 2, 3 and 4 (fixed values).
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _replace(word: str, rules: str, least: int) -> str:
    pairs = [r.split(":") for r in rules.split()]
    for old, new in sorted(pairs, key=lambda r: -len(r[0])):
        if word.endswith(old):
            stem = word[: -len(old)]
            return stem + new if _measure(stem) > least else word
    return word


def stem(word: str) -> str:
    if len(word) < 3:
        return word
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short_end(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(_replace(w, _STEP2, 0), _STEP3, 0)
    for end in sorted(_STEP4.split(), key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if _measure(base) > 1 or _measure(base) == 1 and not _short_end(base):
            w = base
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def tokens(text: str) -> list[str]:
    return [stem(t) if len(t) > 3 else t for t in re.findall("[a-z0-9]+", text.lower())]


def _f1(hits: int, predicted: int, wanted: int) -> float:
    return round(2 * hits / (predicted + wanted), 4) if hits else 0.0


def scores(prediction: str | None, reference: str | None) -> tuple[float, float, float]:
    """(rouge1, rouge2, rougeL); zeros where either side has no words."""
    p, r = tokens(prediction or ""), tokens(reference or "")
    if not p or not r:
        return 0.0, 0.0, 0.0
    out = []
    for n in (1, 2):
        a, b = Counter(zip(*[p[i:] for i in range(n)])), Counter(zip(*[r[i:] for i in range(n)]))
        out.append(_f1((a & b).total(), a.total(), b.total()))
    row = [0] * (len(r) + 1)
    for x in p:
        above = 0
        for j, y in enumerate(r, 1):
            above, row[j] = row[j], above + 1 if x == y else max(row[j], row[j - 1])
    return out[0], out[1], _f1(row[-1], len(p), len(r))


def rouge(prediction: Column, reference: Column) -> Column:
    """struct(rouge1, rouge2, rougeL)."""

    @F.pandas_udf("rouge1 double, rouge2 double, rougeL double")
    def score(p: pd.Series, r: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([scores(a, b) for a, b in zip(p, r)], columns=["rouge1", "rouge2", "rougeL"])

    return score(prediction, reference)
