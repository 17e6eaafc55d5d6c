"""The Porter stemmer (M. F. Porter, "An algorithm for suffix stripping", 1980), written from the published rules."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffix tables of steps 2, 3 and 4.
_STEP2 = dict(x.split(":") for x in "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split())
_STEP3 = dict(x.split(":") for x in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(w: str) -> str:
    """Consonants as c, vowels as v; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _cvc(w: str) -> bool:
    return len(w) > 2 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _swap(w: str, table: dict[str, str]) -> str:
    for s in sorted(table, key=len, reverse=True):
        if w.endswith(s):
            stem = w[: -len(s)]
            return stem + table[s] if _measure(stem) > 0 else w
    return w


@lru_cache(maxsize=200_000)
def stem(w: str) -> str:
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    # step 1a: plurals
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    # step 1b: past tenses
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = w[:-2] if w.endswith("ed") else w[:-3] if w.endswith("ing") else None
        if cut is not None and "v" in _shape(cut):
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    # step 1c
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, _STEP2), _STEP3)
    # step 4
    for s in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(s):
            cut = w[: -len(s)]
            if _measure(cut) > 1 and (s != "ion" or cut[-1:] in ("s", "t")):
                w = cut
            break
    # step 5
    if w.endswith("e"):
        cut = w[:-1]
        if _measure(cut) > 1 or (_measure(cut) == 1 and not _cvc(cut)):
            w = cut
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def _stem_all(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda ws: None if ws is None else [stem(w) for w in ws])


def stems(tokens: Column) -> Column:
    """Each array of words as stems."""
    return F.pandas_udf(_stem_all, "array<string>")(tokens)
