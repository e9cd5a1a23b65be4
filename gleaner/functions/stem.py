"""Porter's stemmer and diacritic folding, as vectorised functions for distinct terms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďđēĕėęěğĩīĭįłńňōŏőŕřśşšťţũūŭůűųźżž"
_PLAIN = "".join(unicodedata.normalize("NFD", c)[0] if unicodedata.normalize("NFD", c)[0] != c else {"đ": "d", "ł": "l"}.get(c, c) for c in _ACCENTED)


def fold(x: Column) -> Column:
    """Latin letters without their diacritics."""
    return F.translate(x, _ACCENTED, _PLAIN)


def fold_text(text: str) -> str:
    """fold for a query's words on the driver."""
    return text.translate(str.maketrans(_ACCENTED, _PLAIN))


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def _vowel(w: str, i: int) -> bool:
    return w[i] in "aeiou" or w[i] == "y" and i > 0 and not _vowel(w, i - 1)


def _measure(w: str) -> int:
    shape = "".join("v" if _vowel(w, i) else "c" for i in range(len(w)))
    return sum(1 for a, b in zip(shape, shape[1:], strict=False) if a == "v" and b == "c")


def _has_vowel(w: str) -> bool:
    return any(_vowel(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and not _vowel(w, len(w) - 1)


def _short(w: str) -> bool:
    n = len(w)
    return n > 2 and not _vowel(w, n - 3) and _vowel(w, n - 2) and not _vowel(w, n - 1) and w[-1] not in "wxy"


# Suffixes of the published algorithm's steps 2 to 4.
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _swap(w: str, table: tuple) -> str:
    for suffix, new in sorted(table, key=lambda x: -len(x[0])):
        if w.endswith(suffix):
            root = w[: -len(suffix)]
            return root + new if _measure(root) > 0 else w
    return w


def porter(w: str) -> str:
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(suffix):
            w = w[: len(w) - len(suffix)] + new
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix) and _has_vowel(w[: -len(suffix)]):
                w = w[: -len(suffix)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, STEP2), STEP3)
    for suffix in sorted(STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            root = w[: -len(suffix)]
            if _measure(root) > 1 and (suffix != "ion" or root.endswith(("s", "t"))):
                w = root
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    return w[:-1] if _measure(w) > 1 and _double(w) and w.endswith("l") else w


@F.pandas_udf(StringType())
def stem(terms: pd.Series) -> pd.Series:
    return terms.map(lambda t: None if t is None else porter(t))
