"""Porter's 1980 suffix-stripping algorithm, applied to token arrays in Arrow batches.

Each word is stemmed once per worker and then served from a memo, so the cost per
token is a dictionary lookup.  No shuffle is involved, unlike a vocabulary join.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Suffix tables of the published algorithm (steps 2, 3 and 4).
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "",
    "ness": "",
}
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)


def _shape(word: str) -> str:
    """The word as a string of c (consonant) and v (vowel)."""
    shape = ""
    for i, letter in enumerate(word):
        vowel = letter in "aeiou" or (letter == "y" and i > 0 and shape[-1] == "c")
        shape += "v" if vowel else "c"
    return shape


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _ends_double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _ends_cvc(word: str) -> bool:
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _plurals_and_participles(word: str) -> str:
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]

    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    suffix = _longest(word, ("ed", "ing"))
    if suffix is None or "v" not in _shape(word[:-len(suffix)]):
        return word
    word = word[:-len(suffix)]
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if _ends_double(word) and word[-1] not in "lsz":
        return word[:-1]
    return word + "e" if _measure(word) == 1 and _ends_cvc(word) else word


def _swap(word: str, table: dict[str, str]) -> str:
    suffix = _longest(word, table)
    if suffix is not None and _measure(word[:-len(suffix)]) > 0:
        return word[:-len(suffix)] + table[suffix]
    return word


def _strip(word: str) -> str:
    suffix = _longest(word, STEP4)
    if suffix is None:
        return word
    stem = word[:-len(suffix)]
    if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
        return stem
    return word


def _tidy(word: str) -> str:
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _ends_cvc(stem)):
            word = stem
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    """The Porter stem of a lower-case word; words of one or two letters stay."""
    if len(word) < 3:
        return word
    word = _plurals_and_participles(word)
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    return _tidy(_strip(_swap(_swap(word, STEP2), STEP3)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stem_batch(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda row: [stem(t) for t in row])


def stem_array(tokens: Column) -> Column:
    """Stem every token of an array column."""
    return _stem_batch(tokens)
