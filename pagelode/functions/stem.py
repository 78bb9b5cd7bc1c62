"""Porter's suffix-stripping algorithm (Program 14(3), 1980) for English words.

The rules are data; :func:`stem_word` applies them. :func:`stem_tokens` stems the
distinct words of each Arrow batch once, so the cost follows the vocabulary and
needs no shuffle.
"""

from __future__ import annotations

import re
import sys

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

# Suffix -> replacement, longest match first within a step.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance",
    "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate",
    "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic",
    "ful": "", "ness": "",
}
STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
]

_MEASURE = re.compile("v+c+")


def _shape(stem: str) -> str:
    """Consonant/vowel pattern, e.g. ``tree`` -> ``ccvv``."""
    shape = ""
    for i, letter in enumerate(stem):
        vowel = letter in "aeiou" or (letter == "y" and i > 0 and shape[-1] == "c")
        shape += "v" if vowel else "c"
    return shape


def _measure(stem: str) -> int:
    return len(_MEASURE.findall(_shape(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double_consonant(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


def _short_end(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _replace_longest(word: str, rules: dict[str, str]) -> str:
    for suffix in sorted(rules, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + rules[suffix] if _measure(stem) > 0 else word
    return word


def _plural(word: str) -> str:
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            return word[: -len(suffix)] + new
    return word


def _past_and_gerund(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        stem = word[: -len(suffix)]
        if word.endswith(suffix) and _has_vowel(stem):
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _double_consonant(stem) and stem[-1] not in "lsz":
                return stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem
    return word


def _drop_ending(word: str) -> str:
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            fits = suffix != "ion" or stem.endswith(("s", "t"))
            return stem if fits and _measure(stem) > 1 else word
    return word


def _tidy(word: str) -> str:
    if word.endswith("e"):
        stem = word[:-1]
        measure = _measure(stem)
        if measure > 1 or (measure == 1 and not _short_end(stem)):
            word = stem
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def stem_word(word: str) -> str:
    """Stem of a lower-case word of three characters or more.

    Letters outside a-z and digits count as consonants.
    """
    if len(word) < 3:
        return word
    word = _past_and_gerund(_plural(word))
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _replace_longest(_replace_longest(word, STEP_2), STEP_3)
    return _tidy(_drop_ending(word))


def _stem_lists(tokens: pa.Array) -> pa.Array:
    words = tokens.flatten().dictionary_encode()
    stems = pa.array([stem_word(w) for w in words.dictionary.to_pylist()], pa.string())
    lengths = tokens.value_lengths().fill_null(0)
    offsets = pa.array([0, *pd.Series(lengths.to_numpy()).cumsum()], pa.int32())
    return pa.ListArray.from_arrays(offsets, stems.take(words.indices))


def stem_tokens(tokens: Column | str) -> Column:
    """Stemmed copy of a token array; a null array gives an empty one."""
    return F.arrow_udf(_stem_lists, "array<string>")(tokens)


# Executors get this code inside the task and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
