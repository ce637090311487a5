"""The English (Porter2) stemmer, from its published description."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = "cdeghkmnrt"
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_STAY_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"),
    ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"),
    ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]
_REGION = re.compile(r"[aeiouy][^aeiouy]")


def _after(word: str, start: int) -> int:
    m = _REGION.search(word, start)
    return m.end() if m else len(word)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _VOWELS and w[1] not in _VOWELS
    return len(w) > 2 and w[-1] not in _VOWELS + "wxY" and w[-2] in _VOWELS and w[-3] not in _VOWELS


def _has_vowel(w: str) -> bool:
    return any(c in _VOWELS for c in w)


@lru_cache(200_000)
def porter2(word: str) -> str:
    """The stem of a lower-case English word; other words come out much as they are. Doesn't lower-case."""
    if len(word) <= 2:
        return word
    w = word.replace("’", "'").replace("‘", "'").replace("‛", "'")
    if w[0] == "'":
        w = w[1:]
    if w in _SPECIAL:
        return _SPECIAL[w]
    if w[:1] == "y":
        w = "Y" + w[1:]
    w = re.sub(r"(?<=[aeiouy])y", "Y", w)
    for prefix in ("gener", "commun", "arsen"):
        if w.startswith(prefix):
            r1 = len(prefix)
            break
    else:
        r1 = _after(w, 0)
    r2 = _after(w, r1)

    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _has_vowel(w[:-2]):
        w = w[:-1]
    if w in _STAY_AFTER_1A:
        return w
    # 1b
    for end in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if not w.endswith(end):
            continue
        if end in ("eedly", "eed"):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + "ee"
        elif _has_vowel(w[: -len(end)]):
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(_DOUBLES):
                w = w[:-1]
            elif r1 >= len(w) and _short_end(w):
                w += "e"
        break
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    # 2
    for end, to in _STEP2:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and (end != "ogi" or w[at - 1 : at] == "l") and (end != "li" or w[at - 1 : at] in _LI and at > 0):
                w = w[:at] + to
            break
    # 3
    for end, to in _STEP3:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and (end != "ative" or at >= r2):
                w = w[:at] + to
            break
    # 4
    for end in _STEP4:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r2 and (end != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    # 5
    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or at >= r1 and not _short_end(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def _stems(tokens: pd.Series) -> pd.Series:
    # Each distinct token of a batch once; frequent ones come from the worker's memory.
    codes, distinct = pd.factorize(tokens, use_na_sentinel=True)
    stems = pd.Series([porter2(t) for t in distinct] + [None], dtype=object)
    return pd.Series(stems.to_numpy()[codes])


def stem(token: Column) -> Column:
    """The English stem of a token; null for null. No shuffle: stems are looked up where the tokens are."""
    return F.pandas_udf(_stems, "string")(token)
