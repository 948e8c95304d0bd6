"""The English (Porter2) stemmer, written from its published description, as a vectorised function."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# Fixed values of the published algorithm: words with a stem of their own, and words that step 1a leaves final.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
FINAL = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
# Fixed values of the published algorithm: suffixes of steps 2 to 4 with their replacements, longest first.
STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("ousness", "ous"), ("iveness", "ive"), ("fulness", "ful"), ("tional", "tion"), ("lessli", "less"), ("entli", "ent"),
    ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("fulli", "ful"), ("ousli", "ous"), ("iviti", "ive"), ("biliti", "ble"), ("enci", "ence"), ("anci", "ance"),
    ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
LI_ENDINGS = "cdeghkmnrt"


def _region(word: str, start: int) -> int:
    """Where the region after the first non-vowel that follows a vowel begins, looking from `start`."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _short_syllable(word: str) -> bool:
    """Whether a word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-1] not in VOWELS + "wxY" and word[-2] in VOWELS and word[-3] not in VOWELS


def _marked_y(word: str) -> str:
    """`word` with every consonant y as Y: at the start and after a vowel."""
    out = []
    for i, c in enumerate(word):
        out.append("Y" if c == "y" and (i == 0 or out[i - 1] in VOWELS) else c)
    return "".join(out)


def _first(word: str, suffixes: tuple) -> tuple | None:
    best = max((s for s in suffixes if word.endswith(s[0])), key=lambda s: len(s[0]), default=None)
    return best


@lru_cache(maxsize=500_000)
def stem(word: str) -> str:
    """The stem of a lower-case English word."""
    if len(word) <= 2:
        return word
    word = word.replace("’", "'").replace("‘", "'").lstrip("'")
    if word in IRREGULAR:
        return IRREGULAR[word]
    word = _marked_y(word)
    prefix = re.match("gener|commun|arsen", word)
    r1 = prefix.end() if prefix else _region(word, 0)
    r2 = _region(word, r1)
    # step 0 and 1a: possessives and plurals
    word = re.sub("('s'|'s|')$", "", word)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and any(c in VOWELS for c in word[:-2]):
        word = word[:-1]
    if word in FINAL:
        return word
    # step 1b: past and progressive
    if word.endswith(("eed", "eedly")):
        cut = 5 if word.endswith("eedly") else 3
        if len(word) - cut >= r1:
            word = word[:-cut] + "ee"
    else:
        ending = next((s for s in ("ingly", "edly", "ing", "ed") if word.endswith(s)), None)
        if ending and any(c in VOWELS for c in word[: -len(ending)]):
            word = word[: -len(ending)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif word.endswith(DOUBLES):
                word = word[:-1]
            elif r1 >= len(word) and _short_syllable(word):
                word += "e"
    # step 1c: y to i
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    # step 2
    found = _first(word, STEP2)
    if found and len(word) - len(found[0]) >= r1:
        base = word[: -len(found[0])]
        if (found[0] != "ogi" or base.endswith("l")) and (found[0] != "li" or base[-1:] in LI_ENDINGS and base):
            word = base + found[1]
    # step 3
    found = _first(word, STEP3)
    if found and len(word) - len(found[0]) >= (r2 if found[0] == "ative" else r1):
        word = word[: -len(found[0])] + found[1]
    # step 4
    ending = next((s for s in STEP4 if word.endswith(s)), None)
    if ending and len(word) - len(ending) >= r2 and (ending != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(ending)]
    # step 5
    if word.endswith("e") and (len(word) > r2 or len(word) > r1 and not _short_syllable(word[:-1])):
        word = word[:-1]
    elif word.endswith("ll") and len(word) > r2:
        word = word[:-1]
    return word.replace("Y", "y")


def stemmed(tokens: Column) -> Column:
    """Stem of the lower-cased token. A batch's distinct tokens are stemmed once, and a worker keeps what it has stemmed."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(column)
        stems = pd.Series([stem(t) for t in distinct] + [None], dtype=object)
        return stems.iloc[codes].reset_index(drop=True)

    return run(F.lower(tokens))
