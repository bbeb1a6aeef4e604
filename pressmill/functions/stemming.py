"""Words of a text for keyword search: the published English stemmer (Snowball "English", Porter's second) and stop words.

`entries` gives each text's words with their places in one Arrow pass; a worker stems a word once, as words repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The published English stop words.
STOPS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
    itself they them their theirs themselves what which who whom this that these those am is are was were be been being have
    has had having do does did doing a an the and but if or because as until while of at by for with about against between
    into through during before after above below to from up down in out on off over under again further then once here there
    when where why how all any both each few more most other some such no nor not only own same so than too very s t can will
    just don should now""".split()
)
# Fixed values of the published stemmer.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
SPECIAL |= {w: w for w in "sky news howe atlas cosmos bias andes".split()}
DONE_EARLY = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP_2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split(), "")
LONG_STARTS = ("gener", "commun", "arsen")

_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT_END = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_VOWEL = re.compile(r"[aeiouy]")


def _after(word: str, start: int) -> int:
    """Where the region after the first consonant that follows a vowel begins, from `start` on."""
    m = _REGION.search(word, start)
    return m.end() if m else len(word)


def _ending(word: str, endings) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


@lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = word.removeprefix("'")
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    r1 = next((len(p) for p in LONG_STARTS if w.startswith(p)), None)
    r1 = _after(w, 0) if r1 is None else r1
    r2 = _after(w, r1)
    w = w.removesuffix(_ending(w, ("'", "'s", "'s'")))
    w = _plural(w)
    if w in DONE_EARLY:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    for table, step in ((STEP_2, 2), (STEP_3, 3), (STEP_4, 4)):
        end = _ending(w, table)
        cut = len(w) - len(end)
        if not end or cut < (r2 if step == 4 or end == "ative" else r1):
            continue
        before = w[cut - 1 : cut]
        if (end == "ogi" and before != "l") or (end == "li" and before not in tuple("cdeghkmnrt")) or (end == "ion" and before not in ("s", "t")):
            continue
        w = w[:cut] + table[end]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT_END.search(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        return w[:-1]
    return w


def _past(w: str, r1: int) -> str:
    end = _ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    cut = len(w) - len(end)
    if end in ("eed", "eedly"):
        return w[:cut] + "ee" if cut >= r1 else w
    if not end or not _VOWEL.search(w[:cut]):
        return w
    w = w[:cut]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if w.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
        return w[:-1]
    return w + "e" if _SHORT_END.search(w) and len(w) <= r1 else w


ANALYZERS = {"english": lambda w: "" if w in STOPS else stem(w), "simple": lambda w: w}
WORD = r"[\p{L}\p{N}][\p{L}\p{N}']*"


def words(text: Column) -> Column:
    """Lower-case words in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def query_words(text: str) -> list[str]:
    return re.findall(r"[^\W_][^\W_']*(?:'[^\W_']*)*", text.lower())


def entries(analyzer: str):
    """Column function: the terms of an array of words with their places from 1. Stop words have a place but no entry."""
    term_of = ANALYZERS[analyzer]

    @F.pandas_udf("array<struct<term:string,places:array<int>>>")
    def placed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for row in batch:
                found: dict[str, list[int]] = {}
                for place, word in enumerate(() if row is None else row, 1):
                    term = term_of(word)
                    if term:
                        found.setdefault(term, []).append(place)
                out.append([{"term": t, "places": p} for t, p in found.items()])
            yield pd.Series(out)

    return placed
