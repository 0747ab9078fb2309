"""English stems by the published Snowball English algorithm.

Words are lower-case letters and digits, as ``text.tokens`` makes them, so the algorithm's handling of
apostrophes does not apply. Each Arrow batch is reduced to its distinct words first and a worker
remembers the stems it has computed, so the Python rules run about once per distinct word.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

# Fixed values of the algorithm: whole-word exceptions, prefixes that set the first region, and the
# suffixes of each step with their replacements.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky",
    "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_PLURAL = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
REGION_PREFIXES = "gener|commun|arsen"
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize",
    "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic",
    "ful": "", "ness": "", "ative": "",
}
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate",
    "iti", "ous", "ive", "ize", "ion",
)

_VOWEL = re.compile("[aeiouy]")  # a y that counts as a consonant is written Y
_REGION = re.compile("[aeiouy][^aeiouy]")
_PREFIX = re.compile(f"(?:{REGION_PREFIXES})")
_SHORT_END = re.compile("(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
_DOUBLE_END = re.compile("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
_REMEMBERED = 500_000


def _longest(suffixes) -> re.Pattern:
    return re.compile(f"({'|'.join(suffixes)})$")  # the leftmost match is the longest suffix


_PLURAL = _longest(["sses", "ied", "ies", "us", "ss", "s"])
_PAST = _longest(["eedly", "ingly", "edly", "eed", "ing", "ed"])
_ENDS_2, _ENDS_3, _ENDS_4 = _longest(STEP_2), _longest(STEP_3), _longest(STEP_4)


def stem_word(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    w = re.sub("([aeiouy])y", r"\1Y", "Y" + word[1:] if word[0] == "y" else word)
    first = _PREFIX.match(w) or _REGION.search(w)
    r1 = first.end() if first else len(w)
    second = _REGION.search(w, r1)
    r2 = second.end() if second else len(w)

    end = _PLURAL.search(w)
    if end:
        base, suffix = w[: end.start()], end[1]
        if suffix == "sses":
            w = base + "ss"
        elif suffix in ("ied", "ies"):
            w = base + ("i" if len(base) > 1 else "ie")
        elif suffix == "s" and _VOWEL.search(base[:-1]):
            w = base
    if w in KEPT_AFTER_PLURAL:
        return w

    end = _PAST.search(w)
    if end:
        base, suffix = w[: end.start()], end[1]
        if suffix.startswith("eed"):
            w = base + "ee" if len(base) >= r1 else w
        elif _VOWEL.search(base):
            w = _completed(base, r1)
    if len(w) > 2 and w[-1] in "yY" and not _VOWEL.match(w[-2]):
        w = w[:-1] + "i"

    end = _ENDS_2.search(w)
    if end and end.start() >= r1:
        base, suffix = w[: end.start()], end[1]
        if not (suffix == "ogi" and base[-1:] != "l" or suffix == "li" and base[-1:] not in tuple("cdeghkmnrt")):
            w = base + STEP_2[suffix]
    end = _ENDS_3.search(w)
    if end and end.start() >= (r2 if end[1] == "ative" else r1):
        w = w[: end.start()] + STEP_3[end[1]]
    end = _ENDS_4.search(w)
    if end and end.start() >= r2 and (end[1] != "ion" or w[: end.start()].endswith(("s", "t"))):
        w = w[: end.start()]
    base = w[:-1]
    if w.endswith("e") and (len(base) >= r2 or len(base) >= r1 and not _SHORT_END.search(base)):
        w = base
    elif w.endswith("ll") and len(base) >= r2:
        w = base
    return w.lower()


def _completed(base: str, r1: int) -> str:
    """A word after its -ed or -ing was removed."""
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if _DOUBLE_END.search(base):
        return base[:-1]
    return base + "e" if len(base) <= r1 and _SHORT_END.search(base) else base


_known: dict[str, str] = {}


@F.arrow_udf(T.StringType())
def _stems(words: pa.Array) -> pa.Array:
    coded = words.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    if len(_known) > _REMEMBERED:
        _known.clear()
    for word in distinct:
        if word not in _known:
            _known[word] = stem_word(word)
    return pa.array([_known[w] for w in distinct], pa.string()).take(coded.indices)


def stem(word: Column) -> Column:
    """The stem of each word; evaluated once however often the column is used."""
    return _stems.asNondeterministic()(word)
