"""English stemming by Porter's second algorithm, as full-text search uses it."""

from __future__ import annotations

import re
from functools import lru_cache

_VOWEL, _OTHER = "[aeiouy]", "[^aeiouy]"
_REGION = re.compile(f"{_VOWEL}{_OTHER}")
_SHORT = re.compile(f"(?:(?:^|.*{_OTHER}){_VOWEL}[^aeiouywxY]|^{_VOWEL}{_OTHER})$")
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Words with a stem of their own, words that stay, and those that stay once a plural s is gone (fixed values).
_OWN = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
} | {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
_STAY = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
#: Endings and what takes their place, the longer ones first.
_SECOND = [
    ("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ization", "ize"), ("ousness", "ous"), ("biliti", "ble"), ("lessli", "less"), ("tional", "tion"), ("alism", "al"), ("aliti", "al"), ("ation", "ate"), ("entli", "ent"),
    ("fulli", "ful"), ("iviti", "ive"), ("ousli", "ous"), ("abli", "able"), ("alli", "al"), ("anci", "ance"), ("ator", "ate"), ("enci", "ence"), ("izer", "ize"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
_THIRD = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("ative", ""), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
_FOURTH = ["ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ion", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic"]


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin: behind the first non-vowel that follows a vowel, and the same once more."""
    first = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    if first is None:
        m = _REGION.search(word)
        first = m.end() if m else len(word)
    m = _REGION.search(word, first)
    return first, m.end() if m else len(word)


def _vowel_in(part: str) -> bool:
    return re.search(_VOWEL, part) is not None


def _first(word: str) -> str:
    """Plurals and participles, and a final y."""
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _vowel_in(word[:-2]):
        word = word[:-1]
    if word in _STAY:
        return word
    r1, _ = _regions(word)
    if word.endswith(("eed", "eedly")):
        end = "eedly" if word.endswith("eedly") else "eed"
        if len(word) - len(end) >= r1:
            word = word[: -len(end)] + "ee"
    else:
        end = next((e for e in ("ingly", "edly", "ing", "ed") if word.endswith(e)), None)
        if end and _vowel_in(word[: -len(end)]):
            word = word[: -len(end)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif word.endswith(_DOUBLES):
                word = word[:-1]
            elif _SHORT.match(word) and _regions(word)[0] >= len(word):
                word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    return word


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in _OWN:
        return _OWN[word]
    word = word.removeprefix("'")
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)  # a y that stands for a consonant
    word = re.sub(r"('s'|'s|')$", "", word)
    word = _first(word)
    if word in _STAY:
        return word.replace("Y", "y")
    r1, r2 = _regions(word)
    for end, new in _SECOND:
        if word.endswith(end):
            before = word[: -len(end)]
            if len(before) >= r1 and (end != "ogi" or before.endswith("l")) and (end != "li" or before[-1:] in tuple("cdeghkmnrt")):
                word = before + new
            break
    for end, new in _THIRD:
        if word.endswith(end):
            if len(word) - len(end) >= (r2 if end == "ative" else r1):
                word = word[: -len(end)] + new
            break
    for end in _FOURTH:
        if word.endswith(end):
            before = word[: -len(end)]
            if len(before) >= r2 and (end != "ion" or before.endswith(("s", "t"))):
                word = before
            break
    if word.endswith("e"):
        at = len(word) - 1
        if at >= r2 or at >= r1 and not _SHORT.match(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")
