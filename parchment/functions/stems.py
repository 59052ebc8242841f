"""English stems by the published Snowball rules ("Porter 2"), for words in lower case."""

from __future__ import annotations

import re
from functools import lru_cache

#: Words with stems of their own, and words that are left as they are after their plural ending.
EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
              "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
SETTLED = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
#: Endings and what they become, the longest first where they overlap.
SECOND = (("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ization", "ize"), ("ousness", "ous"), ("biliti", "ble"), ("lessli", "less"), ("tional", "tion"), ("alism", "al"), ("aliti", "al"), ("ation", "ate"), ("entli", "ent"),
          ("fulli", "ful"), ("iviti", "ive"), ("ousli", "ous"), ("abli", "able"), ("alli", "al"), ("anci", "ance"), ("ator", "ate"), ("enci", "ence"), ("izer", "ize"), ("bli", "ble"), ("ogi", "og"), ("li", ""))
THIRD = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("ative", ""), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", ""))
FOURTH = ("ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ion", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic")
_V = "aeiouy"
_AFTER, _VOWEL = re.compile(rf"[{_V}][^{_V}]"), re.compile(f"[{_V}]")
_SECOND_ENDS, _THIRD_ENDS = tuple(end for end, _ in SECOND), tuple(end for end, _ in THIRD)


def _after_vowel(word: str, start: int) -> int:
    """Where the part begins that follows the first consonant after a vowel."""
    m = _AFTER.search(word, start)
    return m.end() if m else len(word)


def _short(word: str) -> bool:
    """Whether a word ends in a short syllable."""
    return bool(re.search(rf"(?:^|[^{_V}])[{_V}][^{_V}wxY]$", word) if len(word) > 2 else re.fullmatch(rf"[{_V}][^{_V}]", word))


def _doubled(word: str) -> bool:
    return word[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    w = re.sub(rf"(?<=[{_V}])y|^y", "Y", word) if "y" in word else word
    first = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or _after_vowel(w, 0)
    second = _after_vowel(w, first)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in SETTLED:
        return w.lower()
    # past and progressive
    past = w.endswith(("ed", "ing", "edly", "ingly"))  # few words go on to the patterns
    if past and (m := re.search(r"eed(?:ly)?$", w)):
        if m.start() >= first:
            w = w[: m.start()] + "ee"
    elif past and (m := re.search(r"(?:ed|ing)(?:ly)?$", w)) and _VOWEL.search(w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _doubled(w):
            w = w[:-1]
        elif _short(w) and first >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    # endings of derived words
    for end, new in SECOND if w.endswith(_SECOND_ENDS) else ():
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= first and (end != "ogi" or w[at - 1] == "l") and (end != "li" or w[at - 1] in "cdeghkmnrt"):
                w = w[:at] + new
            break
    for end, new in THIRD if w.endswith(_THIRD_ENDS) else ():
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= first and (end != "ative" or at >= second):
                w = w[:at] + new
            break
    for end in FOURTH if w.endswith(FOURTH) else ():
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= second and (end != "ion" or w[at - 1] in "st"):
                w = w[:at]
            break
    at = len(w) - 1
    if w.endswith("e") and (at >= second or (at >= first and not _short(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and at >= second:
        w = w[:-1]
    return w.lower()
