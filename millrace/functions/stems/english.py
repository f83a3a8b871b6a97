"""English stems, after the published description of the second Porter stemmer (Snowball 2)."""

from __future__ import annotations

import re

from millrace.functions.stems.regions import by_length, ending, first_regions

# Fixed values of the description.
_VOWELS = "aeiouy"
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_LONG_STARTS = ("gener", "commun", "arsen")
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_STEP2 = {
    "ational": "ate", "ization": "ize", "fulness": "ful", "iveness": "ive", "ousness": "ous", "tional": "tion", "biliti": "ble", "lessli": "less", "alism": "al", "aliti": "al", "ation": "ate", "entli": "ent", "fulli": "ful",
    "iviti": "ive", "ousli": "ous", "abli": "able", "alli": "al", "anci": "ance", "ator": "ate", "enci": "ence", "izer": "ize", "bli": "ble", "ogi": "og", "li": "",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "ative": "", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
_STEP4 = by_length("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion")

_ENDS2, _ENDS3 = by_length(" ".join(_STEP2)), by_length(" ".join(_STEP3))
_SHORT = re.compile(f"(?:[^{_VOWELS}][{_VOWELS}][^{_VOWELS}wxY]|^[{_VOWELS}][^{_VOWELS}])$")
_VOWEL = re.compile(f"[{_VOWELS}]")


def _past(w: str, r1: int) -> str:
    """Step 1b: eed, ed and ing with their adverbs."""
    if end := ending(w, ("eedly", "eed")):
        return w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    end = ending(w, ("ingly", "edly", "ing", "ed"))
    if not end or not _VOWEL.search(w[: -len(end)]):
        return w
    w = w[: -len(end)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if w.endswith(_DOUBLES):
        return w[:-1]
    return w + "e" if r1 >= len(w) and _SHORT.search(w) else w


def stem(word: str) -> str:
    if len(word) < 3:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    w = re.sub(f"^y|(?<=[{_VOWELS}])y", "Y", word)
    r1, r2 = first_regions(w, _VOWELS, next((len(s) for s in _LONG_STARTS if w.startswith(s)), 0))
    # Plurals.
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in _KEPT:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    # Compound endings, then simple ones.
    if (end := ending(w, _ENDS2)) and len(w) - len(end) >= r1:
        before = w[: -len(end)][-1:]
        if (end != "ogi" or before == "l") and (end != "li" or before in tuple("cdeghkmnrt")):
            w = w[: -len(end)] + _STEP2[end]
    if (end := ending(w, _ENDS3)) and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + _STEP3[end]
    if (end := ending(w, _STEP4)) and len(w) - len(end) >= r2 and (end != "ion" or w[-4] in "st"):
        w = w[: -len(end)]
    last = len(w) - 1
    if w.endswith("e") and (last >= r2 or (last >= r1 and not _SHORT.search(w[:-1]))) or w.endswith("ll") and last >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
