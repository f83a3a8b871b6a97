"""German stems, after the published Snowball description."""

from __future__ import annotations

import re

_VOWELS = "aeiouyäöü"
_REGION = re.compile(f"[{_VOWELS}][^{_VOWELS}]")
_STEP1 = re.compile(r"(ern|em|er)$|(en|es|e)$|(?<=[bdfghklmnrt])(s)$")
_STEP2 = re.compile(r"(est|en|er)$|(?<=[bdfghklmnt])(st)$")
_STEP3 = re.compile(r"(end|ung|isch|ig|ik|lich|heit|keit)$")
_PLAIN = str.maketrans("äöüUY", "aouuy")


def stem(word: str) -> str:
    w = word.replace("ß", "ss")
    w = re.sub(f"(?<=[{_VOWELS}])([uy])(?=[{_VOWELS}])", lambda m: m[1].upper(), w)
    first = _REGION.search(w)
    r1 = first.end() if first else len(w)
    second = _REGION.search(w, r1)
    r2 = second.end() if second else len(w)
    r1 = max(r1, 3)
    if (m := _STEP1.search(w)) and m.start(m.lastindex) >= r1:
        w = w[: m.start(m.lastindex)]
        if m.lastindex == 2 and w.endswith("niss"):
            w = w[:-1]
    if (m := _STEP2.search(w)) and m.start(m.lastindex) >= r1 and (m.lastindex == 1 or m.start(2) >= 4):
        w = w[: m.start(m.lastindex)]
    if (m := _STEP3.search(w)) and m.start() >= r2:
        ending, rest = m[1], w[: m.start()]
        if ending in ("end", "ung"):
            w = rest[:-2] if rest.endswith("ig") and len(rest) - 2 >= r2 and not rest.endswith("eig") else rest
        elif ending in ("ig", "ik", "isch"):
            w = w if rest.endswith("e") else rest
        elif ending in ("lich", "heit"):
            w = rest[:-2] if rest.endswith(("er", "en")) and len(rest) - 2 >= r1 else rest
        else:
            cut = next((e for e in ("lich", "ig") if rest.endswith(e) and len(rest) - len(e) >= r2), "")
            w = rest[: len(rest) - len(cut)]
    return w.translate(_PLAIN)
