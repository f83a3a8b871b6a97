"""French stems, after the published Snowball description (2.0: ë and ï are H with the plain letter inside)."""

from __future__ import annotations

import re

from millrace.functions.stems.regions import by_length, ending, first_regions

# Fixed values of the description.
_VOWELS = "aeiouyâàëéêèïîôûù"
_STANDARD = {
    "plain": "ance iqUe isme able iste eux ances iqUes ismes ables istes",
    "ation": "atrice ateur ation atrices ateurs ations",
    "logie": "logie logies",
    "ution": "usion ution usions utions",
    "ence": "ence ences",
    "ement": "ement ements",
    "ité": "ité ités",
    "if": "if ive ifs ives",
    "eaux": "eaux",
    "aux": "aux",
    "euse": "euse euses",
    "issement": "issement issements",
    "amment": "amment",
    "emment": "emment",
    "ment": "ment ments",
}
_VERBS_I = by_length(
    "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it"
)
_VERBS_E = by_length("é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez")
_VERBS_A = by_length("âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions")
_RESIDUAL = by_length("ion ier ière Ier Ière e")

_KIND = {e: kind for kind, words in _STANDARD.items() for e in words.split()}
_ENDS = by_length(" ".join(_KIND))
_VERBS = by_length(" ".join(("ions", *_VERBS_E, *_VERBS_A)))
_BACK = {"He": "ë", "Hi": "ï", "H": "", "I": "i", "U": "u", "Y": "y"}


def _marked(word: str) -> str:
    """Letters that count as consonants in upper case: u and i between vowels, y beside one, u after q."""
    out = list(word)
    for i, c in enumerate(word):
        before, after = word[i - 1] if i else "", word[i + 1 : i + 2]
        left = bool(before) and before in _VOWELS and out[i - 1] == before
        right = bool(after) and after in _VOWELS
        if c == "u" and (before == "q" or (left and right)) or c == "i" and left and right or c == "y" and (left or right):
            out[i] = c.upper()
    return "".join(out).replace("ë", "He").replace("ï", "Hi")


def _verb_region(w: str) -> int:
    if len(w) > 2 and w[0] in _VOWELS and w[1] in _VOWELS or w.startswith(("par", "col", "tap")):
        return 3
    found = re.compile(f"[{_VOWELS}]").search(w, 1)
    return found.end() if found else len(w)


def _standard(w: str, rv: int, r1: int, r2: int) -> tuple[str, bool]:
    """w after the first step, and whether that step is all (else the verbs' steps follow)."""
    end = ending(w, _ENDS)
    if not end:
        return w, False
    kind, base = _KIND[end], w[: -len(end)]
    at = len(base)

    def has(word: str, e: str, low: int) -> bool:
        return word.endswith(e) and len(word) - len(e) >= low

    if kind in ("plain", "ation", "logie", "ution", "ence", "if", "ité") and at < r2:
        return w, False
    if kind == "plain":
        return base, True
    if kind == "ation":
        return (base[:-2] if has(base, "ic", r2) else base[:-2] + "iqU" if base.endswith("ic") else base), True
    if kind == "logie":
        return base + "log", True
    if kind == "ution":
        return base + "u", True
    if kind == "ence":
        return base + "ent", True
    if kind == "ement":
        if at < rv:
            return w, False
        if base.endswith("iv"):
            if has(base, "iv", r2):
                base = base[:-2]
                base = base[:-2] if has(base, "at", r2) else base
        elif base.endswith("eus"):
            base = base[:-3] if has(base, "eus", r2) else base[:-3] + "eux" if has(base, "eus", r1) else base
        elif base.endswith(("abl", "iqU")):
            base = base[:-3] if len(base) - 3 >= r2 else base
        elif base.endswith(("ièr", "Ièr")):
            base = base[:-3] + "i" if len(base) - 3 >= rv else base
        return base, True
    if kind == "ité":
        if base.endswith("abil"):
            base = base[:-4] if has(base, "abil", r2) else base[:-4] + "abl"
        elif base.endswith("ic"):
            base = base[:-2] if has(base, "ic", r2) else base[:-2] + "iqU"
        elif has(base, "iv", r2):
            base = base[:-2]
        return base, True
    if kind == "if":
        if has(base, "at", r2):
            base = base[:-2]
            if base.endswith("ic"):
                base = base[:-2] if has(base, "ic", r2) else base[:-2] + "iqU"
        return base, True
    if kind == "eaux":
        return base + "eau", True
    if kind == "aux":
        return (base + "al", True) if at >= r1 else (w, False)
    if kind == "euse":
        return (base, True) if at >= r2 else (base + "eux", True) if at >= r1 else (w, False)
    if kind == "issement":
        return (base, True) if at >= r1 and base and base[-1] not in _VOWELS else (w, False)
    if kind in ("amment", "emment"):
        return (base + ("ant" if kind == "amment" else "ent") if at >= rv else w), False
    return (base if at - 1 >= rv and base[-1] in _VOWELS else w), False


def _verb(w: str, rv: int, r2: int) -> str:
    if end := ending(w, _VERBS_I, rv):
        base = w[: -len(end)]
        if len(base) - 1 >= rv and base[-1] not in _VOWELS + "H":
            return base
    if end := ending(w, _VERBS, rv):
        base = w[: -len(end)]
        if end == "ions":
            return base if len(base) >= r2 else w
        return base[:-1] if end in _VERBS_A and base.endswith("e") and len(base) - 1 >= rv else base
    return w


def _residual(w: str, rv: int, r2: int) -> str:
    if w.endswith("s") and len(w) > 1 and (w[-2] not in "aiouès" or w.endswith("His")):
        w = w[:-1]
    end = ending(w, _RESIDUAL, rv)
    base = w[: len(w) - len(end)]
    if end == "ion":
        return base if len(base) >= r2 and len(base) - 1 >= rv and base[-1] in "st" else w
    return base + "i" if end in ("ier", "ière", "Ier", "Ière") else base


def stem(word: str) -> str:
    w = _marked(word)
    rv, (r1, r2) = _verb_region(w), first_regions(w, _VOWELS)
    cut, whole = _standard(w, rv, r1, r2)
    if not whole:
        verb = _verb(cut, rv, r2)
        whole, cut = verb != cut, verb
    if whole:
        cut = cut[:-1] + "i" if cut.endswith("Y") else cut[:-1] + "c" if cut.endswith("ç") else cut
    else:
        cut = _residual(cut, rv, r2)
    if cut.endswith(("enn", "onn", "ett", "ell", "eill")):
        cut = cut[:-1]
    cut = re.sub(f"[éè](?=[^{_VOWELS}]+$)", "e", cut)
    return re.sub("H[ei]|[HIUY]", lambda m: _BACK[m[0]], cut)
