"""Italian stems, after the published Snowball description."""

from __future__ import annotations

import re

from millrace.functions.stems.regions import by_length, ending, first_regions

# Fixed values of the description.
_VOWELS = "aeiouàèìòù"
_PRONOUNS = by_length(
    "ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene"
)
_STANDARD = {
    "plain": "anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti",
    "azione": "azione azioni atore atori",
    "logia": "logia logie",
    "uzione": "uzione uzioni usione usioni",
    "enza": "enza enze",
    "amento": "amento amenti imento imenti",
    "amente": "amente",
    "ità": "ità",
    "ivo": "ivo ivi iva ive",
}
_VERBS = by_length(
    "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò erono essero "
    "ete eva evamo evano evate evi evo Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano ivate ivi ivo "
    "ono uta ute uti uto ar ir"
)

_KIND = {e: kind for kind, words in _STANDARD.items() for e in words.split()}
_ENDS = by_length(" ".join(_KIND))
_GRAVE = str.maketrans("áéíóú", "àèìòù")


def _verb_region(w: str) -> int:
    if len(w) < 2:
        return len(w)
    if w[1] not in _VOWELS:
        found = re.compile(f"[{_VOWELS}]").search(w, 2)
    elif w[0] in _VOWELS:
        found = re.compile(f"[^{_VOWELS}]").search(w, 2)
    else:
        return min(3, len(w))
    return found.end() if found else len(w)


def _drop(w: str, low: int, *ends: str) -> str:
    """w without the first of the endings that it has, if that lies behind low."""
    end = ending(w, ends)
    return w[: -len(end)] if end and len(w) - len(end) >= low else w


def _standard(w: str, rv: int, r1: int, r2: int) -> str:
    end = ending(w, _ENDS)
    at = len(w) - len(end)
    kind = _KIND.get(end)
    if not end or at < (rv if kind == "amento" else r1 if kind == "amente" else r2):
        return w
    base = w[:at]
    if kind == "logia":
        return base + "log"
    if kind == "uzione":
        return base + "u"
    if kind == "enza":
        return base + "ente"
    if kind == "azione":
        return _drop(base, r2, "ic")
    if kind == "ità":
        return _drop(base, r2, "abil", "ic", "iv")
    if kind == "amente":
        shorter = _drop(base, r2, "abil", "iv", "os", "ic")
        return _drop(shorter, r2, "at") if base.endswith("iv") and shorter != base else shorter
    if kind == "ivo":
        shorter = _drop(base, r2, "at")
        return _drop(shorter, r2, "ic") if shorter != base else base
    return base


def stem(word: str) -> str:
    w = word.translate(_GRAVE).replace("qu", "qU")
    w = re.sub(f"(?<=[{_VOWELS}])[ui](?=[{_VOWELS}])", lambda m: m[0].upper(), w)
    rv, (r1, r2) = _verb_region(w), first_regions(w, _VOWELS)
    if end := ending(w, _PRONOUNS):
        base = w[: -len(end)]
        if ending(base, ("ando", "endo"), rv):
            w = base
        elif ending(base, ("ar", "er", "ir"), rv):
            w = base + "e"
    cut = _standard(w, rv, r1, r2)
    if cut == w:
        end = ending(w, _VERBS, rv)
        cut = w[: len(w) - len(end)]
    w = cut
    if w[-1:] in tuple("aeioàèìò") and len(w) - 1 >= rv:
        w = w[:-1]
        w = _drop(w, rv, "i")
    if w.endswith(("ch", "gh")) and len(w) - 1 >= rv:
        w = w[:-1]
    return w.replace("I", "i").replace("U", "u")
