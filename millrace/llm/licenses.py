"""Licence scans: an Aho-Corasick automaton over words finds notice phrases and identifier tags; tagged expressions and linked notices are parsed and evaluated.

A text's words are joined by single blanks, so that a phrase is one pattern
whatever stands between its words. After a tag (`SPDX-License-Identifier:`,
`license = ...`) an expression of identifiers, `and`, `or`, `with` and
parentheses is read as far as its grammar goes; notices that only such words
link are read as an expression too. A shunting-yard parser turns both into
postfix, and evaluation says which licences a user ends up with: the least
demanding side of `or`, the most demanding of `and`, less where an exception is granted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.base import flat_utf8, map_texts

#: Phrases of the contract.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Phrases of this operator's own.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "apache software license": "apache",
    "bsd license": "bsd",
    "isc license": "isc",
    "zlib license": "zlib",
    "expat license": "mit",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "common development and distribution license": "cddl",
    "boost software license": "bsl",
    "artistic license": "artistic",
    "european union public licence": "eupl",
    "open font license": "ofl",
    "open database license": "odbl",
    "creative commons zero": "cc0",
    "public domain dedication": "cc0",
    "the unlicense": "unlicense",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
}
#: Words that announce an expression; a bare one must be followed by a known identifier.
TAGS = {"spdx license identifier": True, "license": False, "licence": False, "licenses": False}
#: What a licence asks of its user.
OBLIGATIONS = ("none", "notice", "weak copyleft", "copyleft", "network copyleft", "restricted", "unknown")
FAMILIES = {
    **dict.fromkeys(("cc0", "unlicense", "wtfpl", "0bsd", "mit-0"), 0),
    **dict.fromkeys(("mit", "apache", "bsd", "isc", "zlib", "bsl", "x11", "psf", "artistic", "cc-by", "ofl", "ncsa", "postgresql"), 1),
    **dict.fromkeys(("lgpl", "mpl", "epl", "cddl", "eupl", "ms-pl"), 2),
    **dict.fromkeys(("gpl", "gfdl", "cc-by-sa", "odbl"), 3),
    **dict.fromkeys(("agpl", "osl", "sspl"), 4),
    **dict.fromkeys(("cc-by-nc", "cc-by-nd", "cc-by-nc-sa", "cc-by-nc-nd", "busl"), 5),
}
#: How sure a find is: a tag with a whole expression, a broken one, a notice after `licensed under` and the like, a bare notice.
SURE = {"tag": 0.95, "broken tag": 0.5, "granted": 0.9, "notice": 0.6}

_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_GRANT = {b"licensed", b"released", b"distributed", b"published", b"available", b"provided", b"licenced"}
#: Words that may stand between linked notices.
_BETWEEN = {b"version", b"v", b"the", b"either", b"a", b"an", b"license", b"licence", b"terms", b"of", b"under", b"both"}
_LATER = re.compile(rb"\bor (?:any )?(?:later|newer)(?: version)?\b|\bor at your option any later version\b")
_ANNOUNCED = re.compile(rb"""["']?[ \t]*[:=][ \t]*["'\[]?""")
_TOKEN = re.compile(rb"""[ \t]*(?:([()])|(\|\||&&|/)|([a-z0-9][a-z0-9.+:_-]*))""")
_SIGNS = {b"||": "or", b"/": "or", b"&&": "and"}
_VERSION = re.compile(r"[-v]*\d[\d.]*(-clause.*|-[a-z]{2,3})?$")

_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_LONGEST = 12  # words between linked notices


def family(identifier: str) -> str:
    """`gpl` of `GPL-2.0-or-later`, `bsd` of `BSD-3-Clause`: the identifier without version and suffix."""
    own = identifier.lower().rstrip(".:+")
    if own in FAMILIES:
        return own
    for suffix in ("-only", "-or-later"):
        own = own.removesuffix(suffix)
    bare = _VERSION.sub("", own)
    return bare if bare in FAMILIES else own


def to_postfix(tokens: Iterator[tuple[str, str]]) -> tuple[list[tuple[str, str]], bool]:
    """(postfix, whole) by a shunting yard: tokens (kind, value), kind being name, op, ( or ).

    Reads as far as the grammar goes on: a second name in a row, or a parenthesis that
    closes nothing, ends it. Not whole: an operator lacks its right side, or a parenthesis its end.
    """
    out: list[tuple[str, str]] = []
    held: list[str] = []
    wanted, whole = True, True  # whether a name must come
    for kind, value in tokens:
        if wanted and kind == "(":
            held.append("(")
        elif wanted and kind == "name":
            out.append((kind, value))
            wanted = False
        elif not wanted and kind == "op":
            while held and held[-1] != "(" and _PRECEDENCE[held[-1]] >= _PRECEDENCE[value]:
                out.append(("op", held.pop()))
            held.append(value)
            wanted = True
        elif not wanted and kind == ")" and "(" in held:
            while (op := held.pop()) != "(":
                out.append(("op", op))
        else:
            break
    if wanted:  # what stands last has no right side, nor have the parentheses opened after it
        whole = False
        while held and held.pop() == "(":
            pass
    while held:
        if (op := held.pop()) == "(":
            whole = False
        else:
            out.append(("op", op))
    return out, whole


def evaluate(postfix: list[tuple[str, str]]) -> tuple[str, list[str], list[str], int] | None:
    """(text, licences named, licences a user ends up with, index into OBLIGATIONS); None without a name.

    Of equally demanding sides of `or` the first. A name that is no known family is unknown, the most demanding.
    """
    stack: list[tuple] = []  # text, precedence, named, chosen, rank
    for kind, value in postfix:
        if kind == "name":
            own = family(value)
            stack.append((value.lower().rstrip(".:"), 4, [own], [own], FAMILIES.get(own, len(OBLIGATIONS) - 1)))
            continue
        right, left = stack.pop(), stack.pop()
        level = _PRECEDENCE[value]
        said = f" {value} ".join(x[0] if x[1] >= level else f"({x[0]})" for x in (left, right))
        if value == "with":  # an exception is no licence; granted, it eases copyleft
            stack.append((said, level, left[2], left[3], 2 if left[4] in (3, 4) else left[4]))
        elif value == "and":
            stack.append((said, level, left[2] + right[2], left[3] + right[3], max(left[4], right[4])))
        else:
            stack.append((said, level, left[2] + right[2], *(left[3:] if left[4] <= right[4] else right[3:])))
    if not stack:
        return None
    text, _, named, chosen, rank = stack[-1]
    return text, list(dict.fromkeys(named)), list(dict.fromkeys(chosen)), rank


def _tokens(line: bytes, at: int) -> Iterator[tuple[str, str]]:
    """Tokens of the expression at a place of lower-cased text, up to the end of its line."""
    while found := _TOKEN.match(line, at):
        at = found.end()
        bracket, sign, word = found.groups()
        if bracket:
            yield bracket.decode(), ""
        elif sign:
            yield "op", _SIGNS[sign]
        elif (own := word.decode()) in _PRECEDENCE:
            yield "op", own
        else:
            yield "name", own


def _link(words: list[bytes]) -> str | None:
    """The operator that words between two notices say, if they say no more than that."""
    said = _LATER.sub(b" ", b" ".join(words)).split()
    ops = [w.decode() for w in said if w.decode("utf-8", "replace") in ("and", "or")]
    rest = [w for w in said if w not in _BETWEEN and w not in (b"and", b"or") and not w.isdigit()]
    return ops[0] if len(ops) == 1 and not rest else None


def _automaton() -> ahocorasick.Automaton:
    own = ahocorasick.Automaton()
    patterns = {p: ("notice", x, p in BASE) for p, x in {**NOTICES, **BASE}.items()} | {p: ("tag", x, False) for p, x in TAGS.items()}
    for p, found in patterns.items():
        own.add_word(f" {p} ", (p.count(" ") + 1, len(p) + 2, *found))
    own.make_automaton()
    return own


def scan_text(automaton, raw: bytes) -> tuple[int, list[dict], list[dict], float]:
    """(words, spans, expressions, score) of one text in UTF-8."""
    plain = raw.translate(_WORDS)
    words = plain.split()
    hay = f" {b' '.join(words).decode()} "
    spans, tags = [], []
    at = word = 0  # blanks before at
    for end, (n, length, kind, what, base) in automaton.iter(hay):
        start = end - length + 1
        # Hits come by their ends; a start may lie before the last one.
        word += hay.count(" ", at, start) if start >= at else -hay.count(" ", start, at)
        at = start
        if kind == "tag":
            tags.append((word, n, what))
        else:
            spans.append({"label": what, "kind": "notice", "word": word, "words": n, "base": base})
    expressions, doubt = [], 1.0
    spans.sort(key=lambda s: (s["word"], -s["words"]))
    if tags:
        ends = [m.end() for m in re.finditer(rb"[^ ]+", plain)]
        low = raw.lower()
        for word, n, sure in tags:
            if not (colon := _ANNOUNCED.match(low, ends[word + n - 1])):
                continue
            postfix, whole = to_postfix(_tokens(low, colon.end()))
            if not (found := evaluate(postfix)) or not (sure or found[2][0] in FAMILIES and found[1][0] in FAMILIES):
                continue
            text, named, chosen, rank = found
            known = [x for x in named if x in FAMILIES]
            expressions.append({"word": word, "expression": text, "whole": whole, "chosen": chosen, "obligation": OBLIGATIONS[rank]})
            spans += [{"label": x, "kind": "tag", "word": word, "words": n, "base": False} for x in known]
            doubt *= 1 - SURE["tag" if whole else "broken tag"] if known else 1
    # A longer notice stands for the shorter ones inside it.
    notices, reach = [], -1
    for s in spans:
        if s["kind"] == "notice" and s["word"] + s["words"] > reach:
            notices.append(s)
            reach = s["word"] + s["words"]
            doubt *= 1 - SURE["granted" if _GRANT.intersection(words[max(0, s["word"] - 4) : s["word"]]) else "notice"]
    chain: list[tuple[str, str]] = []
    for i, s in enumerate(notices):
        chain.append(("name", s["label"]))
        begin, end = s["word"] + s["words"], notices[i + 1]["word"] if i + 1 < len(notices) else None
        op = _link(words[begin:end]) if end is not None and 0 < end - begin <= _LONGEST else None
        if op:
            chain.append(("op", op))
            continue
        if len(chain) > 1:
            text, _, chosen, rank = evaluate(to_postfix(iter(chain))[0])
            expressions.append({"word": notices[i - len(chain) // 2]["word"], "expression": text, "whole": True, "chosen": chosen, "obligation": OBLIGATIONS[rank]})
        chain = []
    expressions.sort(key=lambda x: x["word"])
    spans.sort(key=lambda s: (s["word"], s["words"], s["label"]))
    return len(words), spans, expressions, float(min(1.0, max(0.0, 1 - doubt)))


_SPAN = pa.struct([("label", pa.string()), ("kind", pa.string()), ("word", pa.int64()), ("words", pa.int32()), ("base", pa.bool_())])
_EXPRESSION = pa.struct([("word", pa.int64()), ("expression", pa.string()), ("whole", pa.bool_()), ("chosen", pa.list_(pa.string())), ("obligation", pa.string())])


def scan(docs: DataFrame, *, keep: list[str], text: str = "text") -> DataFrame:
    """keep, n_words, spans, expressions and score of every whole text.

    spans: every place of a phrase or of a licence under a tag, by its first word (from 0); base ones
    are the contract's, overlapping ones all stand. expressions: what tags and linked notices say together,
    the licences that a user ends up with, and what those ask. score: 0 without a find, else one minus the product of
    the doubts of all finds. Null and empty texts have no words and no finds; repeated rows each count.
    Each text is read once, whatever its length.
    """

    def make():
        automaton = _automaton()

        def run(texts: pa.Array) -> dict:
            data, offsets = flat_utf8(texts)
            whole = data.tobytes()
            found = [scan_text(automaton, whole[offsets[i] : offsets[i + 1]]) for i in range(len(texts))]
            n, spans, expressions, score = zip(*found, strict=True) if found else ((), (), (), ())
            return {"n_words": pa.array(np.array(n, dtype=np.int64)), "spans": pa.array(spans, pa.list_(_SPAN)), "expressions": pa.array(expressions, pa.list_(_EXPRESSION)), "score": pa.array(np.array(score, dtype=np.float64))}

        return run

    schema = "n_words bigint, spans array<struct<label: string, kind: string, word: bigint, words: int, base: boolean>>, expressions array<struct<word: bigint, expression: string, whole: boolean, chosen: array<string>, obligation: string>>, score double"
    return map_texts(docs, keep, text, make, schema)
