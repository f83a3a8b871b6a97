"""Licence scans: base finds against a plain version, expressions against their tables of truth."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import licenses, queries

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def plain(text):
    """n_words, n_base, first_word, last_word, base_labels, by looking at each word."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    places = [(i, x) for i in range(len(words)) for p, x in PHRASES.items() if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))


def _scan(spark, tmp_path, texts):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, spans string, score int").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_license_scan(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return {r.doc_id: r for r in got.collect()}


def test_base_against_plain(spark, tmp_path):
    """Every join of words, letters beyond ASCII, and phrases that overlap, are cut short or repeat."""
    rng = random.Random(4)
    bits = ["gnu", "GNU", "general", "Public", "license", "apache", "cc", "CC", "by", "mit", "é", "É", "MITÉ", "nc", "0", "K", "ſ", "the", "version"]
    joins = [" ", "\n", "-", "_", "\x7f", "\x80", "", "/", "  ", " ", ": "]
    texts = ["".join(rng.choice(bits) + rng.choice(joins[:4] if rng.random() < 0.8 else joins) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += [None, "", " \n", "cc by cc by", "cc by-nc cc", "gnu gnu general public license", "MIT License", "mit licenses", "x" * 300_000, "apache license " * 30_000, "\U0001f600 cc by"]
    got = _scan(spark, tmp_path, texts)
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(text), text
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


@pytest.mark.parametrize(
    ("text", "expression", "chosen", "obligation", "labels"),
    [
        ("// SPDX-License-Identifier: MIT OR Apache-2.0", "mit or apache-2.0", "mit", "notice", "apache,mit"),
        ("SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0) AND BSD-3-Clause */", "gpl-2.0-only with classpath-exception-2.0 and bsd-3-clause", "gpl,bsd", "weak copyleft", "bsd,gpl"),
        ("SPDX-License-Identifier: GPL-3.0+ OR MIT AND AGPL-3.0-or-later", "gpl-3.0+ or mit and agpl-3.0-or-later", "gpl", "copyleft", "agpl,gpl,mit"),
        ("SPDX-License-Identifier: (GPL-3.0 OR MIT) AND AGPL-3.0\nOR MIT", "(gpl-3.0 or mit) and agpl-3.0", "mit,agpl", "network copyleft", "agpl,gpl,mit"),
        ("spdx-license-identifier = LicenseRef-Own OR CC-BY-NC-4.0.", "licenseref-own or cc-by-nc-4.0", "cc-by-nc", "restricted", "cc-by,cc-by-nc"),
        ('{"license": "ISC", "name": 1}', "isc", "isc", "notice", "isc"),
        ("License: MPL-2.0/LGPL-2.1 Copyright", "mpl-2.0 or lgpl-2.1", "mpl", "weak copyleft", "lgpl,mpl"),
        ("Licensed under the Apache License, Version 2.0 or the MIT License.", "apache or mit", "apache", "notice", "apache,mit"),
        ("the GNU Lesser General Public License version 2 or later and the BSD license", "lgpl and bsd", "lgpl,bsd", "weak copyleft", "bsd,lgpl"),
    ],
)
def test_expressions(text, expression, chosen, obligation, labels):
    _, spans, found, score = licenses.scan_text(licenses._automaton(), text.encode())
    assert [(x["expression"], ",".join(x["chosen"]), x["obligation"], x["whole"]) for x in found] == [(expression, chosen, obligation, True)]
    assert ",".join(sorted({s["label"] for s in spans})) == labels and score > 0.8


@pytest.mark.parametrize("text", ["license: yes", "the license of the apache", "License:", "licence = (", "SPDX-License-Identifier:", "mit und", "a license: the car"])
def test_no_find(text):
    assert licenses.scan_text(licenses._automaton(), text.encode())[1:] == ([], [], 0.0)


@pytest.mark.parametrize(("text", "expression"), [("mit or", "mit"), ("(mit", "mit"), ("mit and (apache or", "mit and apache"), ("mit or ((", "mit"), ("or mit", None), ("mit)", "mit"), ("mit gpl", "mit"), ("", None), ("()", None)])
def test_broken(text, expression):
    found = licenses.evaluate(licenses.to_postfix(licenses._tokens(text.encode(), 0))[0])
    assert (found and found[0]) == expression


def test_precedence_against_python():
    """Random expressions: rank by min and max over Python's own parser, in which `and` binds as tightly."""
    rng = random.Random(7)
    names = ["mit", "gpl", "agpl", "cc0", "mpl", "odd"]
    ranks = {n: licenses.FAMILIES.get(n, 6) for n in names}

    class Rank(int):
        def __and__(self, other):
            return Rank(max(self, other))

        def __or__(self, other):
            return Rank(min(self, other))

    def made(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(names)
        said = f" {rng.choice(('and', 'or'))} ".join(made(depth - 1) for _ in range(rng.randint(2, 3)))
        return f"({said})" if rng.random() < 0.5 else said

    for _ in range(300):
        said = made(4)
        text, named, chosen, rank = licenses.evaluate(licenses.to_postfix(licenses._tokens(said.encode(), 0))[0])
        want = eval(said.replace(" and ", " & ").replace(" or ", " | "), {n: Rank(r) for n, r in ranks.items()})
        assert rank == want and set(named) == set(re.findall(r"\w+", said)) - {"and", "or"} and set(chosen) <= set(named)
        again = licenses.evaluate(licenses.to_postfix(licenses._tokens(text.encode(), 0))[0])
        assert again == (text, named, chosen, rank)


def test_long_line_of_tags():
    """A line of a hundred thousand tags is read in one pass."""
    text = "license: mit " * 100_000
    n, spans, found, _ = licenses.scan_text(licenses._automaton(), text.encode())
    assert n == 200_000 and len(found) == 100_000
    assert sum(s["base"] for s in spans) == 99_999


def test_empty_table(spark, tmp_path):
    assert _scan(spark, tmp_path, []) == {}


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op11_license_scan(spark, sf).orderBy(F.rand(1)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(texts[r.doc_id])
    assert {x for r in got for x in r.labels.split(",")} >= {"apache", "cc-by", "cc-by-nc", "gpl", "mit"}


def test_patterns_are_words():
    for p in itertools.chain(licenses.BASE, licenses.NOTICES, licenses.TAGS):
        assert re.fullmatch("[a-z0-9]+( [a-z0-9]+)*", p)
