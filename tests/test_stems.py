"""Stems of four languages, and BM25 over them against a plain version."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.functions import stems, text
from millrace.functions import values as V
from millrace.operators import bm25

KNOWN = {
    "de": "aufeinander aufeinand, kategorien kategori, wohnungen wohnung, häuser haus, schönes schon, freundlichkeit freundlich, zimmer zimm, strasse strass, ruhige ruhig, balkons balkon, kindern kind, bedürfnissen bedurfnis, lage lag",
    "en": "consigned consign, consignment consign, consistency consist, consolation consol, consolidate consolid, conspicuous conspicu, knightly knight, knitting knit, knotted knot, general general, generate generat, happy happi, hopping hop, hoping hope, ties tie, cries cri, agreed agre, apartments apart, families famili, news news, relational relat, by by",
    "fr": "continuait continu, continuellement continuel, contradictoirement contradictoir, contraindre contraindr, contrainte contraint, majestueusement majestu, majestueux majestu, maintenir mainten, maintien maintien, maîtresse maîtress, appartements appart, chambres chambr, haïr haïr, quatre quatr",
    "it": "abbandonata abbandon, abbandonerà abbandon, abbaruffato abbaruff, abbassamento abbass, abbassando abbass, abbassarono abbass, prontamente pront, pronuncia pronunc, pronunciamento pronunc, propagare propag, propizio propiz, proponevano propon, appartamenti appart, luoghi luog",
}


@pytest.mark.parametrize("language", sorted(KNOWN))
def test_known(language):
    pairs = dict(p.split() for p in KNOWN[language].split(", "))
    assert {w: stems.STEMMERS[language](w) for w in pairs} == pairs


def test_odd_words():
    for w in ("", "a", "y", "s", "ss", "qu", "ion", "ment", "ïs", "1", "x2", "iqu", "ll", "ing", "日本", "é" * 300):
        assert all(isinstance(f(w), str) for f in stems.STEMMERS.values())


def test_arrays(spark):
    df = spark.createDataFrame([(1, ["hopping", "maisons"], "en"), (2, ["maisons"], "fr"), (3, ["häuser"], None), (4, ["häuser"], "xx"), (5, [], "it"), (6, None, "it")], "i int, w array<string>, l string")
    got = {r.i: r.s for r in df.select("i", stems.by_language(F.col("w"), F.col("l")).alias("s")).collect()}
    assert got == {1: ["hop", "maison"], 2: ["maison"], 3: ["haus"], 4: ["haus"], 5: [], 6: None}


TEXTS = [
    (1, "Die Wohnung ist ruhig und hat einen Balkon. Ruhige Wohnungen mit Balkonen"), (2, "The apartments are bright with large windows and a view of the lake"), (3, "Bright apartment, two bedrooms, near the lake"),
    (4, "Les appartements lumineux avec une chambre et un balcon"), (5, "Appartamenti luminosi con una camera vicino al lago"), (6, ""), (7, None),
]
QUERIES = [(1, "ruhige Wohnung Balkons", "de"), (2, "brightest apartments near lakes lakes", "en"), (3, "appartement lumineuse", "fr"), (4, "balkon", "unknown"), (5, None, "it")]


def plain_scores(docs, queries):
    """BM25 by hand from tokens that Spark split, stemmed one by one."""
    docs = {i: [stems.STEMMERS[lang](w) for w in ws] for i, ws, lang in docs}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for ws in docs.values() for t in set(ws))
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    floor = V.BM25_EPSILON * sum(raw.values()) / len(raw)
    k, b, out = V.BM25_K1, V.BM25_B, {}
    for q, ws, lang in queries:
        for i, own in docs.items():
            tf = Counter(own)
            parts = [(floor if raw[t] < 0 else raw[t]) * tf[t] * (k + 1) / (tf[t] + k * (1 - b + b * len(own) / mean)) for t in (stems.STEMMERS.get(lang, stems.STEMMERS["de"])(w) for w in ws) if tf[t]]
            if parts:
                out[q, i] = round(sum(parts), 9)
    return out


def test_bm25(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id int, text string")
    asked = spark.createDataFrame(QUERIES, "query_id int, raw_query string, language string")
    split = [(r.doc_id, r.w, r.l) for r in docs.select("doc_id", text.tokens(F.col("text")).alias("w"), text.detect_language(F.col("text")).alias("l")).collect()]
    said = [(r.query_id, r.w, r.language) for r in asked.select("query_id", text.tokens(F.col("raw_query")).alias("w"), "language").collect()]
    got = bm25.score(bm25.build_index(docs, id="doc_id", text="text", stem=stems.by_language), asked).collect()
    want = plain_scores(split, said)
    assert {(r.query_id, r.doc_id): round(r.bm25, 9) for r in got} == want
    assert {(1, 1), (2, 2), (2, 3), (4, 1)} <= set(want)
