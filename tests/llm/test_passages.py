"""Repeated passages against brute force where kept suffixes alone mislead."""

import random

import pytest

from millrace.llm import suffix_dedup
from test_brute import _passages


def _words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(n)]


def _check(spark, texts):
    """Words that each text shares with an earlier text, and with a later one, are those of brute force."""
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id bigint, text string").repartition(3)
    got = {(d, later): set() for d in texts for later in (True, False)}
    for r in suffix_dedup.shared_passages(df).collect():
        got[r.doc_id, r.later] |= set(range(r["first"], r["last"]))
        assert " ".join(texts[r.doc_id])[r.start : r.start + r.length].split() == texts[r.doc_id][r["first"] : r["last"]]
    _, where, split = _passages({d: " ".join(w) for d, w in texts.items()}, 50)
    for (d, later), own in got.items():
        w = split[d]
        holders = [where[tuple(w[i : i + 50])] for i in range(len(w) - 49)]
        want = {i + k for i, h in enumerate(holders) if any(x < d if later else x > d for x in h) for k in range(50)}
        assert own == want, (d, later)


@pytest.mark.parametrize("size", [51, 60, 75])
def test_a_third_text_or_a_second_place_with_the_first_words_only(spark, size):
    rng = random.Random(size)
    texts = {}
    for n in range(8):
        passage = _words(rng, size)
        at = suffix_dedup.minimisers(suffix_dedup.word_hashes(" ".join(passage).encode()), 24, 50)[0]
        lines = sum((passage[p : p + 24] + _words(rng, 30) for p in at), [])
        whole = lambda: _words(rng, 30) + passage + _words(rng, 30)  # noqa: E731, B023
        texts |= {10 * n: whole(), 10 * n + 1: _words(rng, 30) + lines, 10 * n + 2: whole()}
        other = _words(rng, size)
        at = suffix_dedup.minimisers(suffix_dedup.word_hashes(" ".join(other).encode()), 24, 50)[0]
        again = sum((other[p : p + 24] + _words(rng, 30) for p in at), [])
        texts |= {10 * n + 5: _words(rng, 30) + other + _words(rng, 30) + again, 10 * n + 6: _words(rng, 30) + other + _words(rng, 30)}
    _check(spark, texts)


def test_passages_that_overlap_on_different_shifts(spark):
    rng = random.Random(2)
    texts = {}
    for n in range(6):
        x, z = _words(rng, 70), _words(rng, 24 + n)
        texts |= {2 * n: x + _words(rng, 40) + x[-45:] + z + _words(rng, 20), 2 * n + 1: _words(rng, 20) + x + z + _words(rng, 20)}
    _check(spark, texts)


def test_a_key_that_texts_have_many_times(spark, monkeypatch):
    """Rows of one key fill more than a partition and are dealt out."""
    monkeypatch.setattr(suffix_dedup, "BUCKET", 7, raising=False)
    rng = random.Random(3)
    line, texts = _words(rng, 24), {}
    around = [(_words(rng, 20), _words(rng, 20)) for _ in range(12)]
    for d in range(14):
        texts[d] = sum((_words(rng, 10) + a + line + b for a, b in rng.sample(around, 6)), [])
    _check(spark, texts)


def test_a_key_that_crosses_partitions(spark):
    """All places of a passage with one kept suffix: wherever a border may fall, each has its match."""
    rng = random.Random(4)
    least = lambda w: int(suffix_dedup.minimisers(suffix_dedup.word_hashes(" ".join(w).encode()), 24, 50)[1].min())
    passage = min((_words(rng, 50) for _ in range(3000)), key=least)
    _check(spark, {d: sum((_words(rng, 9) + passage for _ in range(6)), _words(rng, 5)) for d in range(12)})


def test_rows_that_repeat_an_id_and_columns_that_clash(spark):
    """No word goes but those of a passage that a text with a smaller id holds, whatever the row's id and the columns' names."""
    rng = random.Random(6)
    p, q = _words(rng, 60), _words(rng, 55)
    rows = [(1, p), (2, p), (2, _words(rng, 70)), (2, _words(rng, 10) + q), (3, q + _words(rng, 5)), (3, q + _words(rng, 5)), (3, p[:55] + _words(rng, 4)), (4, _words(rng, 80)), (1, _words(rng, 7) + p + _words(rng, 3))]
    names = "doc_id bigint, text string, __cut int, __id int, __text string, own int, of string, cut int, `left` string, n_chars int, at int"
    df = spark.createDataFrame([(d, " ".join(w), 1, 2, "x", 3, "y", 4, "z", 7, n) for n, (d, w) in enumerate(rows)], names).repartition(4)
    out = {r.at: r for r in suffix_dedup.cut_later(df).collect()}
    earlier = {n: {i + k for m, (e, v) in enumerate(rows) if e < d for i in range(len(w) - 49) for j in range(len(v) - 49) if w[i : i + 50] == v[j : j + 50] for k in range(50)} for n, (d, w) in enumerate(rows)}
    want = {n: [x for i, x in enumerate(w) if i not in earlier[n]] for n, (_, w) in enumerate(rows)}
    assert {n: r.text.split() for n, r in out.items()} == {n: w for n, w in want.items() if w}
    for n, r in out.items():
        assert (r.doc_id, r["__cut"], r["__id"], r["__text"], r.own, r.of, r.cut, r["left"]) == (rows[n][0], 1, 2, "x", 3, "y", 4, "z")
        assert r.n_chars == (len(r.text) if earlier[n] else 7)
    spans = {(r.doc_id, r.digest) for r in suffix_dedup.shared_passages(df).collect()}
    assert len(spans) == 7  # two texts each of ids 1 and 2, three of id 3


def test_a_stretch_in_most_texts(spark, monkeypatch):
    """One passage that fills many buckets, beside others, in ranges of ids that meet by their borders."""
    monkeypatch.setattr(suffix_dedup, "BUCKET", 5)
    rng = random.Random(12)
    hot, warm = _words(rng, 64), _words(rng, 52)
    texts = {7 * d: _words(rng, rng.randrange(9)) + (hot if d % 5 else hot[:51]) + _words(rng, 3) + (warm if d % 9 == 0 else []) + (hot if d % 11 == 0 else []) for d in range(60)}
    _check(spark, texts)
    others = {}
    for r in suffix_dedup.shared_passages(spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id bigint, text string")).collect():
        others[r.doc_id, r.later] = min(r.other_id, others.get((r.doc_id, r.later), r.other_id))
    ids = sorted(texts)
    assert {d: others.get((d, True)) for d in ids} == dict.fromkeys(ids, 0) | {0: None}
    assert {d: others.get((d, False)) for d in ids} == dict(zip(ids, [*ids[1:], None], strict=True))
