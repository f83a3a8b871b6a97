"""Every operator on nulls, empties, very long texts, repeated rows, empty tables and clashing columns."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm import epsilon_join, langid, packing, quality_gam, quality_rules, similar, simhash, suffix_dedup, token_counts, url_filter, word_bpe
from millrace.llm.base import held_out

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept string, ids int, `key` int, part string, h string, a int, component_id string, fp string, `start` string"
LABELS = "doc_id bigint, quality int, toxic int, y int"


def _rows(long: int = 40_000):
    prose = " ".join(f"wort{i} und der die das" for i in range(60))
    texts = [None, "", " \n\t ", "a", "…", "zwei worte", prose, prose, prose + " x", "lang " * long, "<|endoftext|> # $ |", "é ü ß 日本 \U0001f917", "the and of it " * 30]
    return [(i, t, [None, "de", "en"][i % 3], None, None, 0.5, "x", 1, 1, "p", "h", 1, "c", "f", "s") for i, t in enumerate(texts)] + [(6, prose, "de", "s", 1, 0.5, "x", 1, 1, "p", "h", 1, "c", "f", "s"), (None, "ohne nummer hier", None, None, None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module", params=["rows", "empty", "all_null"])
def docs(request, spark):
    rows = {"rows": _rows(), "empty": [], "all_null": [(None,) * 15, (1, *(None,) * 14)]}[request.param]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 0, 0, 1), (6, 1, 0, 1), (6, 0, 0, 1), (9, 0, None, 1), (12, 1, 0, 1), (None, 1, 0, 1), (8, None, 0, 1), (999, 1, 1, 1)], LABELS)


def test_language(docs):
    model = langid.build_model(langid.labelled_sample(docs, ~held_out()))
    out = langid.identify(docs, model, keep=["doc_id"]).toPandas()
    assert len(out) == docs.count()
    for text, r in zip([x.text for x in docs.select("text").collect()], out.itertuples(), strict=True):
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not model.languages or not any(c.isalpha() for c in text or ""))


def test_quality(docs, labels):
    model = quality_gam.fit(*quality_gam.labelled_features(docs, labels, ~held_out()))
    out = quality_gam.score_texts(docs, model, keep=["doc_id"]).toPandas()
    assert len(out) == docs.count() and out.score.between(0, 1).all() and ((out.score >= 0.5) == (out.predicted == 1)).all()
    assert quality_gam.keep_good(docs, model).columns == docs.columns


def test_rules(docs, labels):
    rules = quality_rules.fit_rules(docs, labels, ~held_out())
    out = quality_rules.judge(docs, rules, keep=["doc_id"]).toPandas()
    assert len(out) == docs.count()
    assert not out[out.base_failed].kept.any() and out[out.n_words < 50].base_failed.all()
    kept = quality_rules.keep_passing(docs, rules)
    assert kept.columns == docs.columns and kept.count() == out.kept.sum()


def test_packing(docs):
    out = packing.pack(docs, BYTES, size=64, windows=3, group=2).toPandas()
    assert out.length.sum() == out.groupby(["doc_id", "doc_tokens"], dropna=False).size().shape[0] * 0 + sum(r.n + 1 for r in token_counts.count_tokens(docs, BYTES, keep=["doc_id"]).selectExpr("n_tokens as n").collect())
    for _, seq in out.sort_values("offset").groupby("sequence_id"):
        assert (seq.offset.to_numpy() == (seq.length.cumsum() - seq.length).to_numpy()).all()
        assert seq.length.sum() == 64 or bin(seq.length.sum()).count("1") == 1


def test_simhash(docs):
    out = simhash.near_duplicates(docs).toPandas()
    assert len(out) == docs.count()
    known = out[out.doc_id.notna()]
    assert (known.component_id <= known.doc_id).all()
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns


def test_similar(docs):
    kept = similar.keep_first(docs.withColumn("__gone", docs["h"]))
    assert kept.columns == [*docs.columns, "__gone"]
    groups = {r.doc_id: r.component_id for r in similar.similar_groups(docs).collect()}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in docs.collect() if r.doc_id is None or groups[r.doc_id] == r.doc_id)


def test_suffixes(docs):
    spans = suffix_dedup.shared_passages(docs).toPandas()
    assert (spans["last"] - spans["first"] >= 50).all() if len(spans) else True
    cut = suffix_dedup.cut_later(docs)
    assert cut.columns == docs.columns and cut.dtypes == docs.dtypes
    assert cut.count() <= docs.count()


@pytest.mark.parametrize("most_words", [0, 5, 200_000])
def test_token_counts(docs, most_words):
    tok = Tokenizer.from_file(BYTES)
    rows = docs.select("doc_id", "text").collect()
    got = Counter(tuple(r) for r in token_counts.count_tokens(docs, BYTES, keep=["doc_id", "text"], most_words=most_words).collect())
    assert got == Counter((r.doc_id, r.text, len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in rows)


def test_words(docs):
    words = Tokenizer.from_file(WORDS)
    texts = [r.text or "" for r in docs.select("text").collect()]
    got = word_bpe.encode_documents(docs, WORDS, keep=["doc_id"]).collect()
    ids = [words.encode(t, add_special_tokens=False).ids for t in texts]
    assert [list(r.ids) for r in got] == ids
    for r, own in zip(word_bpe.digest_documents(docs, WORDS, keep=["doc_id"]).collect(), ids, strict=True):
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(own), hashlib.sha256(np.array(own, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(words.decode(own, skip_special_tokens=False).encode()).hexdigest())


@pytest.mark.parametrize("most_words", [0, 5])
def test_words_beyond_the_table(docs, most_words):
    words = Tokenizer.from_file(WORDS)
    rows = docs.select("doc_id", "text").collect()
    want = Counter((r.doc_id, r.text, tuple(words.encode(r.text or "", add_special_tokens=False).ids)) for r in rows)
    assert Counter((r.doc_id, r.text, tuple(r.ids)) for r in word_bpe.encode_documents(docs, WORDS, keep=["doc_id", "text"], most_words=most_words).collect()) == want
    decoded = Counter((r.doc_id, r.text, r.n_tokens, r.decoded_sha256) for r in word_bpe.digest_documents(docs, WORDS, keep=["doc_id", "text"], most_words=most_words).collect())
    assert decoded == Counter((d, t, len(ids), hashlib.sha256(words.decode(list(ids), skip_special_tokens=False).encode()).hexdigest()) for d, t, ids in want.elements())


VECTORS = "vec_id bigint, embedding array<float>, label int, rep int, copies int, k string, block int"


@pytest.mark.parametrize("rows", [[], [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, float("nan")]), (5, [1.0, None]), (6, [1.0, 0.0]), (6, [1.0, 0.0]), (7, [2.0, 0.0]), (8, [0.91, 0.4]), (9, [0.0, 1.0]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (11, [1e30, 0.0])], [(1, None), (None, None)]])
def test_vectors(spark, rows):
    own = spark.createDataFrame([(*r, 1, 1, 1, "k", 1) for r in rows], VECTORS)
    out = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in epsilon_join.near_vectors(own).collect()}
    assert epsilon_join.near_vectors(own).count() == len(rows)
    if len(rows) > 5:
        assert {(1, 0, 1, True), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (9, 0, 9, True), (10, 0, 10, True), (None, 0, None, True)} <= out
        assert {(v, c) for v, _, c, _ in out if v in (6, 7, 11)} == {(6, 6), (7, 6), (11, 6)} and (8, 4, 6, False) in out
        assert {n for v, n, _, _ in out if v == 7} == {4}


@pytest.mark.parametrize("rows", [[], [(1, None, None), (2, "", "x"), (3, "no scheme", None), (4, "http://A.Net", None), (5, "https://x.org/fr/1?q", "<a href='http://B.com/x'>"), (None, "ftp://example.net/en/#a", None), (5, "https://x.org/fr/1?q", None), (6, "a://b://c/d", None)]])
def test_pages(spark, rows):
    own = spark.createDataFrame([(*r, "h", "r", "v") for r in rows], "page_id bigint, url string, html string, host string, rule string, verdict string")
    out = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_pages(own).collect()}
    if rows:
        assert out == {(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "a.net", "", None, "allow"), (5, "x.org", "/fr/1", "org/fr/", "allow"), (None, "example.net", "/en/", "example.net/en/", "allow"), (6, "b:", "//c/d", None, "allow")}
