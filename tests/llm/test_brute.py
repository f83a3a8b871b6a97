"""Operators against plain versions, exact round trips and held-out labels."""

import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import epsilon_join, langid, packing, quality_gam, quality_rules, queries, simhash, similar, suffix_dedup
from millrace.llm.components import connected_components
from millrace.llm.text_stats import rule_counts
from plain_groups import groups

SF = "/root/testdata/sf0.001"
BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 540)] + [(600, i) for i in range(601, 700)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links + [(1, 1), (None, 2)], "a bigint, b bigint").repartition(7)).collect()}
    nodes = {x for p in links for x in p if p[0] != p[1]}
    want = groups({x for p in links for x in p}, links)
    assert got == {n: want[n] for n in nodes}


def _norm(t):
    return re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in t.lower()))


def _phrases(text, sample):
    n, at, found = _norm(text), 0, 0
    while at < len(n):
        m = 1
        while at + m <= len(n) and n[at : at + m] in sample:
            m += 1
        at, found = at + max(1, m - 1), found + 1
    return found


def test_language_phrases():
    samples = {"de": ["der wald und die heide"], "en": ["the wood and the heath"]}
    model = langid.build_model(samples)
    rng = random.Random(1)
    long = " ".join(rng.choice(["wald", "die heide", "wood", "the", "heath", "und", "zzz", "a", "1"]) for _ in range(2500))
    texts = ["Die Heide, die!", "the heath 1", "", "und the x", "wald" * 700, long, "der wald und die heide " * 300, "d" * 3000, long[::-1]]
    for block, window in ((1024, 1 << 20), (7, 1 << 20), (64, 256)):
        counts, letters = langid.phrases(model, pa.array(texts), block, window)
        for k, lang in enumerate(model.languages):
            assert counts[:, k].tolist() == [_phrases(t, _norm(samples[lang][0])) for t in texts]
        assert letters.tolist() == [sum(c.isalpha() for c in t) for t in texts]


def test_languages_of_long_texts_and_large_scripts(spark):
    """A language is learnt however long its texts are, and letters beyond the alphabet still tell languages apart."""
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(2, 6)))
    scripts = {"de": "abdefgiklmnor", "es": "aeiouñcjlqs", "zh": [chr(0x4E00 + i) for i in range(300)], "ko": [chr(0xAC00 + 7 * i) for i in range(300)]}
    vocabulary = {k: [word(v) for _ in range(80)] for k, v in scripts.items()}
    prose = lambda k, n: " ".join(rng.choice(vocabulary[k]) for _ in range(n))
    rows = [(i, prose(k, 5000 if k == "es" else 60), k) for i, k in enumerate(list(scripts) * 30)]
    model = langid.build_model(langid.labelled_sample(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.lit(True)))
    assert model.languages == tuple(sorted(scripts))
    asked = spark.createDataFrame([(i, prose(k, 30), k) for i, k in enumerate(list(scripts) * 10)], "doc_id bigint, text string, lang string")
    out = langid.identify(asked, model, keep=["lang"]).toPandas()
    assert (out.lang == out.lang_pred).all()


def test_language_held_out(spark):
    out = queries.op1_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", F.length("text").alias("n")), "doc_id").where("held_out and n > 100").toPandas()
    assert (out.lang_pred == out.lang).mean() > 0.97


@pytest.mark.parametrize("op", [queries.op2_quality_gam, queries.op6_quality_rules])
def test_quality_held_out(spark, op):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = op(spark, "/root/testdata/sf0.01").join(labels, "doc_id")
    if op is queries.op2_quality_gam:
        rows = out.where("held_out").toPandas()
        assert (rows.predicted == rows.quality).mean() > 0.97
    else:
        rows = out.where("not base_failed").toPandas()
        assert (rows.kept == (rows.quality == 1)).mean() > 0.97


def test_additive_model_is_a_sum_of_tables():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality_gam.fit(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.9 and any({a, b} == {0, 1} for a, b, _ in model.pairs)
    row = x[5]
    want = model.base + sum(t[np.searchsorted(e, v, side="right")] for t, e, v in zip(model.single, model.edges, row, strict=True)) + sum(t[np.searchsorted(model.coarse[a], row[a], side="right"), np.searchsorted(model.coarse[b], row[b], side="right")] for a, b, t in model.pairs)
    assert abs(model.logit(x)[5] - want) < 1e-12


def test_rule_counts(docs):
    texts = [r.text for r in docs.collect()] + [None, "a b c a b c", "x\n\nx\n x\nx", "#* a|b <é>"]
    got = rule_counts(pa.array(texts))

    for i, t in enumerate(texts):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        hit = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)} if len(set(windows)) < len(windows) else set()
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (got["n_words"][i], got["word_chars"][i], got["n_symbols"][i], got["n_dup_lines"][i], got["n_repeat_words"][i]) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))


def test_repeated_words_of_long_texts():
    from millrace.llm.text_stats import repeated_words

    rng = random.Random(1)
    words = [b"w%d" % rng.randrange(30) for _ in range(5000)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    count = {w: windows.count(w) for w in set(windows)}
    assert repeated_words(words) == len({k + j for k, w in enumerate(windows) if count[w] > 1 for j in range(3)})


def test_isolation_depth():
    x = np.concatenate([np.random.default_rng(1).normal(0, 0.01, (250, 1)), [[5.0]]])
    score = quality_rules.fit_forest(x).score(x)
    assert score.argmax() == 250


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BYTES)
    out = packing.pack(docs.repartition(5), BYTES, size=256, windows=4, group=2).toPandas()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for doc_id, own in out.groupby("doc_id"):
        ids = [*tok.encode(texts[doc_id], add_special_tokens=False).ids, 0]
        own = own.sort_values("start")
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() == len(ids) and set(own.doc_tokens) == {len(ids)}
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes())
    assert set(out.doc_id) == set(texts)
    sizes = out.groupby("sequence_id").length.sum()
    padding = sum(0 if n.bit_count() == 1 else 256 - n for n in sizes.tolist())
    assert sizes.max() <= 256 and padding == 0 and not out.duplicated(["sequence_id", "offset"]).any()


@pytest.mark.parametrize("interval", [64, 4096])
def test_epsilon_join(spark, interval):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16))
    x = np.concatenate([x, x[:60] + rng.normal(scale=0.08, size=(60, 16)), x[:5], 3 * x[:3]]).astype(np.float32)
    df = spark.createDataFrame([(1000 - i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in epsilon_join.near_vectors(df, interval=interval).collect()}
    u = x.astype(np.float64)
    u /= np.sqrt((u * u).sum(1))[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    root = groups(range(1001 - len(x), 1001), [(1000 - i, 1000 - j) for i, j in np.argwhere(near)])
    assert got == {1000 - i: (int(near[i].sum()), root[1000 - i]) for i in range(len(x))}


def test_epsilon_join_of_ids_that_repeat_and_lengths_that_differ(spark):
    rng = np.random.default_rng(3)
    base = [rng.normal(size=d) for d in (2, 3, 3, 16, 16)]
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [1.0, 0.02]), (3, [1.0, 0.02])] + [(10 + i % 37, (base[i % 5] + rng.normal(scale=0.2, size=len(base[i % 5]))).tolist()) for i in range(120)]
    got = sorted(tuple(r)[:3] for r in epsilon_join.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3), interval=16, sample_rows=50).collect())
    cos = lambda a, b: len(a) == len(b) and np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)) >= 0.9
    near = [[i != j and cos(a, b) for j, (_, b) in enumerate(rows)] for i, (_, a) in enumerate(rows)]
    root = groups(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if near[i][j]])
    least = {}
    for i, (v, _) in enumerate(rows):
        least[root[i]] = min(v, least.get(root[i], v))
    assert got == sorted((v, sum(near[i]), least[root[i]]) for i, (v, _) in enumerate(rows))


def test_no_link_below_the_least_cosine():
    """Cosines of just 0.9 and just below it, told apart by exact sums."""
    from fractions import Fraction

    from millrace.llm.epsilon_join import join_intervals

    x = np.array([[1.0, 0.0, 0.0]])
    sizes = [k * 2.0**-26 for k in range(60_000_000, 60_000_400)]
    y = np.array([[v, math.sqrt(v * v * (1 / 0.81 - 1)), 0.0] for v in sizes])
    found = {j for _, js in join_intervals(x, y, False, np.eye(3, 2), 0.9) for j in js.tolist()}
    exact = [Fraction(p) ** 2 >= Fraction(0.9) ** 2 * (Fraction(p) ** 2 + Fraction(q) ** 2) for p, q, _ in y.tolist()]
    assert 0 < sum(exact) < len(exact)
    wrong = [j for j, e in enumerate(exact) if e != (j in found)]
    assert all(abs(Fraction(y[j][0]) ** 2 / (Fraction(y[j][0]) ** 2 + Fraction(y[j][1]) ** 2) - Fraction(0.9) ** 2) < Fraction(1, 10**15) for j in wrong) and len(wrong) < len(exact) // 2


def test_blocks_meet_as_boxes_do(spark):
    from millrace.llm.epsilon_join import _meeting

    rng = random.Random(7)
    boxes = [(k, 0.1 * k + rng.random() * 0.05, 0.1 * k + 0.1 + rng.random() * 0.2) for k in range(70)]
    met = {tuple(r) for r in _meeting(spark.createDataFrame(boxes, "block bigint, lo_p0 double, hi_p0 double"), 70, ["p0"], 0.04, fan=4).collect()}
    assert met == {(a, b) for a, la, ha in boxes for b, lb, hb in boxes if a <= b and max(0, la - hb, lb - ha) ** 2 <= 0.04}


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs):
    own = docs.unionByName(spark.createDataFrame([(5000, "ÄÖ One  two"), (5001, "äö one two"), (5002, ""), (5003, None), (5004, "ONE two Three four")], "doc_id bigint, text string"), allowMissingColumns=True)
    rows = {r.doc_id: r.text for r in own.collect()}
    want = {d: _fingerprint(t) for d, t in rows.items()}
    ids = sorted(want)
    root = groups(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (want[a] ^ want[b]).bit_count() <= 2])
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(own).collect()}
    assert got == {d: (want[d], root[d]) for d in ids}


@pytest.mark.parametrize("tile", [3, 4096])
def test_simhash_tiles(spark, tile):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)] + [0, 2**64 - 1, 3, 7]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (2**64 - 1) for b in base for _ in range(4)} | set(base))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame(list(zip(signed, range(len(fps)), strict=True)), "fp bigint, rep bigint")
    got = {r.node: r.component for r in connected_components(simhash.links(df, tile=tile)).collect()}
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    root = groups(range(len(fps)), links)
    assert got == {n: root[n] for p in links for n in p}


def _passages(texts, least):
    """Words of each text that lie in a run of at least so many words that another text holds."""
    split = {d: t.split() for d, t in texts.items()}
    where = {}
    for d, w in split.items():
        for i in range(len(w) - least + 1):
            where.setdefault(tuple(w[i : i + least]), set()).add(d)
    return {d: {i + k for i in range(len(w) - least + 1) if where[tuple(w[i : i + least])] != {d} for k in range(least)} for d, w in split.items()}, where, split


def test_suffix_passages(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(5, 9)))
    shared = [[word() for _ in range(n)] for n in (49, 50, 51, 80, 300)]
    texts = {}
    for d in range(60):
        body = [[word() for _ in range(rng.randrange(0, 90))] for _ in range(3)]
        picked = rng.sample(shared, 2) if d % 2 else []
        texts[d] = " ".join(sum([*body[:1], *picked[:1], *body[1:2], *picked[1:], *body[2:]], []))
    texts |= {100: texts[1], 101: texts[1], 102: texts[4]}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    want, _, split = _passages(texts, 50)
    spans = suffix_dedup.shared_passages(df).collect()
    got = {d: set() for d in texts}
    for r in spans:
        got[r.doc_id] |= set(range(r["first"], r["last"]))
        assert texts[r.doc_id][r.start : r.start + r.length].split() == split[r.doc_id][r["first"] : r["last"]]
    assert {d: w for d, w in got.items() if w} == {d: w for d, w in want.items() if w}
    cut = {r.doc_id: r.text for r in suffix_dedup.cut_later(df).collect()}
    again, _, _ = _passages(cut, 50)
    assert not any(again.values())
    assert all(cut.get(d) == t for d, t in texts.items() if not want[d])
    everything = " ".join(cut.values()).split()
    assert all(" ".join(s) in " ".join(everything) for s in shared)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, "/root/testdata/sf0.01").cache()
        seen.append((name, after.count()))
        if name != "packing":
            assert after.columns == docs.columns
            assert after.join(before, "doc_id", "left_anti").count() == 0
        if name == "near_dedup":
            sets = {r.doc_id: set(similar.shingle_hashes(r.text.encode(), 5).tolist()) for r in after.collect()}
            holders = {}
            for d, own in sets.items():
                for h in own:
                    holders.setdefault(h, []).append(d)
            for a, b in {(a, b) for ds in holders.values() for a in ds for b in ds if a < b}:
                assert len(sets[a] & sets[b]) < 0.8 * len(sets[a] | sets[b])
        if name == "suffix_dedup":
            assert not any(_passages({r.doc_id: r.text for r in after.collect()}, 50)[0].values())
            ids = {r.doc_id for r in after.select("doc_id").collect()}
        before = after
    assert {r.doc_id for r in before.select("doc_id").distinct().collect()} == ids
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.01").agg(F.sum("length")).first()[0] == before.agg(F.sum("length")).first()[0]
