"""The quality operators' features, trees and paths against plain versions, text by text."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import quality_gam, quality_rules, queries
from millrace.llm.base import held_out
from millrace.llm.text_stats import FEATURES, features, rule_counts

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
ODD = [None, "", " \n\t", "a", "É", "日本 語!", "a b c a b c a", "x\n\nx\n x\nx", "#*$%&|<> !!! 12.3", "UPPER lower ßÀ", "w" * 5000, "one two three\n" * 400]


@pytest.fixture(scope="module")
def table(spark):
    return {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels")}


def plain_counts(text):
    t = text or ""
    words = re.findall(WORD, t)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    times = {}
    for w in windows:
        times[w] = times.get(w, 0) + 1
    repeated = len({k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(3)})
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeated}


def plain_features(text):
    t = text or ""
    if not t:
        return [0.0] * len(FEATURES)
    share = lambda test: sum(map(test, t)) / len(t)
    lower, upper, foreign = share(lambda c: "a" <= c <= "z"), share(lambda c: "A" <= c <= "Z"), share(lambda c: ord(c) > 127)
    words, n_lines, counts = re.findall(WORD, t), t.count("\n") + 1, plain_counts(t)
    n, kinds = len(words), len(set(words))
    size = lambda x: len(x.encode())
    return [
        math.log1p(n), min(size(t) / n, 1000) if n else 0, share(lambda c: c in "#*$%&|<>"), upper / max(lower + upper, 1e-9), share(lambda c: "0" <= c <= "9"), share(lambda c: c in ".,;:?'\"()-"), share(lambda c: c == "!"), foreign,
        kinds / n**0.8 if n else 0, counts["n_repeat_words"] / n if n else 0, counts["n_dup_lines"] / n_lines, math.log1p(n / n_lines), math.log1p(max(map(size, words), default=0)), lower + upper + foreign, kinds / n if n else 0,
    ]


def test_features(table):
    texts = ODD + [r.text for r in table["documents"].collect()]
    got = features(pa.array(texts))
    assert np.isfinite(got).all()
    np.testing.assert_allclose(got, [plain_features(t) for t in texts], rtol=1e-9, atol=1e-12)


def test_scores_are_sums_of_plain_features(spark, table):
    """op2 over the whole table: each score is the logistic of the entries that the text's own features point at."""
    model = quality_gam.fit(*quality_gam.labelled_features(table["documents"], table["labels"], ~held_out()))
    place = lambda edges, v: sum(e <= v for e in edges)
    texts = {r.doc_id: r.text for r in table["documents"].collect()}
    got = {r.doc_id: r for r in queries.op2_quality_gam(spark, SF).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        x = features(pa.array([t]))[0]  # bins' edges are met exactly, so the last bits count; test_features holds the values
        total = model.base + sum(t[place(e, v)] for t, e, v in zip(model.single, model.edges, x, strict=True)) + sum(t[place(model.coarse[a], x[a]), place(model.coarse[b], x[b])] for a, b, t in model.pairs)
        assert abs(got[i].score - 1 / (1 + math.exp(-total))) < 1e-9 and got[i].predicted == (got[i].score >= 0.5)


def test_tree_takes_the_best_cut():
    rng = np.random.default_rng(5)
    for _ in range(50):
        g, h = rng.normal(size=9), rng.uniform(0.1, 1, 9)
        worth = lambda s: g[s].sum() ** 2 / (h[s].sum() + 5.0)  # noqa: E731, B023
        best = max(range(1, 9), key=lambda k: worth(slice(0, k)) + worth(slice(k, 9)))
        if worth(slice(0, best)) + worth(slice(best, 9)) <= worth(slice(0, 9)):
            best = 9  # no cut gains over the ridge: one leaf
        step = lambda s: g[s].sum() / (h[s].sum() + 5.0)  # noqa: E731, B023
        want = [step(slice(0, best))] * best + [step(slice(best, 9))] * (9 - best)
        np.testing.assert_allclose(quality_gam._tree(g, h, 2, 5.0), want)
        g2, h2 = rng.normal(size=(4, 3)), rng.uniform(0.1, 1, (4, 3))
        sums = lambda i, j: sum(g2[r, c].sum() ** 2 / (h2[r, c].sum() + 5.0) for r in (slice(0, i), slice(i, 4)) for c in (slice(0, j), slice(j, 3)))  # noqa: E731, B023
        assert abs(quality_gam._cross(g2, h2, 5.0)[1] - (max(sums(i, j) for i in range(1, 4) for j in range(1, 3)) - g2.sum() ** 2 / (h2.sum() + 5.0))) < 1e-9


def plain_score(forest, row):
    """Each tree walked by hand."""
    total = 0.0
    for t in range(len(forest.feature)):
        at = 0
        while forest.feature[t, at] >= 0:
            at = forest.left[t, at] + int(row[forest.feature[t, at]] >= forest.value[t, at])
        total += forest.path[t, at]
    return 2 ** (-total / len(forest.feature) / forest.normal)


def test_paths_of_whole_samples():
    """With the sample all of the rows, a leaf's path is its depth and the mean search among the rows that end there."""
    x = np.round(np.random.default_rng(4).normal(size=(64, 3)), 1)
    forest = quality_rules.fit_forest(x, trees=5, sample=64)
    mean = lambda n: 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n
    for t in range(5):
        ends = []
        for row in x:
            at = depth = 0
            while forest.feature[t, at] >= 0:
                at, depth = forest.left[t, at] + int(row[forest.feature[t, at]] >= forest.value[t, at]), depth + 1
            ends.append((int(at), depth))
        for at, depth in set(ends):
            assert depth <= 6 and abs(forest.path[t, at] - (depth + mean(sum(e == at for e, _ in ends)))) < 1e-12
    np.testing.assert_allclose(forest.score(x), [plain_score(forest, r) for r in x])


def test_verdicts(spark, table):
    """op6 over the whole table: counts, base rules and the forests' verdict by hand."""
    rules = quality_rules.fit_rules(table["documents"], table["labels"], ~held_out())
    texts = {r.doc_id: r.text for r in table["documents"].collect()}
    got = {r.doc_id: r for r in queries.op6_quality_rules(spark, SF).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        c, r = plain_counts(t), got[i]
        assert {k: r[k] for k in c} == c
        failed = c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]
        words, chars = max(1, c["n_words"]), max(1, c["word_chars"])
        x = np.array([min(0.25, max(0.005, c["n_symbols"] / chars)), c["n_repeat_words"] / words, c["n_dup_lines"] / words, np.log(chars / words)])
        odd = max((plain_score(f, x[list(columns)]) / threshold for columns, f, threshold in rules.parts), default=0.0)
        assert abs(r.anomaly - odd) < 1e-9 and (r.base_failed, r.kept) == (failed, not failed and r.anomaly < 1)


def test_repeated_ids_learn_alike(spark):
    """Of an id's several texts the one with the smallest features, or counts, is learnt from, however rows are dealt."""
    rows = [(i % 5, f"word{j} " * (10 + i) + "tail", j) for i in range(20) for j in range(2)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id bigint, quality int")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n int")
    for learn in (quality_gam.labelled_features, quality_rules.labelled_counts):
        first, second = (learn(docs.orderBy(o).repartition(p), labels, held_out().isNotNull()) for o, p in (("text", 3), ("n", 7)))
        one, two = (x if isinstance(x, np.ndarray) else np.column_stack([x[c] for c in quality_rules.COUNTS]) for x in (first[0], second[0]))
        assert len(one) == 5 and (one == two).all() and (first[1] == second[1]).all()
        want = {i: min(tuple(features(pa.array([t]))[0]) if learn is quality_gam.labelled_features else tuple(rule_counts(pa.array([t]))[c][0] for c in quality_rules.COUNTS) for d, t, _ in rows if d == i) for i in range(5)}
        assert [tuple(r) for r in one] == [want[i] for i in range(5)]


def test_rules_learn_from_every_labelled_row(spark):
    """op6's thresholds come from all labelled texts, 9,000 here, and are those of the plain fit over all of them."""
    def text(i):
        if i % 50:
            return " ".join(f"w{i % 89}x{j}" for j in range(60))
        return " ".join("#$" if j < 8 + i % 7 else f"v{i % 89}y{j}" for j in range(60))  # labelled bad

    docs = spark.createDataFrame([(i, text(i)) for i in range(9000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 50 > 0)) for i in range(9000)], "doc_id bigint, quality int")
    counts, good = quality_rules.labelled_counts(docs, labels, held_out().isNotNull())
    assert len(good) == 9000
    passed = ~quality_rules.base_failed(counts)
    want = quality_rules.fit(quality_rules.statistics(counts)[passed], good[passed])
    got = quality_rules.fit_rules(docs, labels, held_out().isNotNull())
    assert want.parts and [(c, t) for c, _, t in got.parts] == [(c, t) for c, _, t in want.parts]


def test_threshold_of_a_table_is_that_of_arrays(spark):
    """Tied scores, odd spreads and one label only."""
    rng = np.random.default_rng(3)
    for n, digits, bad in ((3000, 2, 0.1), (3000, 9, 0.1), (5000, 5, 0.001), (40, 9, 0.5), (50, 3, 0.0), (50, 3, 1.0)):
        good = rng.uniform(size=n) >= bad
        score = np.round(np.where(good, rng.beta(4, 8, n), rng.beta(9, 4, n)), digits)
        rows = spark.createDataFrame(list(zip(score.tolist(), good.tolist(), strict=True)), "s0 double, good boolean")
        for loss in (0.0005, 0.02, 0.3):
            assert quality_rules.threshold(rows, "s0", loss=loss) == quality_rules.calibrate(score, good, loss=loss)
