"""Groups of similar texts against all pairs."""

import random

import pytest

from millrace.llm import similar
from plain_groups import groups


@pytest.mark.parametrize(("tile", "text_tile"), [(16, 4), (32_768, 512)])
def test_groups(spark, tile, text_tile):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    texts = {}
    for base in range(12):
        own = [word() for _ in range(rng.choice([30, 60, 200]))]
        for _ in range(rng.choice([1, 3, 25])):
            copy = [word() if rng.random() < rng.choice([0, 0.01, 0.02, 0.03, 0.06]) else w for w in own]
            texts[len(texts)] = " ".join(copy)
    texts |= {500: None, 501: "", 502: "Two words", 503: "two  WORDS", 504: texts[3].upper()}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    sets = {d: set(similar.shingle_hashes((t or "").encode(), 5).tolist()) for d, t in texts.items()}
    ids = sorted(texts)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (not sets[a] and not sets[b]) or len(sets[a] & sets[b]) >= 0.8 * max(1, len(sets[a] | sets[b]))]
    got = {r.doc_id: r.component_id for r in similar.similar_groups(df, tile=tile, text_tile=text_tile).collect()}
    assert got == groups(ids, links)
    kept = {r.doc_id for r in similar.keep_first(df).collect()}
    assert kept == set(got.values())


def test_tree_joins_what_its_pairs_join():
    import numpy as np

    rng = np.random.default_rng(4)
    u, v = rng.integers(0, 60, 300), rng.integers(0, 60, 300)
    u, v = u[u != v], v[u != v]
    far = rng.integers(0, 9, len(u))
    used = similar.tree(u, v, far, 60)
    whole, part = groups(range(60), list(zip(u, v, strict=True))), groups(range(60), [(u[i], v[i]) for i in used])
    assert whole == part and len(used) == 60 - len(set(whole.values()))


def test_common_shingles_are_counted_for_all_pairs_at_once(monkeypatch):
    """300 sets that are near but under 0.8 to most others cost no look at each pair; the groups are those of brute force, by any parts."""
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**62, 150).astype(np.uint64)

    def altered():
        new = rng.random(150) < rng.uniform(0.02, 0.3)
        return np.unique(np.where(new, rng.integers(0, 2**63, 150).astype(np.uint64), base))

    sets = [*(altered() for _ in range(300)), np.zeros(0, np.uint64)]
    size = np.array([len(s) for s in sets])
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    monkeypatch.setattr(np, "intersect1d", None)
    for options in ({}, {"most": 5000, "rare": 3, "columns": 50, "fold": 64}):
        assert (similar.common_counts(sets, sets, **options) == want).all()
    alike = want >= 0.8 * (size[:, None] + size[None, :] - want)
    none = np.zeros(len(sets), np.uint64)
    for second in (np.zeros(len(sets), bool), np.arange(len(sets)) % 3 == 0):
        twin = not second.any()
        links = alike if twin else alike & (second[:, None] != second[None, :])
        u, v = np.nonzero(links)
        got = np.array(similar._joined(none, none, size, sets, second, twin, 33, 0.8))
        assert alike[got[:, 0], got[:, 1]].all() and 0 < alike.sum() < 0.9 * alike.size
        assert groups(range(len(sets)), got.tolist()) == groups(range(len(sets)), list(zip(u.tolist(), v.tolist(), strict=True)))
