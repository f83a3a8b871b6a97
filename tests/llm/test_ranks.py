"""Ranks of hosts against a solved linear system."""

import numpy as np

from millrace.llm import url_filter


def test_long_chains_and_cycles(spark):
    chain = [(f"c{i}", f"c{i + 1}", 1) for i in range(12)]  # towards c12
    cycle = [(f"r{i}", f"r{(i + 1) % 9}", 2) for i in range(9)] + [("r4", "c3", 1)]
    edges = chain + cycle
    hosts = sorted({h for e in edges for h in e[:2]})
    at = {h: i for i, h in enumerate(hosts)}
    seeds = [("c12", 0.0, 1.0), ("r0", 0.5, 0.25), ("c0", 1.0, 0.0)]
    links = np.zeros((len(hosts), len(hosts)))
    for a, b, n in edges:
        links[at[a], at[b]] = n

    def solved(links, column):
        seed = np.zeros(len(hosts))
        for s in seeds:
            seed[at[s[0]]] = s[column]
        shares = links / np.maximum(links.sum(1, keepdims=True), 1)
        return np.linalg.solve(np.eye(len(hosts)) - 0.85 * shares.T, 0.15 * seed)

    want = zip(solved(links, 1), solved(links.T, 2), strict=True)
    got = {r.host: (r.trust or 0.0, r.distrust or 0.0) for r in url_filter.propagate(spark.createDataFrame(edges, "src string, dst string, links bigint"), spark.createDataFrame(seeds, "host string, trust double, distrust double")).collect()}
    for host, w in zip(hosts, want, strict=True):
        assert np.allclose(got.get(host, (0.0, 0.0)), w, rtol=0, atol=1e-9), host


def test_verdicts_on_a_chain(spark):
    rows = [(i, f"http://c{i}.test/x", f"<a href='http://c{i + 1}.test/'>") for i in range(11)] + [(11, "http://c11.test/x", "<a href='http://bad.net/'>"), (12, "http://bad.net/", None)]
    out = {r.host: r.verdict for r in url_filter.judge_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    # 0.15 * 0.85 ** n >= 0.075 up to four links away.
    assert out == {f"c{i}.test": "block" if 12 - i <= 4 else "allow" for i in range(12)} | {"bad.net": "block"}
