"""Trust and distrust over links, against SQL that writes the rounds out."""

import random

import duckdb
import pyarrow as pa

from millrace.llm import queries, url_filter


def test_ranks(spark):
    rng = random.Random(9)
    hosts = [f"h{i}.example.{t}" for i in range(12) for t in ("com", "org", "net")]
    pages = []
    for i in range(400):
        host = rng.choice(hosts)
        path = rng.choice(["/de/x", "/fr/x", "/en/x", "/y", ""])
        links = "".join(f'<a {rng.choice(["href", "HREF "])}={q}{rng.choice(["http:", "https:", ""])}//{rng.choice(hosts).upper() if rng.random() < 0.2 else rng.choice(hosts)}/p?q{q}>' for q in rng.choices(["'", '"'], k=rng.randrange(4)))
        pages.append((i, rng.choice([f"http://{host.title()}{path}?a#b", f"https://{host}{path}#t"]), links + "<a href='/local'>"))
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = {tuple(r) for r in url_filter.judge_pages(df).collect()}
    con = duckdb.connect()
    con.register("pages", pa.table(dict(zip(("page_id", "url", "html"), zip(*pages, strict=True), strict=True))))
    want = set(con.execute(queries.oracle_sql()["op9_url_filter"]).fetchall())
    assert got == want
    assert {(r[3], r[4]) for r in got} >= {(None, "allow"), (None, "block")}


def test_distrust_flows_against_links(spark):
    page = lambda i, host, to: (i, f"http://{host}/x", f"<a href='http://{to}/'>" if to else None)
    rows = [page(0, "farm.test", "bad.net"), page(1, "bad.net", None), page(2, "near.test", "farm.test"), page(3, "good.test", None)]
    out = {r.host: r.verdict for r in url_filter.judge_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert out == {"farm.test": "block", "bad.net": "block", "near.test": "block", "good.test": "allow"}
