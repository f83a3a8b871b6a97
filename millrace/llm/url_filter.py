"""URL filters: rules on host and path, and link-graph propagation for the rest.

Native: DataFrame operations only. Trust flows from hosts with allowed pages
along links; distrust flows from hosts with blocked pages against them, to the
hosts that link there. Both are personalised PageRank over edges between hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.base import discard, materialize

#: verdict, host, path: a rule fits its host and all subdomains where the url's path starts with the rule's.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; then up to `?`, `#` or the end. Both empty if url is null or has no `://`."""
    there = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    parts = [F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k) for k in (1, 2)]
    return F.when(there, _ascii_lower(parts[0])).otherwise(""), F.when(there, parts[1]).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, both null if none does; of equally long ones the first."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), -rules.index(r))):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links) of absolute links between different hosts: pages has host and html."""
    found = pages.where("host <> '' and html is not null").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""), F.lit(1))).alias("dst"))
    return found.select("src", _ascii_lower(F.col("dst")).alias("dst")).where("src <> dst and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, *, damping: float = 0.85, tolerance: float = 1e-10) -> DataFrame:
    """(host, trust, distrust) from seeds (host, trust, distrust): each rank is below its limit by the tolerance at most.

    A host's rank is (1 - damping) times its seed and damping times the ranks that
    others pass on to it, in shares of the link counts: trust along links, distrust
    against them. Each round passes on what the round before brought and is written, until all
    that can still come, to all hosts together, is within the tolerance. Edges with
    nothing to carry drop out of the joins.
    """
    out = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("at"), F.col("dst").alias("to"), "links").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("at"), F.col("src").alias("to"), "links"))
    totals = out.groupBy("kind", "at").agg(F.sum("links").alias("total"))
    start = seeds.select(F.explode(F.array(F.struct(F.lit("trust").alias("kind"), "host", F.col("trust").alias("seed")), F.struct(F.lit("distrust").alias("kind"), "host", F.col("distrust").alias("seed")))).alias("s")).select("s.*").where("seed > 0")
    rank = materialize(start.select("kind", "host", ((1 - damping) * F.col("seed")).alias("rank"), ((1 - damping) * F.col("seed")).alias("fresh")))
    out, totals = materialize(out), materialize(totals)
    shares = out.join(totals, ["kind", "at"]).select("kind", "at", "to", (F.col("links") / F.col("total")).alias("share"))
    shares = materialize(shares)
    if shares.take(1):
        # A row without share for each host keeps what it has, so that a round is one join and one sum.
        stay = shares.select("kind", "at").union(shares.select("kind", "to")).union(rank.select("kind", "host")).distinct()
        steps = materialize(shares.unionByName(stay.select("kind", "at", F.col("at").alias("to"), F.lit(None).cast("double").alias("share"))))
        # What is fresh comes to damping / (1 - damping) times as much in all later rounds, at most.
        while (rank.agg(F.sum("fresh")).first()[0] or 0.0) * damping > tolerance * (1 - damping):
            before = rank
            # Both sides are written tables with plain exchanges, in every round, so that a hub's links are split over tasks.
            met = steps.join(rank.withColumnRenamed("host", "at"), ["kind", "at"]).where("share is null or fresh > 0")
            passed = met.select("kind", F.col("to").alias("host"), F.when(F.col("share").isNull(), F.col("rank")).otherwise(0.0).alias("rank"), F.coalesce(damping * F.col("share") * F.col("fresh"), F.lit(0.0)).alias("fresh"))
            rank = materialize(passed.groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("fresh").alias("fresh")).select("kind", "host", (F.col("rank") + F.col("fresh")).alias("rank"), "fresh"))
            discard(before)
    return rank.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("rank"))).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("rank"))).alias("distrust"))


def judge_pages(pages: DataFrame, *, id: str = "page_id", url: str = "url", html: str = "html", rules=RULES, damping: float = 0.85, least: float = 0.5) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    Where no rule fits, a host is blocked whose distrust exceeds its trust by
    (1 - damping) * least or more: by default, as much as half of its pages
    being blocked brings it without any link. A host's seeds are the shares of its pages that rules
    allow and block. Pages without host, and hosts that nothing reaches, are allowed. Null ids, urls and
    html give rows like any other; repeated rows each count.
    """
    host, path = host_and_path(F.col("url"))
    own = pages.select(F.col(id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")).withColumns({"host": host, "path": path})
    rule, by_rule = rule_of(F.col("host"), F.col("path"), rules)
    own = own.withColumns({"rule": rule, "by_rule": by_rule})
    # Sums by host are made in each task before they meet.
    seeds = own.where("host <> ''").groupBy("host").agg(F.avg((F.coalesce("by_rule", F.lit("")) == "allow").cast("double")).alias("trust"), F.avg((F.coalesce("by_rule", F.lit("")) == "block").cast("double")).alias("distrust"))
    ranks = propagate(host_edges(own.select("host", "html")), seeds, damping=damping)
    bad = materialize(ranks.where(F.round(F.coalesce("distrust", F.lit(0.0)) - F.coalesce("trust", F.lit(0.0)), 9) >= round((1 - damping) * least, 9)).select(F.col("host").alias("bad")))
    own = own.drop("html", "url")
    judged = own.join(bad, own["host"] == bad["bad"], "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("bad").isNotNull(), "block").otherwise("allow")).alias("verdict"))
