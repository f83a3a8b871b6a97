"""Connected components of a link table that stays distributed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.base import discard, materialize


def roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For links u-v among 0..n-1, the smallest member of each one's component."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if (low == high).all():
            return root
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]


def _contract(batches):
    """Links of one partition as stars: (member, smallest member) for each component found there."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = roots(at[: len(a)], at[len(a) :], len(ids))
        own = root != np.arange(len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[root[own]])], names=["a", "b"])


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (two bigint columns), component being the smallest node reachable.

    Alternating large-star and small-star rounds: each round hangs nodes on
    the smallest neighbour, and the number of rounds follows the logarithm of
    the longest chain. Hubs are dealt out by adaptive skew handling, since both
    sides of the join that meets them are plain exchanges over written tables.
    Nulls and links of a node to itself are left out.
    """
    a, b = links.columns
    pairs = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a is not null and b is not null and a <> b")
    edges = materialize(pairs.mapInArrow(_contract, "a bigint, b bigint"))
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = state
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("n")).where("u <> n").distinct())
        low = materialize(large.groupBy("u").agg(F.min("n").alias("m")))
        small = large.join(low, "u").where("n <> m").select(F.col("n").alias("a"), F.col("m").alias("b")).union(low.toDF("a", "b")).distinct()
        after = materialize(small)
        discard(edges, least, large, low)
        edges = after
