"""Embedding near-duplicates by epsilon grid order join.

Unit vectors within a cosine of each other lie within a distance, epsilon.
Vectors are laid out in the order of their grid cells of side epsilon on the
leading principal dimensions and cut into sequence intervals. Pairs of
intervals whose boxes lie apart by epsilon or more are skipped; the others are
halved, and skipped again where boxes lie apart, down to blocks that one
matrix product compares. Equal vectors are one class.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.base import discard, materialize
from millrace.llm.components import connected_components, roots


def _valid(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector as doubles; None if it is null, empty or zero, or has a component that is null or not finite."""
    if not column.null_count and not column.flatten().null_count and len(column):
        sizes = np.diff(column.offsets.to_numpy())
        if len(set(sizes.tolist())) == 1 and sizes[0]:
            x = column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)
            good = np.isfinite(x).all(axis=1) & x.any(axis=1)
            return [v if ok else None for v, ok in zip(x, good, strict=True)]
    out = []
    for x in column:
        v = None if x.as_py() is None else np.array([np.nan if y is None else y for y in x.as_py()], dtype=np.float64)
        out.append(v if v is not None and len(v) and np.isfinite(v).all() and v.any() else None)
    return out


def _units(raw: list[bytes], kind: str) -> np.ndarray:
    x = _scaled(raw, kind)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _scaled(raw: list[bytes], kind: str) -> np.ndarray:
    """The vectors as doubles, each over a power of two, which changes no digit."""
    x = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _cosine(p: list[float], q: list[float]) -> float:
    """With sums that are rounded once."""
    total = lambda a, b: math.fsum(x * y for x, y in zip(a, b, strict=True))
    return total(p, q) / math.sqrt(total(p, p) * total(q, q))


def join_intervals(x: np.ndarray, y: np.ndarray, same: bool, axes: np.ndarray, least: float, leaf: int = 512):
    """Index pairs (i of x, j of y; i < j if same) with cosine >= least, in parts; x and y are vectors in grid order.

    A product in single precision, with its error bound, finds what may be near;
    cosines in double precision decide, and where those are within 1e-12 of least, exact sums.
    """
    ux, uy = (v / np.sqrt((v * v).sum(axis=1, keepdims=True)) for v in (x, y))
    px, py = ux @ axes, uy @ axes
    fx, fy = ux.astype(np.float32), uy.astype(np.float32)
    slack = 2.0**-23 * (x.shape[1] + 4)
    eps2 = 2 - 2 * least + 1e-9
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if a >= b or c >= d or (same and d <= a):
            continue
        gap = np.maximum(0, np.maximum(px[a:b].min(0) - py[c:d].max(0), py[c:d].min(0) - px[a:b].max(0)))
        if (gap * gap).sum() > eps2:
            continue
        if b - a > leaf or d - c > leaf:
            m, n = (a + b) // 2 if b - a > leaf else b, (c + d) // 2 if d - c > leaf else d
            todo += [(i, j, k, e) for i, j in {(a, m), (m, b)} for k, e in {(c, n), (n, d)}]
            continue
        i, j = np.nonzero(fx[a:b] @ fy[c:d].T >= np.float32(least - slack))
        i, j = i + a, j + c
        if same:
            i, j = i[i < j], j[i < j]
        cos = np.einsum("ij,ij->i", ux[i], uy[j])
        keep = cos >= least
        for k in np.flatnonzero(np.abs(cos - least) <= 1e-12):
            keep[k] = _cosine(x[i[k]].tolist(), y[j[k]].tolist()) >= least
        if keep.any():
            yield i[keep], j[keep]


def _principal(sample: np.ndarray, axes: int) -> np.ndarray:
    centred = sample - sample.mean(axis=0)
    _, vectors = np.linalg.eigh(centred.T @ centred)
    return vectors[:, ::-1][:, :axes]


class _Axes:
    """Leading axes for vectors of each length: principal ones of the sample, coordinates where the sample holds too few."""

    def __init__(self, sample: list[bytes], kind: str, most: int):
        self.most, self.held = most, {}
        by_size: dict[int, list[bytes]] = {}
        for raw in sample:
            by_size.setdefault(len(raw) // np.dtype(kind).itemsize, []).append(raw)
        for dim, own in by_size.items():
            if len(own) > most:
                self.held[dim] = _principal(_units(own, kind), min(most, dim))

    def of(self, dim: int) -> np.ndarray:
        return self.held[dim] if dim in self.held else np.eye(dim, min(self.most, dim))


def near_vectors(vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", least: float = 0.9, axes: int = 6, interval: int = 8192, sample_rows: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row.

    The axes are fitted on at most sample_rows vectors, by the order of a hash;
    they steer what is skipped, not what is found. Vectors that are null,
    empty or zero, or hold null or non-finite components, link with nothing, as do
    vectors without id; vectors link with those of the same length only. Rows
    that repeat a vector are links of each other. Rows that repeat an id with
    different vectors each have the links of their own vector.
    """
    single = vectors.schema[vector].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"

    def digest(batches):
        for batch in batches:
            raw = [None if v is None else v.astype(kind).tobytes() for v in _valid(batch.column(1))]
            key = [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key, pa.binary()), pa.array([None if r is None else len(r) // int(kind[-1]) for r in raw], pa.int32()), pa.array(raw, pa.binary())], names=["vec_id", "key", "dim", "raw"])

    rows = vectors.select(F.col(id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v")).mapInArrow(digest, "vec_id bigint, key binary, dim int, raw binary")
    rows = materialize(rows)
    # A class for each different vector; numbers are given once, when they are written.
    same = rows.where("vec_id is not null and key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("raw").alias("raw"))
    unique = materialize(same.withColumn("node", F.monotonically_increasing_id()))
    classes = unique.select("key", "node", "rep", "copies")
    sample = unique.select("dim", "raw", F.xxhash64("key").alias("h")).orderBy("h").limit(sample_rows).select("raw").collect()
    stars = materialize(_joined(unique.select("node", "copies", "dim", "raw"), _Axes([bytes(r.raw) for r in sample], kind, axes), kind, least, interval))
    found = connected_components(stars.where("node <> root").select("node", "root")).toDF("n1", "component")
    counts = stars.groupBy(F.col("node").alias("n2")).agg(F.sum("add").alias("add"))
    least_rep = classes.join(found, F.col("node") == F.col("n1")).groupBy(F.col("component").alias("c")).agg(F.min("rep").alias("least_rep"))
    groups = found.join(least_rep, F.col("component") == F.col("c")).select("n1", "least_rep")
    named = classes.join(counts, F.col("node") == F.col("n2"), "left").join(groups, F.col("node") == F.col("n1"), "left")
    named = materialize(named.select(F.col("key").alias("k"), (F.coalesce("add", F.lit(0)) + F.col("copies") - 1).cast("bigint").alias("n_links"), F.coalesce("least_rep", "rep").alias("component_id")))
    discard(unique, stars)
    out = rows.select("vec_id", "key").join(named, F.col("key") == F.col("k"), "left")
    linked = F.col("vec_id").isNotNull()
    return out.select("vec_id", F.when(linked, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("bigint").alias("n_links"), F.when(linked, F.coalesce("component_id", "vec_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _meeting(boxes: DataFrame, n: int, places: list[str], eps2: float, fan: int = 16) -> DataFrame:
    """(x, y) of blocks (numbers from 0 to n - 1) whose boxes lie within epsilon, x <= y: from one pair that holds all, each pair's parts meet, fan by fan of them, where theirs do."""
    level, held = 0, boxes.sparkSession.createDataFrame([(0, 0)], "x bigint, y bigint")
    while fan**level < n:
        level += 1
    for k in range(level - 1, -1, -1):
        own = boxes.groupBy(F.expr(f"block div {fan**k}").alias("at")).agg(*(F.min(f"lo_{p}").alias(f"lo_{p}") for p in places), *(F.max(f"hi_{p}").alias(f"hi_{p}") for p in places))
        sides = [own.select(F.expr(f"at div {fan}").alias(f"in_{s}"), F.col("at").alias(f"at_{s}"), *(F.col(f"{e}_{p}").alias(f"{e}_{p}_{s}") for e in ("lo", "hi") for p in places)) for s in "xy"]
        gap = sum((F.greatest(F.lit(0.0), F.col(f"lo_{p}_x") - F.col(f"hi_{p}_y"), F.col(f"lo_{p}_y") - F.col(f"hi_{p}_x")) ** 2 for p in places), F.lit(0.0))
        met = held.join(sides[0], F.col("x") == F.col("in_x")).join(sides[1], F.col("y") == F.col("in_y")).where((F.col("at_x") <= F.col("at_y")) & (gap <= eps2))
        after = materialize(met.select(F.col("at_x").alias("x"), F.col("at_y").alias("y")))
        discard(held)
        held = after
    return held


def _joined(own: DataFrame, axes: _Axes, kind: str, least: float, interval: int) -> DataFrame:
    """(node, root, add): for each class with links, its group's root within a pair of intervals, and how many vectors it is linked with there."""
    spark = own.sparkSession
    n_parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    eps, m = float(np.sqrt(max(0.0, 2 - 2 * least))) or 1e-9, axes.most
    cells, places = [f"g{j}" for j in range(m)], [f"p{j}" for j in range(m)]

    def by_size(dims: np.ndarray):
        return ((int(d), np.flatnonzero(dims == d)) for d in np.unique(dims))

    def project(batches):
        for batch in batches:
            if batch.num_rows:
                p, raw = np.zeros((batch.num_rows, m)), batch.column(3).to_pylist()
                for dim, at in by_size(batch.column(2).to_numpy()):
                    own_axes = axes.of(dim)
                    p[at, : own_axes.shape[1]] = _units([bytes(raw[i]) for i in at], kind) @ own_axes
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.floor(p[:, j] / eps).astype(np.int32)) for j in range(m)), *(pa.array(p[:, j]) for j in range(m))], names=["node", "copies", "dim", "raw", *cells, *places])

    shape = "node bigint, copies bigint, dim int, raw binary, " + ", ".join([*(f"{c} int" for c in cells), *(f"{p} double" for p in places)])
    order = ["dim", *cells, "node"]
    ordered = own.mapInArrow(project, shape).repartitionByRange(n_parts, *order).sortWithinPartitions(*order)

    def number(batches):
        from pyspark import TaskContext

        at, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int64)), pa.array(np.arange(at, at + n))], names=[*batch.schema.names, "part", "at"])
            at += n

    ordered = materialize(ordered.mapInArrow(number, f"{shape}, part bigint, at bigint"))
    # One number for each partition, of which there are n_parts.
    counts = {r.part: r.n for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(counts):
        before[part], total = total, total + counts[part]
    starts = F.broadcast(spark.createDataFrame(list(before.items()) or [(0, 0)], "part bigint, before bigint"))
    rows = ordered.join(starts, "part").withColumn("block", F.expr(f"(before + at) div {interval}"))
    boxes = materialize(rows.groupBy("block").agg(*(F.min(p).alias(f"lo_{p}") for p in places), *(F.max(p).alias(f"hi_{p}") for p in places)))
    met = _meeting(boxes, -(-total // interval), places, eps * eps + 1e-9)
    sent = rows.select("block", "at", "part", "node", "copies", "dim", "raw").join(met.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block")), "block")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("part", "ascending"), ("at", "ascending")])
        block, node, copies = (table.column(c).to_numpy() for c in ("block", "node", "copies"))
        raw = table.column("raw").to_pylist()
        twin = table.column("x")[0].as_py() == table.column("y")[0].as_py()
        n, first = len(node), block == block.min()
        add, root = np.zeros(n, dtype=np.int64), np.arange(n)
        for dim, at in by_size(table.column("dim").to_numpy()):
            v = _scaled([bytes(raw[i]) for i in at], kind)
            one, two = (at, at) if twin else (at[first[at]], at[~first[at]])
            a, b = (v, v) if twin else (v[first[at]], v[~first[at]])
            for i, j in join_intervals(a, b, twin, axes.of(dim), least):
                i, j = one[i], two[j]
                add += np.bincount(i, copies[j], n).astype(np.int64) + np.bincount(j, copies[i], n).astype(np.int64)
                root = roots(np.concatenate([i, np.arange(n)]), np.concatenate([j, root]), n)
        tied = np.flatnonzero(add)
        return pa.table({"node": node[tied], "root": node[root[tied]], "add": add[tied]})

    return sent.groupBy("x", "y").applyInArrow(compare, "node bigint, root bigint, add bigint")
