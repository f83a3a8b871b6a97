"""Merkle manifests of data sets: a tree of SHA-256 digests for each group, a tree over the groups' roots, and proofs.

The nodes lie in an external store: Parquet, a folder for each level. Level 0
is written from sorted runs of leaves; each level above is made from the one
below it, a run of `fan` nodes at a time. Proofs are read off by coordinate,
from the top down: a run meets the run above it by (group, number), both of
them unique, so a group of any size meets itself a run at a time.

All steps are DataFrame operations. No task and no row holds more than a run
and the siblings above it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.base import discard, materialize, new_path

FAN = 8


def digest_of(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the values one after another: `-` for null, else the length in UTF-8 bytes, `:` and the value as text."""
    said = (v.cast("string") for v in values)
    return F.sha2(F.concat(*(F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)) for s in said)), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path, (left, right) siblings level by level, lead to."""
    return F.aggregate(path, leaf, lambda own, step: F.sha2(F.concat(step["left"], own, step["right"]), 256))


def siblings_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def _numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """rows (group and others) with nth, their place in the group from 0, and size, the group's rows; and the tables that this reads.

    Groups are sorted over all tasks by ranges, so a large one lies in many. A
    row's place is its place in its task and the rows of earlier tasks.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    written = materialize(rows.repartitionByRange(parts, "group", *order).sortWithinPartitions("group", *order).withColumn("at", F.monotonically_increasing_id()))
    runs = written.withColumn("task", F.shiftright("at", 33))
    counts = runs.groupBy("group", "task").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    by = Window.partitionBy("group")  # a row for each task that the group lies in
    before = F.coalesce(F.sum("n").over(by.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialize(counts.select("group", "task", (before - F.col("first")).alias("shift"), F.sum("n").over(by).alias("size")))
    return runs.join(starts, ["group", "task"]).withColumn("nth", F.col("at") + F.col("shift")).drop("at", "task", "shift"), [written, starts]


def _runs(nodes: DataFrame, fan: int, *carry: Column) -> DataFrame:
    """(group, run, size, nodes, and carry as arrays): each run's digests in order, and what its nodes carry."""
    held = F.struct("nth", "digest", *carry)
    runs = nodes.groupBy("group", F.floor(F.col("nth") / fan).alias("run")).agg(F.first("size").alias("size"), F.array_sort(F.collect_list(held)).alias("held"))  # fan at most
    return runs.select("group", "run", "size", F.col("held.digest").alias("nodes"), *([F.col("held.row").alias("rows")] if carry else []))


@dataclass
class Store:
    """A node store: levels[k] has (group, run, size, nodes) of level k, size being the group's nodes there; level 0 has rows as well."""

    path: str
    levels: list[DataFrame]
    fan: int

    def tops(self) -> DataFrame:
        """(group, digest): each group's root, a lone leaf itself."""
        alone = [x.where("size = 1").select("group", F.col("nodes")[0].alias("digest")) for x in self.levels]
        out = alone[0]
        for x in alone[1:]:
            out = out.unionByName(x)
        return out


def build(leaves: DataFrame, *, order: list[str], carry: list[str], fan: int = FAN) -> Store:
    """The store of leaves (group, digest, and the columns of order and carry), a tree for each group.

    group is text and not null. While a group has several nodes, every fan
    consecutive ones become the digest of theirs; the last run may be shorter, and
    even one becomes its digest. Rows that are equal in order must be told apart by digest or be
    alike: their places are any. No leaves: an empty store of one level.
    """
    path = new_path(leaves.sparkSession)
    nodes, read = _numbered(leaves.select(*dict.fromkeys(["group", "digest", *order, *carry])), order)
    levels = [materialize(_runs(nodes, fan, F.struct(F.lit(0).alias("_"), *carry).alias("row")), f"{path}/level=0")]
    discard(*read)
    most = levels[0].agg(F.max("size")).first()[0] or 1
    while most > 1:
        up = levels[-1].where("size > 1").select("group", F.col("run").alias("nth"), F.ceil(F.col("size") / fan).alias("size"), F.sha2(F.array_join("nodes", ""), 256).alias("digest"))
        levels.append(materialize(_runs(up, fan), f"{path}/level={len(levels)}"))
        most = -(-most // fan)
    return Store(path, levels, fan)


def _step(nodes: Column, place: Column, fan: int) -> Column:
    """The siblings left and right of a run's node."""
    return F.struct(F.array_join(F.slice(nodes, F.lit(1), place), "").alias("left"), F.array_join(F.slice(nodes, place + 2, F.lit(fan)), "").alias("right"))


def paths(store: Store, above: DataFrame | None = None) -> DataFrame:
    """(group, top, path, and what level 0 carries) of every leaf.

    top is the group's root. path has the siblings (left, right) from the leaf up to
    it, and goes on as above (group, path) says. A merge of each level's
    runs with the one above hands paths down: a parent has fan children at most.
    """
    tops = store.tops().withColumnRenamed("digest", "top")
    if above is None:
        tops = tops.withColumn("beyond", F.expr("cast(array() as array<struct<left: string, right: string>>)"))
    else:
        tops = tops.join(above.select("group", F.col("path").alias("beyond")), "group")
    upper = None
    for level in reversed(store.levels):
        # A group's root stands alone on its level: there its path begins.
        down = level.where("size = 1").join(tops, "group")
        if upper is not None:
            at = (F.col("run") % store.fan).cast("int")
            parents = upper.select("group", F.col("run").alias("parent"), F.col("size").alias("among"), F.col("nodes").alias("kin"), "top", F.col("beyond").alias("on"))
            met = level.where("size > 1").withColumn("parent", F.floor(F.col("run") / store.fan)).join(parents, ["group", "parent"])
            on = F.when(F.col("among") == 1, F.col("on")).otherwise(F.concat(F.array(_step(F.col("kin"), at, store.fan)), F.col("on")))
            inner = met.withColumn("beyond", on)  # a root has no siblings
            down = down.unionByName(inner.select(*down.columns))
        upper = down
    each = upper.select("group", "size", "nodes", "top", "beyond", F.posexplode("rows").alias("place", "row"))
    own = F.when(F.col("size") == 1, F.col("beyond")).otherwise(F.concat(F.array(_step(F.col("nodes"), F.col("place"), store.fan)), F.col("beyond")))
    return each.select("group", "top", own.alias("path"), "row.*").drop("_")


def manifest(rows: DataFrame, *, group: str, order: list[str], digest: str, carry: list[str], fan: int = FAN) -> DataFrame:
    """(carry, subroot, root, path) of every row: a tree for each value of group, and one over the groups' roots.

    Groups stand in bytewise order, null first. Rows of a group stand by order,
    nulls first, then by digest. Null and empty values, very long texts, ties and repeated
    rows are leaves like any other; rows alike in all of it may swap places. No rows: no result.
    """
    # Null comes before all other values, and each value in its own bytes' order.
    key = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    # Rows that are alike have a number each, so that any number of them can be parted by ranges.
    numbered = [f"o{i}" for i in range(len(order))]
    own = rows.select(key.alias("group"), F.col(digest).alias("digest"), *(F.col(c).alias(n) for c, n in zip(order, numbered, strict=True)), F.monotonically_increasing_id().alias("row_"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)))
    leaves = materialize(own)
    store = build(leaves, order=[*numbered, "digest", "row_"], carry=[f"c{i}" for i in range(len(carry))], fan=fan)
    discard(leaves)
    over = build(store.tops().select(F.lit("").alias("group"), "digest", F.col("group").alias("own")), order=["own"], carry=["own"], fan=fan)
    groups = materialize(paths(over).select(F.col("own").alias("group"), "path", F.col("top").alias("root")))
    root = groups.select("root").first()
    found = paths(store, groups).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)), F.col("top").alias("subroot"), "path")
    return found.select(*carry, "subroot", F.lit(root[0] if root else None).cast("string").alias("root"), "path")
