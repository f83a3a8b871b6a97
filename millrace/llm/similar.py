"""SimHash near-duplicates at a similarity: tiled comparison of wide fingerprints, then the shingle sets themselves.

A fingerprint of 128 bits has few bits in common by chance, so a radius that
holds nearly all pairs of the similarity asked for lets few others in. Each
pair of tiles passes on a tree of its nearest pairs, which holds together all
that lies within the radius. The texts of what a tree holds together then meet
in tiles of their own, where the shingles in common are counted for all pairs
within the radius at once. What is passed on grows with the number of texts,
not of pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.base import map_texts, materialize
from millrace.llm.components import connected_components

def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """Distinct hashes of the word shingles, A-Z lower-cased; of the whole sequence if it is shorter; none without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(b" ".join(words))], dtype=np.uint64)
    joined = b" ".join(words)
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
    starts = [0, *(e + 1 for e in ends)]
    return np.unique(np.array([xxh64_intdigest(joined[a:b]) for a, b in zip(starts, ends[shingle - 1 :], strict=False)], dtype=np.uint64))


def _majority(h: np.ndarray) -> int:
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little", signed=True) if len(h) else 0


def sketches(docs: DataFrame, *, keep: list[str], text: str = "text", shingle: int = 5) -> DataFrame:
    """keep, f1 and f2 (two halves of a fingerprint over distinct shingles) and n (how many those are) of whole texts."""

    def run(texts: pa.Array) -> dict:
        out = []
        for x in texts.cast(pa.large_binary()).to_pylist():
            h = shingle_hashes(x or b"", shingle)
            with np.errstate(over="ignore"):
                g = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
                g = (g ^ (g >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
                g ^= g >> np.uint64(32)
            out.append((_majority(h), _majority(g), len(h)))
        return {c: pa.array(x, pa.int64()) for c, x in zip(("f1", "f2", "n"), zip(*out, strict=True) if out else ((), (), ()), strict=True)}

    return map_texts(docs, keep, text, lambda: run, "f1 bigint, f2 bigint, n bigint")


def tree(u: np.ndarray, v: np.ndarray, far: np.ndarray, n: int) -> np.ndarray:
    """Which of the pairs u-v make up a forest of nearest pairs over 0..n-1."""
    root, used = np.arange(n), []
    for level in np.unique(far):
        at = np.flatnonzero(far == level)
        while len(at):
            a, b = root[u[at]], root[v[at]]
            apart = a != b
            at, a, b = at[apart], a[apart], b[apart]
            if not len(at):
                break
            high, first = np.unique(np.maximum(a, b), return_index=True)
            root[high] = np.minimum(a, b)[first]
            used.append(at[first])
            while (root[root] != root).any():
                root = root[root]
    return np.concatenate(used) if used else np.zeros(0, dtype=np.int64)


def near_pairs(f1: np.ndarray, f2: np.ndarray, n: np.ndarray, first: np.ndarray, other: np.ndarray, twin: bool, radius: int, least: float, block: int = 1024):
    """(i, j, distance), in parts, of pairs between first and other (i < j if twin) whose fingerprints and sizes are near enough."""
    for i in range(0, len(first), block):
        x = first[i : i + block]
        for j in range(i if twin else 0, len(other), block):
            y = other[j : j + block]
            far = np.bitwise_count(f1[x][:, None] ^ f1[y][None, :])
            far += np.bitwise_count(f2[x][:, None] ^ f2[y][None, :])
            p, q = np.nonzero(far <= radius)
            d = far[p, q]
            p, q = x[p], y[q]
            ok = np.minimum(n[p], n[q]) >= least * np.maximum(n[p], n[q])
            if twin:
                ok &= p < q
            if ok.any():
                yield p[ok], q[ok], d[ok]


def _tree_of(rows: np.ndarray, radius: int, least: float, fold: int = 1 << 22):
    """(a, b): the tree of one pair of tiles, by reps; None without pairs. rows: two tiles' keys, second, f1, f2, n, rep."""
    second = rows[:, 4] == 1
    twin = bool(rows[0, 0] == rows[0, 2] and rows[0, 1] == rows[0, 3])
    a = np.flatnonzero(~second)
    held: list[tuple] = []

    def settle():
        if held:
            u, v, far = (np.concatenate(x) for x in zip(*held, strict=True))
            keep = tree(u, v, far, len(rows))
            held[:] = [(u[keep], v[keep], far[keep])]

    count = 0
    for part in near_pairs(rows[:, 5].view(np.uint64), rows[:, 6].view(np.uint64), rows[:, 7], a, a if twin else np.flatnonzero(second), twin, radius, least):
        held.append(part)
        count += len(part[0])
        if count > fold:  # a dense tile's pairs give way to their tree before there are too many
            settle()
            count = 0
    settle()
    return (rows[held[0][0], 8], rows[held[0][1], 8]) if held else None


def trees(classes: DataFrame, *, least: float, radius: int, tile: int) -> DataFrame:
    """(a, b) of reps over classes (f1, f2, n, rep): trees that hold together whatever pairs within the radius do."""
    # Sets whose sizes differ by more than the similarity allows can't be similar: only neighbouring size classes meet.
    placed = classes.withColumn("b", F.when(F.col("n") > 0, F.floor(F.log(F.col("n").cast("double")) / float(np.log(1 / least)) + 1e-9)).otherwise(-9).cast("bigint"))
    sizes = placed.groupBy("b").agg(F.ceil(F.count("*") / tile).alias("tiles"))  # a row for each size class: some hundreds at most
    own = placed.join(F.broadcast(sizes), "b").withColumn("t", F.pmod(F.xxhash64("f1", "f2", "n"), "tiles")).drop("tiles")
    met = own.withColumn("bb", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1))).join(F.broadcast(sizes.toDF("bb", "tiles2")), "bb").withColumn("tt", F.explode(F.expr("sequence(0, tiles2 - 1)")))
    me, other = F.struct(F.col("b"), F.col("t")), F.struct(F.col("bb").alias("b"), F.col("tt").alias("t"))
    pairs = met.select(F.least(me, other).alias("x"), F.greatest(me, other).alias("y"), (me > other).cast("bigint").alias("second"), "f1", "f2", "n", "rep")
    keys = ["b1", "t1", "b2", "t2"]
    sent = pairs.select(F.col("x.b").alias("b1"), F.col("x.t").cast("bigint").alias("t1"), F.col("y.b").alias("b2"), F.col("y.t").cast("bigint").alias("t2"), "second", "f1", "f2", "n", "rep")

    def run(batches):
        held: list[np.ndarray] = []

        def done(rows):
            at = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            for own in np.split(rows, at):
                if len(own) > 1 and (r := _tree_of(own, radius, least)):
                    yield pa.RecordBatch.from_arrays([pa.array(r[0]), pa.array(r[1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.column_stack([c.cast(pa.int64()).to_numpy() for c in batch.columns])
            held.append(rows)
            if (rows[-1, :4] == held[0][0, :4]).all():
                continue
            rows = np.concatenate(held)
            cut = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(axis=1))[-1] + 1
            held = [rows[cut:].copy()]
            yield from done(rows[:cut])
        if held:
            yield from done(np.concatenate(held))

    return sent.repartition(*keys).sortWithinPartitions(*keys, "second", "f1", "f2", "rep").mapInArrow(run, "a bigint, b bigint")


def common_counts(x: list[np.ndarray], y: list[np.ndarray], *, most: int = 1 << 20, **options) -> np.ndarray:
    """How many hashes each set of x has in common with each of y, from about most hashes at a time. Sets are sorted."""
    out = np.zeros((len(x), len(y)), dtype=np.int64)
    parts = 1 + sum(map(len, x), sum(map(len, y))) // most
    edges = np.array([i * 2**64 // parts for i in range(1, parts)], dtype=np.uint64)
    cut_x, cut_y = ([[0, *np.searchsorted(h, edges).tolist(), len(h)] for h in s] for s in (x, y))
    for i in range(parts):
        out += _counted(*([h[c[i] : c[i + 1]] for h, c in zip(s, cut, strict=True)] for s, cut in ((x, cut_x), (y, cut_y))), **options)
    return out


def _counted(x: list[np.ndarray], y: list[np.ndarray], *, rare: int = 8, columns: int = 2048, fold: int = 1 << 20) -> np.ndarray:
    """common_counts() at once. Hashes that few sets of y hold are counted pair by pair, the others as products of 0-1 matrices, some columns at a time."""
    own, theirs = (np.repeat(np.arange(len(s)), [len(h) for h in s]) for s in (x, y))
    names, at = np.unique(np.concatenate([*y, np.zeros(0, np.uint64)]), return_inverse=True)
    order = np.argsort(at, kind="stable")
    held = theirs[order]  # the sets of y, by hash
    start = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(names)))]).astype(np.int64)
    h = np.concatenate([*x, np.zeros(0, np.uint64)])
    k = np.searchsorted(names, h)
    known = np.flatnonzero(k < len(names))
    known = known[names[k[known]] == h[known]]
    own, k = own[known], k[known]
    size = np.diff(start)
    out = np.zeros(len(x) * len(y), dtype=np.int64)
    few = np.flatnonzero(size[k] <= rare)
    for i in range(0, len(few), fold // rare):
        part = few[i : i + fold // rare]
        n = size[k[part]]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out += np.bincount(np.repeat(own[part], n) * len(y) + held[np.repeat(start[k[part]], n) + nth], minlength=len(out))
    out = out.reshape(len(x), len(y))
    many = np.flatnonzero(size[k] > rare)
    wide, column = np.unique(k[many], return_inverse=True)
    by = np.argsort(column, kind="stable")
    row, column = own[many][by], column[by]
    for i in range(0, len(wide), columns):
        some = wide[i : i + columns]
        p, q = np.searchsorted(column, [i, i + len(some)])
        left, right = np.zeros((len(x), len(some)), np.float32), np.zeros((len(y), len(some)), np.float32)
        left[row[p:q], column[p:q] - i] = 1
        for j, c in enumerate(some):
            right[held[start[c] : start[c + 1]], j] = 1
        out += (left @ right.T).astype(np.int64)
    return out


def _joined(f1, f2, n, hashes: list[np.ndarray], second: np.ndarray, twin: bool, radius: int, least: float):
    """Index pairs of similar sets that hold together whatever similar pairs within the radius do."""
    a = np.flatnonzero(~second)
    found = list(near_pairs(f1, f2, n, a, a if twin else np.flatnonzero(second), twin, radius, least))
    if not found:
        return []
    u, v, far = (np.concatenate(x) for x in zip(*found, strict=True))
    (x, row), (y, column) = np.unique(u, return_inverse=True), np.unique(v, return_inverse=True)
    common = common_counts([hashes[i] for i in x], [hashes[i] for i in y])[row, column]
    size = np.array([len(h) for h in hashes])
    alike = np.flatnonzero(common >= least * (size[u] + size[v] - common))
    kept = alike[tree(u[alike], v[alike], far[alike], len(hashes))]
    return list(zip(u[kept].tolist(), v[kept].tolist(), strict=True))


def _resolve(members: DataFrame, texts: DataFrame, *, shingle: int, radius: int, least: float, tile: int) -> DataFrame:
    """(a, b): similar pairs of reps over members (part, f1, f2, n, rep); a part of over tile members meets in pairs of tiles."""
    sizes = materialize(members.groupBy("part").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))).withColumnRenamed("part", "p")
    placed = members.join(sizes, F.col("part") == F.col("p")).withColumn("t", F.pmod(F.xxhash64("rep"), "tiles").cast("int"))
    # A text meets as many tiles as its part has: it is cut into shingles once, before.
    sets = map_texts(texts.toDF("id", "text"), ["id"], "text", lambda: lambda own: {"hashes": pa.array([shingle_hashes(x or b"", shingle).tobytes() for x in own.cast(pa.large_binary()).to_pylist()], pa.binary())}, "hashes binary")
    whole = materialize(placed.join(sets, F.col("rep") == F.col("id")).select("part", "tiles", "t", "f1", "f2", "n", "rep", "hashes"))
    keys = ["part", "t1", "t2"]
    sent = whole.withColumn("tt", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("part", F.least("t", "tt").alias("t1"), F.greatest("t", "tt").alias("t2"), (F.col("t") > F.col("tt")).alias("second"), "f1", "f2", "n", "rep", "hashes")

    def run(batches):
        def done(parts):
            table = pa.Table.from_batches(parts)
            f1, f2, n, rep = (table.column(c).to_numpy() for c in ("f1", "f2", "n", "rep"))
            twin = table.column("t1")[0].as_py() == table.column("t2")[0].as_py()
            second = np.array(table.column("second").to_pylist(), dtype=bool)
            hashes = [np.frombuffer(h, np.uint64) for h in table.column("hashes").to_pylist()]
            found = _joined(f1.view(np.uint64), f2.view(np.uint64), n, hashes, second, twin, radius, least)
            if found:
                i, j = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(rep[i]), pa.array(rep[j])], names=["a", "b"])

        held, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.column_stack([batch.column(i).cast(pa.int64()).to_numpy() for i in range(3)])
            edges = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]
            for a, b in zip(edges, edges[1:], strict=False):
                if key is not None and (k[a] != key).any():
                    yield from done(held)
                    held = []
                key = k[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from done(held)

    return sent.repartition(*keys).sortWithinPartitions(*keys, "rep").mapInArrow(run, "a bigint, b bigint")


def similar_groups(docs: DataFrame, *, id: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8, radius: int = 33, tile: int = 32_768, text_tile: int = 512) -> DataFrame:
    """doc_id and component_id, the smallest id of the documents that chains of similar texts reach, for every row with an id.

    Similar are texts whose sets of shingles have a Jaccard similarity of least
    or more; texts with equal fingerprints count as similar. radius is how many of the
    128 bits may differ: of pairs that are just similar enough it holds all but
    a few in ten thousand. Texts without words, null ones included, are one
    group. Rows that repeat an id each get a row.
    """
    own = docs.where(F.col(id).isNotNull()).select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    made = materialize(sketches(own, keep=["doc_id"], shingle=shingle))
    classes = materialize(made.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep")))
    parts = materialize(connected_components(trees(classes, least=least, radius=radius, tile=tile)))
    members = materialize(classes.join(parts.toDF("node", "part"), F.col("rep") == F.col("node")).select("part", "f1", "f2", "n", "rep"))
    texts = own.join(members.select("rep"), F.col("doc_id") == F.col("rep"), "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    found = connected_components(_resolve(members, texts, shingle=shingle, radius=radius, least=least, tile=text_tile))
    named = materialize(classes.join(found, F.col("rep") == F.col("node"), "left").select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("n").alias("m"), F.coalesce("component", "rep").alias("component_id")))
    return made.join(named, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n") == F.col("m")), "left").select("doc_id", "component_id")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, whose id is the smallest of its group; rows without id stay. Rows that repeat an id share its fate."""
    id = options.get("id", "doc_id")
    gone = similar_groups(docs, **options).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs[id] == gone["__gone"], "left_anti")
