"""SimHash near-duplicates by tiled exact comparison.

Equal fingerprints are one class. Classes are put in cells by the population
counts of the fingerprint's parts; two fingerprints within the radius have
counts that differ by the radius at most over all parts, so only tiles of such
cells meet. Within a pair of tiles every pair is compared, by exclusive or and
bit count, and the links are passed on as one star for each group found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.base import map_texts, materialize
from millrace.llm.components import connected_components, roots


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Of whole text in UTF-8: A-Z lower-cased, words between white space, a bit set where over half of the shingles' XXH64 (seed 42) have it; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    if len(words) > shingle:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = [xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    else:
        hashes = [xxh64_intdigest(b" ".join(words), 42)]
    ones = np.zeros(64, dtype=np.int64)
    h = np.array(hashes, dtype="<u8")
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, keep: list[str], text: str = "text", shingle: int = 3) -> DataFrame:
    """keep and fp, the fingerprint as a signed bigint, of every whole text; null texts have no words."""

    def run(texts: pa.Array) -> dict:
        return {"fp": pa.array(np.array([fingerprint(x, shingle) if x else 0 for x in texts.cast(pa.large_binary()).to_pylist()], dtype=np.uint64).view(np.int64))}

    return map_texts(docs, keep, text, lambda: run, "fp bigint")


def _cell(part: int = 16):
    """Population counts of the parts, as one number in base part + 1."""
    out = F.lit(0).cast("bigint")
    for k in range(64 // part):
        out = out * (part + 1) + F.bit_count(F.shiftrightunsigned("fp", k * part).bitwiseAND(F.lit((1 << part) - 1)))
    return out


def _steps(radius: int, part: int) -> list[int]:
    """Differences between the numbers of cells whose counts differ by radius at most in all."""
    vectors = [()]
    for _ in range(64 // part):
        vectors = [(*v, d) for v in vectors for d in range(-radius, radius + 1) if sum(map(abs, v)) + abs(d) <= radius]
    return sorted({sum(d * (part + 1) ** k for k, d in enumerate(v)) for v in vectors})


def links(classes: DataFrame, *, radius: int = 2, part: int = 16, tile: int = 4096, block: int = 1024) -> DataFrame:
    """(a, b): stars that connect the reps of classes (fp, rep) whose fingerprints differ in radius bits at most.

    Each class goes to the pairs of tiles that its tile is in: their number has
    the bound of the neighbouring cells' tiles, and a tile holds about tile classes however full its cell is.
    """
    placed = classes.withColumn("cell", _cell(part))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / tile).alias("tiles"))
    # A row for each cell in use: at most (part + 1) ** (64 / part), 83,521 by default.
    near = F.broadcast(sizes.select("cell", "tiles"))
    own = placed.join(near, "cell").withColumn("tile", F.pmod(F.xxhash64("fp"), "tiles"))
    met = own.drop("tiles").withColumn("cell2", F.explode(F.array(*(F.col("cell") + s for s in _steps(radius, part)))))
    met = met.join(F.broadcast(sizes.toDF("cell2", "tiles2")), "cell2").withColumn("tile2", F.explode(F.expr("sequence(0, tiles2 - 1)")))
    me, other = F.struct("cell", "tile"), F.struct(F.col("cell2").alias("cell"), F.col("tile2").alias("tile"))
    pairs = met.select(F.least(me, other).alias("x"), F.greatest(me, other).alias("y"), (me > other).alias("second"), "fp", "rep")
    pairs = pairs.select(F.col("x.cell").alias("c1"), F.col("x.tile").alias("t1"), F.col("y.cell").alias("c2"), F.col("y.tile").alias("t2"), "second", "fp", "rep")
    keys = ["c1", "t1", "c2", "t2"]

    def compare(keys_: np.ndarray, second: np.ndarray, fp: np.ndarray, rep: np.ndarray):
        """Stars of one pair of tiles."""
        twin = bool((keys_[0] == keys_[2]) and (keys_[1] == keys_[3]))
        a = np.flatnonzero(~second)
        b = a if twin else np.flatnonzero(second)
        if not len(a) or not len(b) or (twin and len(a) < 2):
            return None
        found_a, found_b = [], []
        root = np.arange(len(fp))
        for i in range(0, len(a), block):
            x = fp[a[i : i + block]]
            for j in range(i if twin else 0, len(b), block):
                hit = np.nonzero(np.bitwise_count(x[:, None] ^ fp[b[j : j + block]][None, :]) <= radius)
                if len(hit[0]):
                    found_a.append(a[i + hit[0]])
                    found_b.append(b[j + hit[1]])
            if sum(map(len, found_a)) > 1 << 22:  # fold what was found, so that dense tiles stay small
                root = roots(np.concatenate([*found_a, np.arange(len(fp))]), np.concatenate([*found_b, root]), len(fp))
                found_a, found_b = [], []
        if found_a or (root != np.arange(len(fp))).any():
            root = roots(np.concatenate([*found_a, np.arange(len(fp))]), np.concatenate([*found_b, root]), len(fp))
            tied = np.flatnonzero(root != np.arange(len(fp)))
            return rep[tied], rep[root[tied]]
        return None

    def run(batches):
        held: list[np.ndarray] = []

        def done(rows):
            out = []
            at = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            for own in np.split(rows, at):
                if len(own) > 1 and (r := compare(own[0, :4], own[:, 4] == 1, own[:, 5].view(np.uint64), own[:, 6])):
                    out.append(r)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["a", "b"])

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

    sent = pairs.select(*(F.col(k).cast("bigint").alias(k) for k in keys), F.col("second").cast("bigint").alias("second"), "fp", "rep")
    return sent.repartition(*keys).sortWithinPartitions(*keys, "second", "fp").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", radius: int = 2, shingle: int = 3) -> DataFrame:
    """doc_id, fp and component_id, the smallest id that links reach, for every row of docs.

    Texts without words, null ones included, have fingerprint 0 and link like
    any other. Rows that repeat an id each get a row. A row without id has a fingerprint, and the component of the rows that share or neighbour it
    (null if none of those has an id).
    """
    fps = materialize(fingerprints(docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), keep=["doc_id"], shingle=shingle))
    classes = materialize(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = connected_components(links(classes, radius=radius))
    named = materialize(classes.join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id")))
    return fps.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, whose id is the smallest of its component; rows without id stay. Rows that repeat an id share its fate."""
    id = options.get("id", "doc_id")
    gone = near_duplicates(docs, **options).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs[id] == gone["__gone"], "left_anti")
