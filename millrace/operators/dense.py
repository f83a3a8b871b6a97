"""Dense retrieval by blocks: batches of vectors against a matrix of queries.

The queries of a batch, MOST_QUERIES and MOST_BYTES of them at most, are one
matrix that tasks share; more queries are dealt out by a hash and
go in as many passes. A task holds one Arrow batch of vectors and what is best
so far, k rows a query, and hands on no more than those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Of queries that are sent to tasks at once.
MOST_QUERIES, MOST_BYTES = 4096, 32 << 20
#: Scores that a task computes at once.
PAIRS = 1 << 20


def by_size(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{size: (row numbers, matrix of doubles)} of the rows that are vectors: not null, not empty, no null component."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    good = size > 0
    if flat.null_count:
        good[np.repeat(np.arange(len(size)), size)[flat.is_null().to_numpy(zero_copy_only=False)]] = False
    values = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False)
    starts = np.cumsum(size) - size
    out = {}
    for n in np.unique(size[good]).tolist():
        rows = np.flatnonzero(good & (size == n))
        whole = len(rows) == len(size)
        out[n] = (rows, (values.reshape(-1, n) if whole else values[starts[rows][:, None] + np.arange(n)]).astype(np.float64))
    return out


def _block(table: pa.Table) -> tuple[list, dict]:
    """(ids, {size: (places among ids, matrix)}) of queries (query_id, query_vector), plain values that any worker can read."""
    return table.column(0).to_pylist(), by_size(pa.concat_arrays(table.column(1).chunks) if table.num_rows else pa.array([], table.schema.field(1).type))


def in_blocks(queries: DataFrame, each: Callable[[object], DataFrame]) -> DataFrame:
    """What `each` makes of the queries' matrix, handed over as a broadcast variable.

    The queries are looked at while the plan is built. If they exceed the bounds, they are dealt out by
    a hash of their ids and each part's result is written before the next part is sent.
    """
    from millrace.sources.stores import new_folder

    spark = queries.sparkSession
    own = queries.select("query_id", "query_vector")
    few = own.limit(MOST_QUERIES + 1).toArrow()
    if few.num_rows <= MOST_QUERIES and few.nbytes <= MOST_BYTES:
        return each(spark.sparkContext.broadcast(_block(few)))
    n, size = own.agg(F.count("*"), F.sum(F.size("query_vector").cast("bigint") * 8)).first()
    parts = int(-(-2 * max(n, 1) // MOST_QUERIES) + 2 * (size or 0) // MOST_BYTES)
    path = new_folder(spark)
    for i in range(parts):
        held = spark.sparkContext.broadcast(_block(own.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i).toArrow()))
        each(held).write.mode("append").parquet(path)
        held.destroy()
    return spark.read.parquet(path)


def _array(column: pa.Array) -> np.ndarray:
    """Ids as numbers, or as text that compares by code points."""
    return np.array(column.to_pylist(), dtype=str) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.to_numpy(zero_copy_only=False)


def _steps(matrix: np.ndarray, rows: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    step = max(1, PAIRS // max(1, width))
    for i in range(0, len(rows), step):
        yield rows[i : i + step], matrix[i : i + step]


def rounded(scores: np.ndarray) -> np.ndarray:
    """To nine decimals: what ranks go by, so that ids break ties of equal vectors."""
    return np.floor(scores * 1e9 + 0.5) / 1e9


def _best(held, k: int, query_type: pa.DataType, id_type: pa.DataType):
    """(id, vector) to (query_id, id, cosine, key): the task's k best of each query."""

    def run(batches):
        names, blocks = held.value
        least = np.full(len(names), -np.inf)
        pool: list[tuple[np.ndarray, ...]] = []  # query, id, cosine, key
        size = 0

        def cut():
            nonlocal pool, size
            q, ids, score, key = (np.concatenate(x) for x in zip(*pool, strict=True))
            order = np.lexsort((ids, -key, q))
            first = np.searchsorted(q[order], np.arange(len(names)))
            place = np.arange(len(order)) - first[q[order]]
            kept = order[place < k]
            full = order[place == k - 1]
            least[q[full]] = key[full]
            pool, size = [tuple(x[kept] for x in (q, ids, score, key))], len(kept)

        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(0)))
            ids = _array(batch.column(0))
            for n, (rows, matrix) in by_size(batch.column(1)).items():
                if n not in blocks:
                    continue
                at, asked = blocks[n]
                for some, part in _steps(matrix, rows, len(at)):
                    score = part @ asked.T
                    key = rounded(score)
                    r, c = np.nonzero(key >= least[at][None, :])
                    pool.append((at[c], ids[some[r]], score[r, c], key[r, c]))
                    size += len(r)
                    if size > max(PAIRS, 4 * k * len(names)):
                        cut()
        if size:
            cut()
            q, ids, score, key = pool[0]
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in q.tolist()], query_type), pa.array(ids.tolist(), id_type), pa.array(score), pa.array(key)], names=["query_id", "id", "cosine", "key"])

    return run


def _types(*pairs: tuple[DataFrame, str]) -> list:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(df.schema[c].dataType) for df, c in pairs]


def top_k(vectors: DataFrame, queries: DataFrame, k: int, *, id: str = "listing_id", vector: str = "vector") -> DataFrame:
    """(query_id, id, cosine, rank): the k rows of each query whose unit vectors are nearest to its own, ids breaking ties at nine decimals.

    queries: query_id, query_vector. Vectors meet queries of their own size. Rows without an id, null
    and empty vectors, and such with a null or NaN component are left out. Rows that repeat an id each count.
    Tasks hand on k rows a query at most; a second top-k of those is the result.
    """
    query_type, id_type = _types((queries, "query_id"), (vectors, id))
    own = vectors.select(F.col(id).alias("id"), F.col(vector).alias("v"))
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {vectors.schema[id].dataType.simpleString()}, cosine double, key double"
    w = Window.partitionBy("query_id").orderBy(F.desc("key"), "id")

    def ranked(held) -> DataFrame:
        found = own.mapInArrow(_best(held, k, query_type, id_type), schema)
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("id").alias(id), "cosine", "rank")

    return in_blocks(queries, ranked)  # of a part no more is written than its result


def _pooled(held, query_type: pa.DataType, key_type: pa.DataType, path_type: pa.DataType):
    """(key, path, vector) to (query_id, key, score, rounded, path): the task's best path of each query and key."""

    def run(batches):
        names, blocks = held.value
        best: dict = {}  # of a key: (rounded, score, path), an entry for each query

        def rows():
            keys = list(best)
            shown, score, path = (np.stack([best[x][i] for x in keys]) for i in range(3))
            r, c = np.nonzero(shown > -np.inf)
            return pa.RecordBatch.from_arrays([pa.array([names[i] for i in c.tolist()], query_type), pa.array([keys[i] for i in r.tolist()], key_type), pa.array(score[r, c]), pa.array(shown[r, c]), pa.array(path[r, c].tolist(), path_type)], names=["query_id", "key", "score", "rounded", "path"])

        for batch in batches:
            batch = batch.filter(pc.and_(pc.is_valid(batch.column(0)), pc.is_valid(batch.column(1))))
            keys, paths = np.array(batch.column(0).to_pylist(), dtype=object), _array(batch.column(1)).astype(object)
            order = np.argsort(paths, kind="stable")  # the first of equals is the least path
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            for n, (rows_, matrix) in by_size(batch.column(2)).items():
                if n not in blocks:
                    continue
                at, asked = blocks[n]
                sort = np.argsort(rank[rows_], kind="stable")
                for some, part in _steps(matrix[sort], rows_[sort], len(at)):
                    score = part @ asked.T
                    shown = np.where(np.isnan(score), -np.inf, rounded(score))
                    for key in dict.fromkeys(keys[some].tolist()):
                        own = np.flatnonzero(keys[some] == key)
                        top = own[shown[own].argmax(axis=0)]
                        c = np.arange(len(at))
                        if key not in best:
                            best[key] = (np.full(len(names), -np.inf), np.zeros(len(names)), np.full(len(names), None, dtype=object))
                        had = best[key]
                        path = paths[some[top]]
                        same = np.array([a is not None and b < a for a, b in zip(had[2][at].tolist(), path.tolist(), strict=True)], dtype=bool)
                        won = (shown[top, c] > had[0][at]) | ((shown[top, c] == had[0][at]) & same)
                        had[0][at[won]], had[1][at[won]], had[2][at[won]] = shown[top, c][won], score[top, c][won], path[won]
                    if len(best) * len(names) > PAIRS:
                        yield rows()
                        best.clear()
        if best:
            yield rows()

    return run


def max_pool(vectors: DataFrame, queries: DataFrame, *, key: str, path: str, vector: str = "vector") -> DataFrame:
    """(query_id, key, score, path): of each key the vector nearest to each query, the least path of equals at nine decimals.

    Each task finds its best of each query and key before they meet. Rows without key or path, and what top_k leaves out, are left out.
    """
    query_type, key_type, path_type = _types((queries, "query_id"), (vectors, key), (vectors, path))
    own = vectors.select(F.col(key).alias("key"), F.col(path).alias("path"), F.col(vector).alias("v"))
    said = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"query_id {said(queries, 'query_id')}, key {said(vectors, key)}, score double, rounded double, path {said(vectors, path)}"
    found = in_blocks(queries, lambda held: own.mapInArrow(_pooled(held, query_type, key_type, path_type), schema))
    best = F.min(F.struct((-F.col("rounded")).alias("r"), "path", "score")).alias("b")
    return found.groupBy("query_id", "key").agg(best).select("query_id", F.col("key").alias(key), F.col("b.score").alias("score"), F.col("b.path").alias(path))


def _of_pairs(held):
    """(query_id, id, vector) to (query_id, id, cosine)."""

    def run(batches):
        names, blocks = held.value
        place = {q: i for i, q in enumerate(names)}
        for batch in batches:
            asked = np.array([place.get(q, -1) for q in batch.column(0).to_pylist()], dtype=np.int64)
            rows, scores = [np.zeros(0, np.int64)], [np.zeros(0)]
            for n, (some, matrix) in by_size(batch.column(2)).items():
                if n in blocks:
                    at, queries = blocks[n]
                    row_of = np.full(len(names) + 1, -1)
                    row_of[at] = np.arange(len(at))
                    to = row_of[asked[some]]
                    rows.append(some[to >= 0])
                    scores.append(np.einsum("ij,ij->i", matrix[to >= 0], queries[to[to >= 0]]))
            found = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(found), batch.column(1).take(found), pa.array(np.concatenate(scores))], names=["query_id", "id", "cosine"])

    return run


def of_candidates(vectors: DataFrame, queries: DataFrame, candidates: DataFrame, *, id: str = "listing_id", vector: str = "vector") -> DataFrame:
    """(query_id, id, cosine) of the pairs that candidates (query_id, id) name, and of no others."""
    pairs = candidates.select("query_id", id).join(vectors.select(id, F.col(vector).alias("v")), id).select("query_id", F.col(id).alias("id"), "v")
    schema = f"query_id {candidates.schema['query_id'].dataType.simpleString()}, id {vectors.schema[id].dataType.simpleString()}, cosine double"
    return in_blocks(queries, lambda held: pairs.mapInArrow(_of_pairs(held), schema)).withColumnRenamed("id", id)
