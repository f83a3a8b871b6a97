"""CSV with line breaks inside quoted fields, read by ranges of bytes rather than by files.

Whether a line begins a record depends on the quotes of all lines before it. Each range's
count of quotes, odd or even, is found first; a running sum over a file's ranges says
how each begins. Then each range is cut into records on its own, and records that go
over an edge are put together from their ends. A large file is read by as many tasks as it has ranges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PIECE = "file string, began bigint, at bigint, text string, header boolean"


def _cut(batches):
    """Lines (file, block, inside, line) in order to pieces of records: (file, began, at, text, header).

    began is the block where the record began, -1 if in an earlier one; a piece whose record ends elsewhere is open to the right, one
    that begins elsewhere to the left. What is whole has at = -1.
    """
    now, held, odd, begun, first = None, [], False, False, False
    out: list[tuple] = []

    def flush(closed: bool):
        if held or begun:
            file, block = now
            whole = begun and closed
            out.append((file, block if begun else -1, -1 if whole else block, "\n".join(held), first and begun))

    def table():
        cols = list(zip(*out, strict=True)) if out else [[], [], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)], names=["file", "began", "at", "text", "header"])

    for batch in batches:
        files, blocks, inside = (batch.column(i).to_pylist() for i in range(3))
        lines = batch.column(3)
        quotes = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False).astype(np.int64) & 1
        for file, block, begins_inside, line, q in zip(files, blocks, inside, lines.to_pylist(), quotes.tolist(), strict=True):
            if (file, block) != now:
                if now is not None:
                    flush(not odd)
                now, held, odd = (file, block), [], begins_inside
                begun, first = False, block == 0
            if not odd:  # a record begins here
                if held or begun:
                    flush(True)
                    first = first and not begun
                held, begun = [], True
            held.append(line)
            odd ^= bool(q)
        if out:
            yield table()
            out.clear()
    if now is not None:
        flush(not odd)
    if out:
        yield table()


def read_csv_ranges(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """All strings, as sources.listings.read_csv reads them: a header in each file, fields in quotes hold line breaks and doubled quotes.

    Tasks follow spark.sql.files.maxPartitionBytes, not files. A row's columns stand in the schema's order. Texts are read twice, the first time to count quotes.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    odd = lines.groupBy("file", "block").agg((F.sum(F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    begins = odd.select("file", "block", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    # Lines keep their order: each task looks up how its ranges begin.
    known = {(r.file, r.block): r.inside for r in begins.where("inside").toLocalIterator()}
    held = spark.sparkContext.broadcast(known)  # ranges that begin inside quotes: a few bytes for each 128 MB

    def placed(batches):
        def told():
            for b in batches:
                at = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([held.value.get(x, False) for x in at], pa.bool_()), b.column(2)], names=["file", "block", "inside", "line"])

        yield from _cut(told())

    pieces = lines.mapInArrow(placed, _PIECE)
    whole = pieces.where("at = -1").select("text", "header")
    # Ends of records that go over an edge: those of one record lie in ranges that follow each other.
    ends = pieces.where("at <> -1")
    by = Window.partitionBy("file").orderBy("at", F.col("began") != -1)
    joined = ends.withColumn("record", F.sum((F.col("began") != -1).cast("int")).over(by)).groupBy("file", "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n").alias("text"), F.max("header").alias("header"))
    text = whole.unionByName(joined.select("text", "header")).where("not header").select(F.regexp_replace("text", "\r$", "").alias("text")).where("text <> ''")
    row = F.from_csv("text", schema.simpleString()[7:-1].replace(":", " "), {"quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"})
    return text.select(row.alias("r")).select("r.*")
