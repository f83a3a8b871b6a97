"""What the operators share: tables, texts as Arrow batches, cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Texts of one slice that a Python function holds at once, in bytes.
SLICE_BYTES = 2 << 20
#: Code points of the white space that separates words, as bytes.split() has it: \x20 and \x09-\x0D.
WORD_SPACE = b" \t\n\v\f\r"

#: Most that a Python worker is handed at once, by session setting: rows, and bytes.
BATCH = (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20))

_own_dir: list[str] = []
_scratch: list[list[DataFrame]] = []  # tables written in each open scratch()


def _bytes(value: str) -> int:
    unit = value[-1:].lower() if value[-1:].isalpha() and value[-1:].lower() != "b" else value[-2:-1].lower()
    digits = "".join(c for c in value if c.isdigit() or c == "-")
    return int(digits) << {"k": 10, "m": 20, "g": 30, "t": 40}.get(unit, 0)


def small_batches(spark: SparkSession) -> None:
    """Hand rows to Python workers some megabytes at a time: Spark holds a batch twice outside its heap for each task, and its own limit is 64 MB.

    The settings are read when a plan runs, so they stay on the session; smaller ones that a user made are left as they are.
    """
    for name, most in BATCH:
        if not 0 < _bytes(spark.conf.get(name)) <= most:
            spark.conf.set(name, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is configured a local master gets a temporary one; on a cluster that is an error, since executors don't see each other's folders."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="millrace-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return f"file://{_own_dir[0]}"


def new_path(spark: SparkSession) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/millrace/{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder, to path if given, and read back, so that no later step computes it again; it goes when the application ends."""
    spark = df.sparkSession
    small_batches(spark)
    path = path or new_path(spark)
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.millrace_path = path  # for discard()
    if _scratch:
        _scratch[-1].append(out)
    return out


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside the block go at its end, but for those handed to what it yields.

    What operators return reads such tables: write or collect it inside the block.
    """
    own: list[DataFrame] = []
    kept: list[DataFrame] = []
    _scratch.append(own)
    try:
        yield lambda df: kept.append(df) or df
    finally:
        _scratch.remove(own)
        discard(*(t for t in own if all(t is not k for k in kept)))
        if _scratch:
            _scratch[-1].extend(kept)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as it takes to clash with no column of df."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def discard(*frames: DataFrame) -> None:
    """Delete written tables that nothing will read again."""
    for df in frames:
        if path := getattr(df, "millrace_path", None):
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def slices(batch: pa.RecordBatch, column: str | int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts together have about limit bytes; a longer text alone is one run."""
    n, at = batch.num_rows, 0
    if not n:
        return
    if batch.column(column).nbytes <= limit:
        yield batch
        return
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    while at < n:
        end, total = at, 0
        while end < n and (end == at or total + lengths[end] <= limit):
            total += lengths[end]
            end += 1
        yield batch.slice(at, end - at)
        at = end


def map_texts(df: DataFrame, keep: list[str], text: str, make: Callable[[], Callable[[pa.Array], dict]], schema: str) -> DataFrame:
    """Rows of keep beside what the function from make() returns for whole texts: a column for each name of schema.

    make is called once in each task. The other columns of df stay behind, whatever their names.
    """
    small_batches(df.sparkSession)
    made = StructType.fromDDL(schema).names
    names = [*keep, *made]

    def run(batches):
        fn = make()
        for batch in batches:
            for part in slices(batch, len(keep)):
                out = fn(part.column(len(keep)))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *(out[x] for x in made)], names=names)

    whole = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), schema])
    kept = df.select(*(F.col(f"`{c}`") for c in keep))
    return df.select(*kept.columns, F.col(f"`{text}`").cast("string").alias(fresh(kept, "text")[0])).mapInArrow(run, whole)


def filter_texts(df: DataFrame, text: str, make: Callable[[], Callable[[pa.Array], pa.Array]]) -> DataFrame:
    """Rows of df, with all their columns, whose text the function from make() marks true."""
    small_batches(df.sparkSession)
    at = df.columns.index(text)

    def run(batches):
        fn = make()
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(fn(part.column(at)))

    return df.mapInArrow(run, df.schema)


def flat_utf8(texts: pa.Array):
    """(bytes of all texts in one buffer, offsets) of an Arrow string array; null texts are empty."""
    import numpy as np

    texts = pa.compute.fill_null(texts.cast(pa.large_string()), "")
    if texts.offset:
        texts = pa.concat_arrays([texts])
    n = len(texts)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and n else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if n else data, (offsets - offsets[0]) if n else np.zeros(1, np.int64)
