"""A versioned store of vectors: a log of bucketed segments, merged on read.

An upsert or a deletion writes a segment of its own rows and nothing else. A
read takes each segment's rows whose key no later segment has. Segments are
bucketed by key, so what meets on the key is not shuffled; keys alone are
compared, vectors stay where they lie. Compaction writes one segment anew.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.segments import SegmentLog

COLUMNS = "listing_id string, model_id string, vector array<float>"
#: Segments that an upsert leaves at most; beyond, it compacts.
MOST_SEGMENTS = 8


class VectorStore:
    """listing_id, model_id, vector by listing_id. buckets is fixed when the first segment is written.

    A session knows its segments as external tables `millrace_` and the segment's name; vacuum drops them, a catalogue
    that outlives the session keeps the rest.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 8):
        self.spark, self.log, self._buckets = spark, SegmentLog(spark, path), buckets

    def _segment(self, name: str, buckets: int) -> DataFrame:
        """A segment as a bucketed table of this session's catalogue."""
        table = f"millrace_{name}"
        if not self.spark.catalog.tableExists(table):
            where = self.log.folder(name).replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {table} ({COLUMNS}, gone boolean) USING parquet CLUSTERED BY (listing_id) SORTED BY (listing_id) INTO {buckets} BUCKETS LOCATION '{where}'")
        return self.spark.table(table)

    def _write(self, rows: DataFrame, buckets: int) -> str:
        """rows, one a key, as a new segment: a file a bucket."""
        name = self.log.new_segment()
        own = rows.select("listing_id", "model_id", F.col("vector").cast("array<float>").alias("vector"), "gone")
        own.repartition(buckets, "listing_id").sortWithinPartitions("listing_id").write.bucketBy(buckets, "listing_id").sortBy("listing_id").option("path", self.log.folder(name)).saveAsTable(f"millrace_{name}")
        return name

    def _append(self, rows: DataFrame) -> int:
        version, segments, notes = self.log.read()
        buckets = notes.get("buckets", self._buckets)
        segments = [*segments, self._write(rows, buckets)]
        if len(segments) > MOST_SEGMENTS:
            segments = [self._write(self._merged(segments, buckets).where("not gone"), buckets)]
        return self.log.commit(version, segments, buckets=buckets)

    def upsert(self, rows: DataFrame) -> int:
        """Rows in place of those of their ids; the new version. Null ids are left out; of rows that repeat an id the one with the greatest model, then vector, stands."""
        own = rows.where("listing_id is not null").groupBy(F.col("listing_id").cast("string").alias("listing_id")).agg(F.max(F.struct("model_id", F.col("vector").cast("array<float>").alias("vector"))).alias("r"))
        return self._append(own.select("listing_id", "r.*", F.lit(False).alias("gone")))

    def delete(self, ids: DataFrame) -> int:
        """The new version, without these ids; unknown ones change nothing."""
        none = (F.lit(None).cast("string").alias("model_id"), F.lit(None).cast("array<float>").alias("vector"))
        return self._append(ids.where("listing_id is not null").select(F.col("listing_id").cast("string").alias("listing_id")).distinct().select("listing_id", *none, F.lit(True).alias("gone")))

    def compact(self) -> int:
        """One segment of what is live; earlier versions can be read on."""
        version, segments, notes = self.log.read()
        if len(segments) < 2:
            return version
        buckets = notes["buckets"]
        return self.log.commit(version, [self._write(self._merged(segments, buckets).where("not gone"), buckets)], buckets=buckets)

    def _merged(self, segments: list[str], buckets: int) -> DataFrame:
        """The last row of each key, deletions among them."""
        own = [self._segment(s, buckets) for s in segments]
        live = []
        for i, rows in enumerate(own):
            for later in own[i + 1 :]:
                rows = rows.join(later.select("listing_id"), "listing_id", "left_anti")
            live.append(rows)
        return reduce(DataFrame.unionByName, live)

    def read(self, version: int | None = None) -> DataFrame:
        """The store as of a version, by default the last."""
        _, segments, notes = self.log.read(version)
        if not segments:
            return self.spark.createDataFrame([], COLUMNS)
        return self._merged(segments, notes["buckets"]).where("not gone").drop("gone")

    def fetch(self, ids: DataFrame, model: str | None = None, version: int | None = None) -> DataFrame:
        own = self.read(version)
        own = own if model is None else own.where(F.col("model_id") == model)
        return own.join(ids.select("listing_id"), "listing_id", "left_semi")

    def count(self, model: str | None = None, version: int | None = None) -> DataFrame:
        own = self.read(version)
        return (own if model is None else own.where(F.col("model_id") == model)).agg(F.count("*").alias("n"))

    def backlog(self, listings: DataFrame, model: str) -> DataFrame:
        """Listings without a vector of the model."""
        return listings.join(self.read().where(F.col("model_id") == model).select("listing_id"), "listing_id", "left_anti")

    def vacuum(self, keep: int = 1) -> None:
        """Forget all versions but the last keep, and the segments that only those name."""
        for s in self.log.vacuum(keep):
            self.spark.sql(f"DROP TABLE IF EXISTS millrace_{s}")
