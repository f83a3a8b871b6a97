"""A BM25 index that grows: a log of segments, deletions and replacements merged on read, compaction.

Adding documents splits and counts those documents alone. A segment keeps its postings, lengths
and document frequencies; a later segment's ids stand in place of an earlier one's.
On read, lengths say which documents are live; document frequencies are the segments' sums less
what dead documents' postings held. Only dead documents' postings are counted again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import bm25
from millrace.sources.segments import SegmentLog

MOST_SEGMENTS = 8


class Bm25Store:
    """stem as for bm25.build_index; a store is opened with the one it was filled with. buckets, by default the session's shuffle partitions, is fixed when the first segment is written."""

    def __init__(self, spark: SparkSession, path: str, stem=None, buckets: int | None = None):
        self.spark, self.log, self.stem = spark, SegmentLog(spark, path), stem
        self._buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _part(self, segment: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.log.folder(segment)}/{name}")

    def _counts(self, segment: str, notes: dict) -> DataFrame:
        """A segment's counts as a table bucketed by document, so that what meets on documents leaves them where they lie."""
        table = f"millrace_{segment}"
        if not self.spark.catalog.tableExists(table):
            where = self.log.folder(segment).replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {table} (doc_id {notes['id']}, term string, tf bigint) USING parquet CLUSTERED BY (doc_id) INTO {notes['buckets']} BUCKETS LOCATION '{where}/counts'")
        return self.spark.table(table)

    def _write(self, counts: DataFrame, notes: dict, gone: DataFrame | None = None) -> str:
        """A segment of counted() documents, which lie by document, and of ids that are gone."""
        name = self.log.new_segment()
        at = self.log.folder(name)
        counts.select("doc_id", "term", "tf").write.bucketBy(notes["buckets"], "doc_id").options(path=f"{at}/counts", compression="zstd").saveAsTable(f"millrace_{name}")
        counts = self._counts(name, notes)
        docs = bm25.lengths(counts)
        if gone is not None:  # without a length
            docs = docs.unionByName(gone.select("doc_id", F.lit(None).cast("bigint").alias("dl")))
        docs.write.parquet(f"{at}/docs")
        bm25.frequencies(counts).write.parquet(f"{at}/terms")
        return name

    def _commit(self, version: int, segments: list[str], notes: dict) -> int:
        if len(segments) > MOST_SEGMENTS:
            segments = [self._write(self._live(segments, notes)[0], notes)]
        return self.log.commit(version, segments, **notes)

    def add(self, documents: DataFrame, *, id: str, text: str) -> int:
        """Documents in place of those of their ids; the new version. Rows that repeat an id are one document, as in bm25.build_index; null ids are left out."""
        version, segments, notes = self.log.read()
        notes = notes or {"id": documents.schema[id].dataType.simpleString(), "buckets": self._buckets}
        # Texts go to their buckets whole; counted there, they need no exchange of words.
        own = documents.where(F.col(id).isNotNull()).select(F.col(id).cast(notes["id"]).alias("doc_id"), F.col(text).alias("text")).repartition(notes["buckets"], "doc_id")
        return self._commit(version, [*segments, self._write(bm25.counted(own, id="doc_id", text="text", stem=self.stem), notes)], notes)

    def delete(self, ids: DataFrame, id: str = "doc_id") -> int:
        """The new version, without these documents; unknown ids change nothing."""
        version, segments, notes = self.log.read()
        if not segments:
            return version
        none = self._counts(segments[0], notes).where("false")
        gone = ids.select(F.col(id).cast(notes["id"]).alias("doc_id")).where("doc_id is not null").distinct()
        return self._commit(version, [*segments, self._write(none, notes, gone)], notes)

    def compact(self) -> int:
        """One segment of what is live; earlier versions can be read on."""
        version, segments, notes = self.log.read()
        if len(segments) < 2:
            return version
        return self.log.commit(version, [self._write(self._live(segments, notes)[0], notes)], **notes)

    def _live(self, segments: list[str], notes: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(counts, docs, frequencies) of the live documents."""
        docs = [self._part(s, "docs") for s in segments]
        counts, lengths, held = [], [], []
        for i, s in enumerate(segments):
            own = docs[i].where("dl is not null")
            count = self._counts(s, notes)
            terms = self._part(s, "terms")
            if later := [d.select("doc_id") for d in docs[i + 1 :]]:
                newer = reduce(DataFrame.unionByName, later).distinct()
                dead = own.join(newer, "doc_id", "left_semi").select("doc_id")
                own = own.join(newer, "doc_id", "left_anti")
                lost = count.where("term is not null").join(dead, "doc_id", "left_semi").groupBy("term").agg((-F.count("*")).alias("df"))
                terms = terms.unionByName(lost)
                count = count.join(dead, "doc_id", "left_anti")
            counts.append(count)
            lengths.append(own)
            held.append(terms)
        merged = [reduce(DataFrame.unionByName, x) for x in (counts, lengths, held)]
        return merged[0], merged[1], merged[2].groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def index(self, version: int | None = None) -> bm25.Bm25Index:
        """The index as of a version, by default the last: what bm25.build_index makes of its live documents."""
        version, segments, notes = self.log.read(version)
        if not segments:
            raise ValueError("nothing was added yet")
        counts, docs, df = self._live(segments, notes)
        return bm25.Bm25Index(counts.where("term is not null"), docs, *bm25.weighed(df, docs), self.stem)

    def vacuum(self, keep: int = 1) -> None:
        """Forget all versions but the last keep."""
        for s in self.log.vacuum(keep):
            self.spark.sql(f"DROP TABLE IF EXISTS millrace_{s}")
