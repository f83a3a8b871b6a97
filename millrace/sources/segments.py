"""Tables of immutable segments: a log of versions, each naming the segments that make it up.

A folder holds `_log`, a small JSON file a version, and a folder for each
segment. A version's file is created once and never overwritten, so of two
writers that start from one version the later fails and its segments are
never read. Readers of a version are not touched by later ones.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class SegmentLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def versions(self) -> list[int]:
        """Numbers of all versions, oldest first."""
        fs, where = self._fs(f"{self.path}/_log")
        if not fs.exists(where):
            return []
        return sorted(int(f.getPath().getName().split(".")[0]) for f in fs.listStatus(where) if f.getPath().getName().endswith(".json"))

    def read(self, version: int | None = None) -> tuple[int, list[str], dict]:
        """(version, its segments from the oldest on, notes) of a version, by default the last; version 0 is empty."""
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        if version == 0:
            return 0, [], {}
        if version not in known:
            raise ValueError(f"there is no version {version}; there are {known}")
        fs, where = self._fs(f"{self.path}/_log/{version:012d}.json")
        stream = fs.open(where)
        try:
            told = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return version, told["segments"], told["notes"]

    def new_segment(self) -> str:
        """A name for a segment; its folder is self.folder(name)."""
        return uuid.uuid4().hex

    def folder(self, segment: str) -> str:
        return f"{self.path}/segment-{segment}"

    def commit(self, after: int, segments: list[str], **notes) -> int:
        """Version after + 1 made up of segments; an error if another writer has made it."""
        fs, where = self._fs(f"{self.path}/_log/{after + 1:012d}.json")
        if after and after not in self.versions():
            raise ValueError(f"there is no version {after}")
        try:
            stream = fs.create(where, False)
        except Exception as taken:
            raise RuntimeError(f"version {after + 1} is taken: read again and retry") from taken
        stream.write(bytearray(json.dumps({"segments": segments, "notes": notes}).encode()))
        stream.close()
        return after + 1

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete what only versions before the last keep name; their numbers go too."""
        known = self.versions()
        old, held = known[:-keep], {s for v in known[-keep:] for s in self.read(v)[1]}
        gone = sorted({s for v in old for s in self.read(v)[1]} - held)
        for v in old:
            fs, where = self._fs(f"{self.path}/_log/{v:012d}.json")
            fs.delete(where, False)
        for s in gone:
            fs, where = self._fs(self.folder(s))
            fs.delete(where, True)
        return gone
