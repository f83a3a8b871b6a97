"""Bounded-space online packing of tokenised texts into sequences of one length.

Each partition keeps a fixed number of open windows. A piece goes to the open
window that it fills best. When none has room, the fullest is filled up with
the piece's first ids and emitted, and the rest of the piece is placed anew.
The windows left open at the ends of partitions are merged group by group.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.base import materialize, slices
from millrace.llm.byte_bpe import ByteBpe

#: Where sequence ids of merged leftovers begin.
MERGED = 1 << 62


class Packer:
    """rows: pieces of emitted windows, (doc_id, start, length, crc, doc_tokens, sequence, offset)."""

    def __init__(self, size: int, windows: int, first: int = 0):
        self.size, self.windows, self.next = size, windows, first
        self.open: list[list] = []  # [ids held, [(doc_id, start, ids, doc_tokens), ...]]
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray, start: int = 0, doc_tokens: int | None = None) -> None:
        total = len(ids) if doc_tokens is None else doc_tokens
        at, end = 0, len(ids)
        while end - at >= self.size:
            self._emit([self.size, [(doc_id, start + at, ids[at : at + self.size], total)]])
            at += self.size
        while at < end:
            best = min((w for w in self.open if self.size - w[0] >= end - at), key=lambda w: -w[0], default=None)
            if best is None and len(self.open) < self.windows:
                self.open.append(best := [0, []])
            if best is None:
                best = max(self.open, key=lambda w: w[0])
            n = min(end - at, self.size - best[0])
            best[1].append((doc_id, start + at, ids[at : at + n], total))
            best[0] += n
            at += n
            if best[0] == self.size:
                self.open.remove(best)
                self._emit(best)

    def _emit(self, window: list) -> None:
        at = 0
        for doc_id, start, ids, total in window[1]:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, at))
            at += len(ids)
        self.next += 1

    def flush(self) -> None:
        """Emit what is open, one after another in sequences of full length, and the rest in lengths that are powers of two and need no padding."""
        left = [p for w in self.open for p in w[1]]
        room = sum(len(p[2]) for p in left)
        self.open = []
        window: list = [0, []]
        size = self.size
        for doc_id, start, ids, total in left:
            at = 0
            while at < len(ids):
                if not window[0]:
                    size = self.size if room >= self.size else 1 << (room.bit_length() - 1)
                n = min(len(ids) - at, size - window[0])
                window[1].append((doc_id, start + at, ids[at : at + n], total))
                window[0] += n
                at += n
                room -= n
                if window[0] == size:
                    self._emit(window)
                    window = [0, []]


_PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_NAMES = ["doc_id", *(x.split()[0] for x in _PIECES.split(", "))]


def _batch(rows: list[tuple], kind: pa.DataType) -> list[pa.Array]:
    columns = list(zip(*rows, strict=True)) or [()] * 7
    return [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])]


def pack(docs: DataFrame, tokenizer: str, *, id: str = "doc_id", text: str = "text", size: int = 1024, windows: int = 16, end_id: int = 0, group: int = 16) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    A document is its ids, then end_id; null and empty texts are end_id alone.
    Every id lies in one piece. Sequences are full but for those that merge
    the leftovers of group partitions, whose last ones have lengths that are
    powers of two. Repeated rows are packed one by one.
    """
    kind = docs.schema[id].dataType

    def run(batches):
        from pyspark import TaskContext

        bpe, part = ByteBpe(tokenizer), TaskContext.get().partitionId()
        packer, names, ids_kind = Packer(size, windows, part << 32), [*_NAMES, "part", "ids"], None
        for batch in batches:
            ids_kind = batch.schema.field(0).type
            for rows in slices(batch, 1):
                for doc_id, content in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                    packer.add(doc_id, np.append(bpe.ids(content or ""), np.uint32(end_id)))
                made, packer.rows = packer.rows, []
                yield pa.RecordBatch.from_arrays([*_batch(made, ids_kind), pa.nulls(len(made), pa.int64()), pa.nulls(len(made), pa.binary())], names=names)
        left = [(d, s, len(i), None, t, w, k, i.astype("<u4").tobytes()) for w, x in enumerate(packer.open) for k, (d, s, i, t) in enumerate(x[1])]
        if left:
            yield pa.RecordBatch.from_arrays([*_batch([x[:7] for x in left], ids_kind), pa.array([part] * len(left), pa.int64()), pa.array([x[7] for x in left], pa.binary())], names=names)

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        packer = Packer(size, 1 << 30, MERGED + ((table.column("part")[0].as_py() // group) << 32))
        packer.open = [[0, [(r["doc_id"], r["start"], np.frombuffer(r["ids"], dtype="<u4"), r["doc_tokens"])]] for r in table.to_pylist()]
        packer.flush()
        return pa.Table.from_arrays(_batch(packer.rows, table.schema.field("doc_id").type), names=_NAMES)

    schema = f"doc_id {kind.simpleString()}, {_PIECES}"
    # Written once: both the emitted windows and the leftovers are read from it. Leftovers, windows of them a partition at most, carry their ids.
    made = materialize(docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"{schema}, part bigint, ids binary"))
    merged = made.where("part is not null").groupBy(F.expr(f"part div {group}")).applyInArrow(merge, schema)
    return made.where("part is null").select(*_NAMES).unionByName(merged)
