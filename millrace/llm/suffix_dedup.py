"""Repeated passages by sparse suffix arrays.

Of all suffixes of a text, at word positions, those are kept whose first words
have the least hash among their neighbours: two texts that share
a passage keep the same positions in it. Each stretch of the least number of
words belongs to one kept suffix in it, chosen by its words alone. Kept suffixes
that begin alike in several texts meet with all stretches around them, and
those of equal 64-bit hashes are the same: no text is compared. A text's
stretches that others hold are joined to passages.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.base import discard, fresh, materialize, slices

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Kept suffixes with one key that a Python worker holds at once, about; keys with more are hot, and no task holds all of one.
BUCKET = 20_000


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def word_hashes(text: bytes) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(w) for w in text.split()], dtype=np.uint64)


def _runs(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of so many words."""
    power, factor, whole, done = words, _MIX, None, 0
    size = 1
    while size <= length:
        if length & size:
            n = len(words) - (done + size) + 1
            whole = power[:n] if whole is None else whole[:n] * factor + power[done : done + n]
            done += size
        if 2 * size <= length:
            power = power[: len(power) - size] * factor + power[size:]
            factor = factor * factor
        size *= 2
    return _mixed(whole)


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) of each stretch of so many neighbours."""
    size, out = 1, x
    while 2 * size <= width:
        out = best(out[:-size], out[size:])
        size *= 2
    return best(out[: len(x) - width + 1], out[len(out) - (len(x) - width + 1) :]) if size < width else out


def minimisers(words: np.ndarray, key: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, keys): runs of key words with the least hash in some stretch of least words."""
    with np.errstate(over="ignore"):
        runs = _runs(words, key)
    width = least - key + 1
    low = _slide(runs, width, np.minimum)
    top = np.zeros(width - 1, dtype=np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([top, low, top]), width, np.maximum) == runs)
    return at, runs[at]


def suffixes(docs: DataFrame, *, key: int, least: int) -> DataFrame:
    """doc_id, pos (in words) and key, the hash of the first key words: the kept suffixes of every whole text."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                out = []
                for doc_id, content in zip(part.column(0).to_pylist(), part.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                    words = word_hashes(content)
                    if len(words) >= least:
                        at, keys = minimisers(words, key, least)
                        out.append((np.full(len(at), doc_id), at, keys))
                if out:
                    d, at, keys = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(at.astype(np.int32)), pa.array(keys.view(np.int64))], names=["doc_id", "pos", "key"])

    return docs.where("doc_id is not null and text is not null").mapInArrow(run, "doc_id bigint, pos int, key bigint")


def _edges(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of all words, in characters."""
    x = np.frombuffer(text, dtype=np.uint8)
    gap = (x == 0x20) | ((x >= 0x09) & (x <= 0x0D))
    step = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    char = np.concatenate([[0], np.cumsum((x & 0xC0) != 0x80)])
    return char[np.flatnonzero(step == -1)], char[np.flatnonzero(step == 1)]


def _stretches(words: np.ndarray, key: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(positions, keys) of the minimisers; hashes of all stretches of least words and the number of the minimiser that each belongs to: of those with the least hash in it the first."""
    at, keys = minimisers(words, key, least)
    with np.errstate(over="ignore"):
        low = _slide(_runs(words, key), least - key + 1, np.minimum)
        whole = _runs(words, least)
    own = np.searchsorted(at, np.arange(len(low)))
    while len(off := np.flatnonzero(keys[own] != low)):
        own[off] += 1
    return at, keys, whole, own


def _packed(x: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary for each row: so many of x's items."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * x.itemsize * (x.shape[1] if x.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def _unpacked(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """(items of all rows, bytes by row)."""
    column = column.cast(pa.large_binary())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]].view(dtype), np.diff(offsets)


def _chosen(content: bytes, pos: np.ndarray, keys: np.ndarray, hot: np.ndarray, *, key: int, least: int):
    """Of one text, the stretches that belong to the kept suffixes at pos with keys: (their numbers, their suffixes' numbers, keys of all its suffixes and which are hot, hashes of all its stretches, starts and ends of its words); None without any."""
    words = word_hashes(content)
    if len(words) < least:
        return None
    at, own_keys, whole, own = _stretches(words, key, least)
    there = np.minimum(np.searchsorted(at, pos), len(at) - 1)
    # Rows that repeat an id are handed the suffixes of all its texts.
    here = (at[there] == pos) & (own_keys[there].view(np.int64) == keys)
    asked, is_hot = np.zeros(len(at), dtype=bool), np.zeros(len(at), dtype=bool)
    asked[there[here]], is_hot[there[here]] = True, hot[here]
    win = np.flatnonzero(asked[own])
    return (win, own[win], own_keys, is_hot, whole, *_edges(content)) if len(win) else None


def _with_stretches(placed: DataFrame, *, key: int, least: int) -> DataFrame:
    """A row for each kept suffix: its stretches' hashes, steps from the first one, and edges from the first one's start.

    placed has doc_id, text, digest, and arrays pos, keys and hot of the kept suffixes that matter.
    """
    small = np.uint8 if least - key < 256 else np.uint32
    names = ["key", "hot", "doc_id", "digest", "first", "base", "width", "whole", "steps", "edges"]

    def run(batches):
        for batch in batches:
            for cut in slices(batch, 1):
                out = {2: [], 4: []}  # by bytes of an edge
                for doc_id, content, digest, *asked in zip(cut.column(0).to_pylist(), cut.column(1).cast(pa.large_binary()).to_pylist(), cut.column(2).to_pylist(), cut.column(3), cut.column(4), cut.column(5), strict=True):
                    got = _chosen(content, *(x.values.to_numpy(zero_copy_only=False) for x in asked), key=key, least=least)
                    if got is None:
                        continue
                    win, of, keys, hot, whole, starts, ends = got
                    lead = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                    sizes = np.diff(np.append(lead, len(win)))
                    first, base = win[lead], starts[win[lead]]
                    edges = np.stack([starts[win], ends[win + least - 1]], 1) - np.repeat(base, sizes)[:, None]
                    width, n = 2 if edges.max() < 1 << 16 else 4, len(lead)
                    out[width].append((keys[of[lead]].view(np.int64), hot[of[lead]], np.full(n, doc_id), np.full(n, digest), first.astype(np.int32), base, sizes, whole[win], (win - np.repeat(first, sizes)).astype(small), edges.astype(f"<u{width}")))
                for width, rows in out.items():
                    if rows:
                        k, hot, doc, digest, first, base, sizes, whole, steps, edges = (np.concatenate(x) for x in zip(*rows, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(hot), pa.array(doc, pa.int64()), pa.array(digest, pa.int64()), pa.array(first), pa.array(base, pa.int64()), pa.array(np.full(len(k), width, np.int32)), _packed(whole, sizes), _packed(steps, sizes), _packed(edges, sizes)], names=names)

    return placed.mapInArrow(run, "key bigint, hot boolean, doc_id bigint, digest bigint, first int, base bigint, width int, whole binary, steps binary, edges binary")


def _opened(t: pa.RecordBatch, small) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all stretches of rows of _with_stretches(): (row, hash, steps, edges)."""
    column = lambda c: t.column(t.schema.names.index(c))
    whole, size = _unpacked(column("whole"), np.uint64)
    row = np.repeat(np.arange(t.num_rows), size // 8)
    steps, width = _unpacked(column("steps"), small)[0].astype(np.int64), column("width").to_numpy()
    edges = np.empty((len(row), 2), dtype=np.int64)
    for w in (2, 4):
        own = np.flatnonzero(width == w)
        if len(own):
            edges[width[row] == w] = _unpacked(column("edges").take(pa.array(own)), f"<u{w}")[0].reshape(-1, 2)
    return row, whole, steps, edges


_FOUND = ["doc_id", "digest", "first", "last", "start", "length", "other_id", "later"]


def _meet(t: pa.RecordBatch, least: int, small) -> pa.RecordBatch | None:
    """Passages of kept suffixes, from rows that hold all stretches equal to any of theirs."""
    doc_id, digest, first, base = (t.column(t.schema.names.index(c)).to_numpy() for c in ("doc_id", "digest", "first", "base"))
    row, whole, steps, edges = _opened(t, small)
    # Equal stretches side by side, by text.
    doc = doc_id[row]
    order = np.lexsort((doc, whole))
    h, d = whole[order], doc[order]
    new_h = np.concatenate([[True], h[1:] != h[:-1]])
    lead = np.flatnonzero(new_h | np.concatenate([[True], d[1:] != d[:-1]]))  # runs of one stretch and text
    least_doc = d[np.flatnonzero(new_h)][np.cumsum(new_h) - 1]
    after = np.append(lead[1:], -1)
    more = (after >= 0) & (h[after] == h[lead])
    sizes = np.diff(np.append(lead, len(h)))
    found = []
    for is_later, flag, other in ((True, d > least_doc, least_doc), (False, np.repeat(more, sizes), np.repeat(d[after], sizes))):
        flagged, others = np.empty(len(h), dtype=bool), np.empty(len(h), dtype=np.int64)
        flagged[order], others[order] = flag, other
        f = np.flatnonzero(flagged)
        if len(f):
            r, at = row[f], steps[f]
            begin = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (at[1:] != at[:-1] + 1)]))
            end = np.append(begin[1:], len(f)) - 1
            own = r[begin]
            start = edges[f[begin], 0]
            found.append((doc_id[own], digest[own], first[own] + at[begin], first[own] + at[end] + least, base[own] + start, edges[f[end], 1] - start, np.minimum.reduceat(others[f], begin), np.full(len(begin), is_later)))
    if not found:
        return None
    columns = (np.concatenate(x) for x in zip(*found, strict=True))
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_FOUND)


def meetings(rows: DataFrame, parts: int, *, key: int, least: int) -> DataFrame:
    """What each kept suffix shares (columns _FOUND), from rows of _with_stretches(), at most about BUCKET of a key.

    All rows of one key are in one partition side by side, and are never divided.
    """
    small = np.uint8 if least - key < 256 else np.uint32

    def run(batches):
        held, count, limit = [], 0, BUCKET

        def whole():
            return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count >= limit:
                t = whole()
                k = t.column(t.schema.names.index("key")).to_numpy()
                border = np.flatnonzero(k != k[-1])
                cut = border[-1] + 1 if len(border) else 0
                if cut and (found := _meet(t.slice(0, cut), least, small)) is not None:
                    yield found
                held, count = [t.slice(cut)], t.num_rows - cut
                limit = max(BUCKET, 2 * count)
        if count and (found := _meet(whole(), least, small)) is not None:
            yield found

    return rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, "doc_id bigint, digest bigint, first int, last int, start bigint, length bigint, other_id bigint, later boolean")


def hot_meetings(rows: DataFrame, parts: int, *, key: int, least: int) -> DataFrame:
    """The same for keys with any number of places: no task holds a key, nor a stretch.

    Stretches are rows in ranges of doc_id. A range finds for each of its
    places the next text in it with the same stretch; what other ranges hold
    follows from one row for each stretch and range.
    """
    small = np.uint8 if least - key < 256 else np.uint32

    def loose(batches):
        for batch in batches:
            row, whole, steps, edges = _opened(batch, small)
            doc_id, digest, first, base = (batch.column(batch.schema.names.index(c)).to_numpy()[row] for c in ("doc_id", "digest", "first", "base"))
            yield pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), pa.array(doc_id), pa.array(digest), pa.array((first + steps).astype(np.int32)), pa.array(base + edges[:, 0]), pa.array(edges[:, 1] - edges[:, 0])], names=["whole", "doc_id", "digest", "first", "start", "length"])

    shape = "whole bigint, doc_id bigint, digest bigint, first int, start bigint, length bigint"

    def following(batches):
        from pyspark import TaskContext

        part, last_h, last_d, after_last = TaskContext.get().partitionId(), None, None, None
        for batch in batches:  # by stretch, the largest id first
            if not batch.num_rows:
                continue
            h, d = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lead = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])))
            before = np.append(0, d[lead[:-1]])
            known = np.append(False, h[lead[1:]] == h[lead[:-1]])
            if last_h is not None and h[0] == last_h:
                before[0], known[0] = (last_d, True) if d[0] != last_d else (after_last or 0, after_last is not None)
            sizes = np.diff(np.append(lead, len(h)))
            last_h, last_d, after_last = h[-1], d[-1], before[-1] if known[-1] else None
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.repeat(before, sizes), pa.int64(), mask=~np.repeat(known, sizes)), pa.array(np.full(len(h), part, np.int32))], names=[*batch.schema.names, "after", "part"])

    rows = rows.mapInArrow(loose, shape).repartitionByRange(parts, "doc_id").sortWithinPartitions("whole", F.desc("doc_id"))
    rows = materialize(rows.mapInArrow(following, f"{shape}, after bigint, part int"))
    of = Window.partitionBy("h").orderBy("p")  # a row for each range that holds the stretch
    ranges = rows.groupBy(F.col("whole").alias("h"), F.col("part").alias("p")).agg(F.min("doc_id").alias("lo"))
    ranges = ranges.select("h", "p", F.min("lo").over(Window.partitionBy("h")).alias("least_doc"), F.lead("lo").over(of).alias("beyond"))
    known = rows.join(ranges, (F.col("whole") == F.col("h")) & (F.col("part") == F.col("p")))
    after = F.coalesce("after", "beyond")
    both = F.array(F.when(F.col("doc_id") > F.col("least_doc"), F.struct(F.col("least_doc").alias("other_id"), F.lit(True).alias("later"))), F.when(after.isNotNull(), F.struct(after.alias("other_id"), F.lit(False).alias("later"))))
    return known.select("doc_id", "digest", "first", (F.col("first") + least).alias("last"), "start", "length", F.explode(F.array_compact(both)).alias("o")).select(*_FOUND[:6], "o.other_id", "o.later")


def shared_passages(docs: DataFrame, *, id: str = "doc_id", text: str = "text", least: int = 50, key: int = 24) -> DataFrame:
    """A row for each passage of at least least words that a text shares with another text: doc_id, first, last (word numbers, last exclusive), start, length (characters), other_id, later, digest.

    later marks the passages that a text with a smaller id holds as well: of a
    passage's copies the one with the smallest id is not later. Overlapping
    passages of a text are merged if both are later or neither is; other_id is the
    smallest of the texts before (later) or after it (not later) that share a part. Texts that are null, without id or shorter than least words share nothing.
    Rows that repeat an id are one document: they share nothing with each
    other, and where their texts differ, digest (xxhash64 of the text) says whose passage it is.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    kept = materialize(suffixes(docs, key=key, least=least))
    # Most keys occur in one text only; these go before the texts are looked at again.
    common = kept.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select(F.col("key").alias("k"), "n")
    common = materialize(common)
    shared = materialize(kept.join(common, F.col("key") == F.col("k")).select(F.col("doc_id").alias("id"), "pos", "key", (F.col("n") > BUCKET).alias("hot")))
    n_hot = common.where(F.col("n") > BUCKET).agg(F.sum("n")).first()[0] or 0
    discard(kept, common)

    # An id's places: as many as its rows have kept suffixes, so they grow with the rows that repeat one id.
    places = shared.groupBy("id").agg(F.collect_set(F.struct("pos", "key", "hot")).alias("at"))
    placed = docs.where("doc_id is not null and text is not null").join(places, F.col("doc_id") == F.col("id")).select("doc_id", "text", F.xxhash64("text").alias("digest"), F.col("at.pos").alias("pos"), F.col("at.key").alias("keys"), F.col("at.hot").alias("hot"))
    # Written, so that texts meet their places once for both kinds of keys.
    rows = materialize(_with_stretches(placed, key=key, least=least))
    discard(shared)
    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = meetings(rows.where("not hot"), spread, key=key, least=least)
    if n_hot:
        found = found.unionByName(hot_meetings(rows.where("hot"), max(spread, -(-n_hot // BUCKET)), key=key, least=least))
    # A text's passages: as many as it has stretches at most.
    w = Window.partitionBy("doc_id", "digest", "later").orderBy("start", "length", "other_id")
    reach = F.max(F.col("start") + F.col("length")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    grouped = found.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    merged = grouped.groupBy("doc_id", "digest", "later", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("end"), F.min("other_id").alias("other_id"))
    return merged.select("doc_id", "first", "last", "start", (F.col("end") - F.col("start")).alias("length"), "other_id", "later", "digest")


def cut_later(docs: DataFrame, *, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs, with all their columns, each later copy of a passage cut out of its text; texts left without a word go. A column n_chars is counted anew in texts that were cut.

    A row is cut by the passages of its own text, whether or not its id repeats; all other rows stay as they are.
    """
    own, of, cut, left = fresh(docs, "own", "of", "cut", "left")
    spans = shared_passages(docs, id=id, text=text, **options).where("later").groupBy(F.col("doc_id").alias(own), F.col("digest").alias(of)).agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias(cut))
    whole = F.col(f"`{text}`").cast("string")
    joined = docs.join(spans, (F.col(f"`{id}`").cast("bigint") == F.col(own)) & (F.xxhash64(whole) == F.col(of)), "left")
    n, spans_of = F.size(cut), F.col(cut)
    end = lambda i: spans_of[i]["start"] + spans_of[i]["length"]
    begin = lambda i: F.when(i == 0, 0).otherwise(end(i - 1))
    piece = lambda i: F.substring(whole, begin(i).cast("int") + 1, F.when(i == n, 2147483647).otherwise(spans_of[i]["start"] - begin(i)).cast("int"))
    kept = F.array_join(F.transform(F.sequence(F.lit(0), n), piece), "")
    made = joined.withColumn(left, F.when(F.col(cut).isNull(), whole).otherwise(kept)).where(F.col(cut).isNull() | F.col(left).rlike(r"[^\x20\x09-\x0d]"))
    uncut = F.col(cut).isNull()
    values = {text: F.col(left)} | ({"n_chars": F.when(uncut, F.col("n_chars")).otherwise(F.length(left))} if "n_chars" in docs.columns else {})
    return made.select(*(values[c].cast(docs.schema[c].dataType).alias(c) if c in values else F.col(f"`{c}`") for c in docs.columns))
