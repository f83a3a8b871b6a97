"""Token counts without ids.

The corpus's distinct pre-tokens are counted in Spark and cut into pieces once
each. Their numbers of pieces join each document's pre-token frequencies: those
of the commonest, up to a bound, in the tasks that count a document's
pre-tokens, those of all others by an exchange. The sums are the counts.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.base import fresh, map_texts, materialize
from millrace.llm.byte_bpe import PATTERN, ByteBpe
from millrace.llm.word_tables import as_dict, commonest, valued, word_counts


class PreTokens:
    def __init__(self, path: str):
        import regex

        self.bpe = ByteBpe(path)
        self.split = regex.compile(PATTERN).findall
        self.special = regex.compile("|".join(map(regex.escape, self.bpe.special))) if self.bpe.special else None

    def whole(self, text: str) -> bool:
        """Whether the library has to see the text as it is, for characters of unsteady class."""
        return not text.isascii() and self.bpe.unstable(text) is not None

    def of(self, text: str) -> tuple[Counter, int]:
        """(how often each pre-token occurs, special strings, which are one token each)."""
        if self.special and self.special.search(text):
            parts, out = self.special.split(text), Counter()
            for part in parts:
                out.update(self.split(part))
            return out, len(parts) - 1
        return Counter(self.split(text)), 0


def piece_tables(docs: DataFrame, path: str, *, text: str = "text", most_words: int = 200_000, longest: int = 64) -> tuple[dict[str, int], DataFrame]:
    """Numbers of pieces of all distinct pre-tokens of all texts, each cut once, in two parts.

    First the commonest, which are sent to tasks: most_words of up to longest
    bytes at most. Then a table (word, value) of all others.
    """

    def make():
        pre = PreTokens(path)
        return lambda content: () if pre.whole(content) else pre.of(content)[0]

    def run(batches):
        encode = ByteBpe(path).fast.encode_ordinary
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(encode(t)) for t in batch.column(0).to_pylist()], pa.int32())], names=["word", "value"])

    counts = materialize(word_counts(docs, make, text=text))
    first = commonest(counts, most_words=most_words, longest=longest)
    return as_dict(valued(counts.where(first), run, "int")), valued(counts.where(~first), run, "int")


def piece_table(docs: DataFrame, path: str, **options) -> dict[str, int]:
    """The commonest alone."""
    return piece_tables(docs, path, **options)[0]


class PieceCounter:
    """table: pieces of pre-tokens."""

    def __init__(self, path: str, table: dict[str, int]):
        self.pre, self.table = PreTokens(path), table

    def known(self, text: str) -> tuple[int, dict[str, int]]:
        """(tokens of what the table holds, special strings and texts that the library has to see whole; frequencies of all other pre-tokens)."""
        if self.pre.whole(text):
            return len(self.pre.bpe.library.encode(text, add_special_tokens=False).ids), {}
        found, total = self.pre.of(text)
        rest = {}
        for (w, n), pieces in zip(found.items(), map(self.table.get, found), strict=True):
            if pieces is None:
                rest[w] = n
            else:
                total += n * pieces
        return total, rest

    def count(self, text: str) -> int:
        """The tokens of one text, what the table lacks cut where it stands."""
        total, rest = self.known(text)
        return total + sum(n * len(self.pre.bpe.fast.encode_ordinary(w)) for w, n in rest.items())


def count_tokens(docs: DataFrame, path: str, *, keep: list[str], text: str = "text", most_words: int = 200_000) -> DataFrame:
    """keep, n_bytes (UTF-8) and n_tokens of every whole text; null texts are empty and have none.

    Special strings inside a text count as the library's default has them: one
    token each. Repeated rows each count. The tables of distinct pre-tokens are
    made when this is called, most_words of them sent to tasks at most; a text
    whose pre-tokens are not in them, as docs gave other rows when read again, is an error.
    """
    common, others = piece_tables(docs, path, text=text, most_words=most_words)
    held = docs.sparkSession.sparkContext.broadcast(common)
    row, known, words, times = fresh(docs, "row", "known", "words", "times")

    def make():
        counter = PieceCounter(path, held.value)

        def run(texts: pa.Array) -> dict:
            size = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
            found = [counter.known(t) if t else (0, {}) for t in texts.to_pylist()]
            return {
                "n_bytes": size,
                known: pa.array([n for n, _ in found], pa.int64()),
                words: pa.array([list(rest) for _, rest in found], pa.list_(pa.string())),
                times: pa.array([list(rest.values()) for _, rest in found], pa.list_(pa.int64())),
            }

        return run

    # Rows are numbered in the pass that writes them, so repeated and null ids do no harm.
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    counted = materialize(map_texts(numbered, [*keep, row], text, make, f"n_bytes bigint, {known} bigint, {words} array<string>, {times} array<bigint>"))
    rest = counted.select(row, F.explode(F.arrays_zip(words, times)).alias("x")).select(F.col(row).alias("at"), F.col(f"x.{words}").alias("word"), F.col(f"x.{times}").alias("times"))
    pieces = F.coalesce("value", F.raise_error(F.lit("the texts changed while they were counted")).cast("int"))
    added = rest.join(others, "word", "left").groupBy("at").agg(F.sum(F.col("times") * pieces).alias("more"))
    whole = counted.join(added, counted[row] == added["at"], "left")
    return whole.select(*(counted[f"`{c}`"] for c in keep), counted["n_bytes"], (counted[known] + F.coalesce(added["more"], F.lit(0))).alias("n_tokens"))


def with_limit(counted: DataFrame, limit: int) -> DataFrame:
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
