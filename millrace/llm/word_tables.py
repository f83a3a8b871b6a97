"""Distinct words of a corpus, counted in Spark."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.base import slices, small_batches


def word_counts(docs: DataFrame, make: Callable[[], Callable[[str], Iterable[str]]], *, text: str) -> DataFrame:
    """word and n over all texts, by the function from make(), which is called once a task. Blocks of texts are counted before words meet."""
    small_batches(docs.sparkSession)

    def run(batches):
        words_of = make()
        for batch in batches:
            for part in slices(batch, 0):
                count: Counter = Counter()
                for content in part.column(0).to_pylist():
                    count.update(words_of(content))
                yield pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.string()), pa.array(count.values(), pa.int64())], names=["word", "n"])

    own = docs.select(F.col(f"`{text}`").cast("string").alias("text")).where("text is not null")
    return own.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def commonest(counts: DataFrame, *, most_words: int, longest: int) -> Column:
    """Which words of a written table of counts are the commonest: of those that occur twice or more and have up to longest bytes, most_words at most.

    Where the line falls is read from a histogram of the counts, whose steps are a
    sixteenth of a doubling; words of a step are in or out together, so that no task sorts them.
    """
    able, step = (F.col("n") > 1) & (F.octet_length("word") <= longest), F.floor(16 * F.log2("n")).cast("int")
    line, total = 1 << 30, 0
    for r in counts.where(able).groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():  # a thousand rows at most
        total += r.words
        if total > most_words:
            break
        line = r.step
    return able & (step >= line)


def valued(words: DataFrame, run, kind: str) -> DataFrame:
    """word and the value, a column of kind, that run (for mapInArrow) gives it."""
    return words.select("word").mapInArrow(run, f"word string, value {kind}")


def as_dict(found: DataFrame) -> dict:
    """A bounded table of words and values on the driver."""
    held = found.toArrow()
    return dict(zip(held.column("word").to_pylist(), held.column("value").to_pylist(), strict=True))
