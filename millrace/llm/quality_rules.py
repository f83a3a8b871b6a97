"""Quality rules: base rules on exact counts, then isolation forests on the rules' statistics.

Random splits isolate a text whose statistics lie apart in fewer steps than
one in the crowd. Each statistic has a forest of its own, as has their joint
space, so that an oddity in one does not drown in the spread of the others;
the path length at which a text counts as anomalous is set for each forest from all labelled rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.llm.base import discard, filter_texts, map_texts, materialize, small_batches
from millrace.llm.text_stats import rule_counts

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class IsolationForest:
    """Trees in arrays of a row each: feature split on (-1 in a leaf), value, left child (right is next to it), path length in a leaf."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    path: np.ndarray
    normal: float  # mean path length of an unsuccessful search among the sample

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores from 0 (deep) to 1 (isolated at once)."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                f = self.feature[t, at]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] >= self.value[t, at]
                at = np.where(inner, self.left[t, at] + right, at)
            total += self.path[t, at]
        return 2.0 ** (-total / max(1, len(self.feature)) / self.normal)


def _mean_path(n: int) -> float:
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def fit_forest(x: np.ndarray, *, trees: int = 100, sample: int = 256, seed: int = 7) -> IsolationForest:
    """A forest over the rows of x; the same rows in any order of repetition give the same forest for a seed."""
    rng = np.random.default_rng(seed)
    size = min(sample, len(x))
    depth = int(np.ceil(np.log2(max(2, size))))
    nodes = 2 ** (depth + 2)
    feature, value = np.full((trees, nodes), -1), np.zeros((trees, nodes))
    left, path = np.zeros((trees, nodes), dtype=np.int64), np.zeros((trees, nodes))
    for t in range(trees if size else 0):
        used = 1
        todo = [(0, rng.choice(len(x), size, replace=False), 0)]
        while todo:
            node, rows, d = todo.pop()
            own = x[rows]
            wide = np.flatnonzero(own.min(0) < own.max(0)) if len(rows) > 1 else ()
            if d >= depth or not len(wide):
                path[t, node] = d + _mean_path(len(rows))
                continue
            f = rng.choice(wide)
            cut = rng.uniform(own[:, f].min(), own[:, f].max())
            right = own[:, f] >= cut
            feature[t, node], value[t, node], left[t, node] = f, cut, used
            todo += [(used, rows[~right], d + 1), (used + 1, rows[right], d + 1)]
            used += 2
    return IsolationForest(feature, value, left, path, max(1e-9, _mean_path(size)))


def statistics(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Scale-free statistics of the rules: shares of symbols, repeated words and lines, and the logarithm of the mean word's length."""
    words = np.maximum(1, counts["n_words"])
    symbols = counts["n_symbols"] / np.maximum(1, counts["word_chars"])
    # A text of a symbol or two is as good as one of none; shares above a quarter are all alike.
    return np.column_stack([np.clip(symbols, 0.005, 0.25), counts["n_repeat_words"] / words, counts["n_dup_lines"] / words, np.log(np.maximum(1, counts["word_chars"]) / words)])


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


def calibrate(score: np.ndarray, good: np.ndarray, *, loss: float = 0.0005, least: float = 0.05) -> float:
    """The score from which texts are anomalous.

    Of all thresholds that lose at most the share loss of the good rows, one
    that rejects most of the others; among equals the highest. Without rows of
    both labels, or if none rejects the share least of the others, nothing is anomalous.
    """
    if not good.any() or good.all():
        return 2.0
    cuts = np.unique(score)
    middle = np.append((cuts[1:] + cuts[:-1]) / 2, 2.0)
    good_score, bad_score = np.sort(score[good]), np.sort(score[~good])
    lost = 1 - np.searchsorted(good_score, middle, side="left") / len(good_score)
    caught = 1 - np.searchsorted(bad_score, middle, side="left") / len(bad_score)
    worth = np.where(lost <= loss, caught - lost, -1.0)
    if worth.max() < least:
        return 2.0
    return float(middle[np.flatnonzero(worth == worth.max())[-1]])


def counted(docs: DataFrame, *, keep: list[str], text: str = "text") -> DataFrame:
    """keep and the five counts of every whole text."""
    return map_texts(docs, keep, text, lambda: lambda texts: {k: pa.array(v) for k, v in rule_counts(texts).items()}, ", ".join(f"{c} bigint" for c in COUNTS))


def labelled(counts: DataFrame, labels: DataFrame, where: Column, *, id: str = "doc_id", label: str = "quality") -> DataFrame:
    """id, y (1: good) and the five counts of every labelled text, from rows of counted(); an id labelled both ways takes the rounded mean, one with several texts the smallest counts."""
    known = labels.where(where & F.col(label).isNotNull() & F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col(label).cast("int").alias("y")).groupBy("id").agg(F.round(F.avg("y")).cast("int").alias("y"))
    least = counts.where(F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.min(F.struct(*COUNTS)).alias("least"))
    return known.join(least, "id").select("id", "y", "least.*")


def _arrays(rows: DataFrame) -> tuple[dict[str, np.ndarray], np.ndarray]:
    held = rows.orderBy("id").toArrow()
    return {c: held.column(c).to_numpy() for c in COUNTS}, held.column("y").to_numpy() == 1


def labelled_counts(docs: DataFrame, labels: DataFrame, where: Column, *, id: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Rows of labelled() as arrays for fit(), all of them: for tables that one process holds. fit_rules() collects no such table."""
    return _arrays(labelled(counted(docs, keep=[id], text=text), labels, where, id=id, label=label))


def _mapped(rows: DataFrame, keep: list[str], make: Callable[[dict[str, np.ndarray]], dict], schema: str, most: int = 1 << 14) -> DataFrame:
    """keep beside what make returns for the five counts of rows, so many at once: a tree takes as many steps for one row as for thousands."""
    small_batches(rows.sparkSession)
    made = StructType.fromDDL(schema).names
    names = [*keep, *made]

    def run(batches):
        def done(held):
            t = pa.Table.from_batches(held).combine_chunks()
            out = make({c: t.column(len(keep) + i).to_numpy() for i, c in enumerate(COUNTS)})
            yield from pa.table([*(t.column(i) for i in range(len(keep))), *(pa.array(out[c]) for c in made)], names=names).to_batches()

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                yield from done(held)
                held, n = [], 0
        if n:
            yield from done(held)

    return rows.select(*keep, *COUNTS).mapInArrow(run, ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), schema]))


@dataclass(frozen=True)
class Rules:
    """Forests, each over some columns of statistics(), and the score from which each calls a text anomalous."""

    parts: tuple[tuple[tuple[int, ...], IsolationForest, float], ...]

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        """The largest score over its forest's threshold: from 1 up a text is anomalous."""
        out = np.zeros(len(x))
        for columns, forest, threshold in self.parts:
            out = np.maximum(out, forest.score(x[:, columns]) / threshold)
        return out


def fit(x: np.ndarray, good: np.ndarray) -> Rules:
    """Forests over statistics of texts that passed the base rules; labels only set the thresholds.

    A forest's threshold is set on the rows that no earlier forest rejects; one that tells their labels apart too little is left out.
    """
    parts, left = [], np.ones(len(x), dtype=bool)
    for columns in (*((j,) for j in range(x.shape[1])), tuple(range(x.shape[1]))):
        if len(x):
            forest = fit_forest(x[:, columns])
            score = forest.score(x[:, columns])
            if (threshold := calibrate(score[left], good[left])) < 2:
                parts.append((columns, forest, threshold))
                left &= score < threshold
    return Rules(tuple(parts))


def threshold(rows: DataFrame, score: str, good: str = "good", *, loss: float = 0.0005, least: float = 0.05, buckets: int = 4096) -> float:
    """calibrate() over all rows of a table. Only the rows in each bucket of scores are gathered, and in the buckets that a threshold can lie in, running sums are taken bucket by bucket."""
    each = rows.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(good).cast("int")).alias("good"), F.sum((~F.col(good)).cast("int")).alias("bad")).withColumn("k", F.floor(F.col("s") * buckets).cast("int"))
    sums = each.groupBy("k").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.max("s").alias("top")).orderBy(F.desc("k")).collect()  # a row for each bucket at most
    n_good, n_bad = sum(r.good for r in sums), sum(r.bad for r in sums)
    if not n_good or not n_bad:
        return 2.0
    above, g, b = [], 0, 0
    for r, after in zip(sums, [*sums[1:], None], strict=True):
        if 1 - (n_good - g) / n_good > loss:
            break
        above.append((r.k, g, b, after.top if after else None))
        g, b = g + r.good, b + r.bad
    w = Window.partitionBy("k").orderBy(F.desc("s"))
    share = lambda c, before, n: 1 - (n - F.col(before) - F.sum(c).over(w)).cast("double") / n
    tail = each.join(F.broadcast(rows.sparkSession.createDataFrame(above, "k int, g bigint, b bigint, below double")), "k")
    cuts = tail.select("s", F.coalesce(F.lead("s").over(w), "below").alias("lower"), share("good", "g", n_good).alias("lost"), share("bad", "b", n_bad).alias("caught")).where("lower is not null").where(F.col("lost") <= loss)
    middle = (F.col("s") + F.col("lower")) / 2
    best = cuts.agg(F.max(F.struct((F.col("caught") - F.col("lost")).alias("worth"), F.when(middle > F.col("lower"), middle).otherwise(F.col("s")).alias("cut"))).alias("best")).first().best
    return best.cut if best and best.worth >= least else 2.0


def fit_counted(counts: DataFrame, labels: DataFrame, where: Column, *, id: str = "doc_id", label: str = "quality", trees: int = 100, sample: int = 256) -> Rules:
    """fit() as Spark jobs over every labelled text that passes the base rules, from rows of counted(); without such texts nothing is anomalous.

    The thresholds are set on all of these texts. An isolation forest's tree is
    grown over few rows by definition: the trees draw theirs from as many rows as they hold
    together, by the order of a hash of the ids. No other rows reach the driver.
    """
    rows = materialize(labelled(counts, labels, where, id=id, label=label).where(~base_failed({c: F.col(c) for c in COUNTS})))
    x = statistics(_arrays(rows.orderBy(F.xxhash64("id"), "id").limit(trees * sample))[0])
    if not len(x):
        return Rules(())
    spaces = (*((j,) for j in range(x.shape[1])), tuple(range(x.shape[1])))
    forests = [fit_forest(x[:, columns], trees=trees, sample=sample) for columns in spaces]

    def score(counts: dict[str, np.ndarray]) -> dict:
        own = statistics(counts)
        return {f"s{k}": forest.score(own[:, columns]) for k, (columns, forest) in enumerate(zip(spaces, forests, strict=True))}

    left = scores = materialize(_mapped(rows.withColumn("good", F.col("y") == 1), ["good"], score, ", ".join(f"s{k} double" for k in range(len(spaces)))))
    parts = []
    for k, (columns, forest) in enumerate(zip(spaces, forests, strict=True)):
        if (cut := threshold(left, f"s{k}")) < 2:
            parts.append((columns, forest, cut))
            left = left.where(F.col(f"s{k}") < cut)
    discard(rows, scores)
    return Rules(tuple(parts))


def fit_rules(docs: DataFrame, labels: DataFrame, where: Column, *, id: str = "doc_id", text: str = "text", **options) -> Rules:
    """fit_counted() from texts."""
    return fit_counted(counted(docs, keep=[id], text=text), labels, where, id=id, **options)


def _verdict(rules: Rules, counts: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    failed = base_failed(counts)
    anomaly = rules.anomaly(statistics(counts))
    return failed, anomaly, ~failed & (anomaly < 1)


def judge(docs: DataFrame, rules: Rules, *, keep: list[str], text: str = "text") -> DataFrame:
    """keep, the five counts, base_failed, kept and anomaly for every whole text; null and empty texts have no words and fail."""

    def make():
        def run(texts: pa.Array) -> dict:
            counts = rule_counts(texts)
            failed, anomaly, kept = _verdict(rules, counts)
            return {k: pa.array(v) for k, v in counts.items()} | {"base_failed": pa.array(failed), "kept": pa.array(kept), "anomaly": pa.array(anomaly)}

        return run

    return map_texts(docs, keep, text, make, ", ".join(f"{c} bigint" for c in COUNTS) + ", base_failed boolean, kept boolean, anomaly double")


def judge_counted(counts: DataFrame, rules: Rules, *, keep: list[str]) -> DataFrame:
    """judge() from rows of counted()."""

    def run(counts: dict[str, np.ndarray]) -> dict:
        failed, anomaly, kept = _verdict(rules, counts)
        return counts | {"base_failed": failed, "kept": kept, "anomaly": anomaly}

    return _mapped(counts, keep, run, ", ".join(f"{c} bigint" for c in COUNTS) + ", base_failed boolean, kept boolean, anomaly double")


def keep_passing(docs: DataFrame, rules: Rules, *, text: str = "text") -> DataFrame:
    """The rows of docs, with all columns, whose text passes."""
    return filter_texts(docs, text, lambda: lambda texts: pa.array(_verdict(rules, rule_counts(texts))[2]))
