"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in a cycle over the features, each tree on the
histogram of one feature's bins; their sums are lookup tables, one for each
feature and then one for each of the pairs that explain most of what is left.
A text's score is the logistic of a sum of table entries.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.base import filter_texts, map_texts
from millrace.llm.text_stats import FEATURES, features


@dataclass(frozen=True)
class AdditiveModel:
    base: float
    edges: tuple[np.ndarray, ...]  # between a feature's bins
    single: tuple[np.ndarray, ...]  # a value for each bin
    coarse: tuple[np.ndarray, ...]  # edges for the pairs' bins
    pairs: tuple[tuple[int, int, np.ndarray], ...]

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, table in enumerate(self.single):
            out += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        for a, b, table in self.pairs:
            out += table[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -40, 40)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Between quantiles of the distinct values, so that a value that half of the rows share takes one bin."""
    distinct = np.unique(x)
    if len(distinct) <= 1:
        return np.zeros(0)
    cut = np.unique(np.quantile(distinct, np.linspace(0, 1, bins + 1)[1:-1]))
    at = np.clip(np.searchsorted(distinct, cut, side="right"), 1, len(distinct) - 1)
    return np.unique((distinct[at - 1] + distinct[at]) / 2)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Newton steps of a tree of so many leaves at most over bins with gradient sums g and curvature sums h."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    worth = lambda i, j: (cg[j] - cg[i]) ** 2 / (ch[j] - ch[i] + ridge)
    spans = [(0, len(g))]
    while len(spans) < leaves:
        best = (1e-9, None)
        for s, (i, j) in enumerate(spans):
            if j - i > 1:
                k = np.arange(i + 1, j)
                gain = worth(i, k) + worth(k, j) - worth(i, j)
                if gain.max() > best[0]:
                    best = (gain.max(), (s, int(k[gain.argmax()])))
        if best[1] is None:
            break
        s, k = best[1]
        i, j = spans[s]
        spans[s : s + 1] = [(i, k), (k, j)]
    out = np.zeros(len(g))
    for i, j in spans:
        out[i:j] = (cg[j] - cg[i]) / (ch[j] - ch[i] + ridge)
    return out


def _cross(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """A tree of four leaves over a grid: one cut on either axis; its values and its gain over no cut."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    total = lambda c: [c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1]]
    if g.shape[0] < 2 or g.shape[1] < 2:
        return np.zeros_like(g), 0.0
    gain = sum(a**2 / (b + ridge) for a, b in zip(total(cg), total(ch), strict=True))
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.zeros_like(g)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + ridge)
    return out, float(gain.max() - cg[-1, -1] ** 2 / (ch[-1, -1] + ridge))


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = 48, leaves: int = 4, rounds: int = 120, rate: float = 0.1, pairs: int = 8, pair_bins: int = 12, pair_rounds: int = 40, ridge: float = 5.0) -> AdditiveModel:
    """A model of labels y (0 or 1) from features x; with no rows the constant logit 0, with one label only 3 or -3."""
    m = x.shape[1] if x.ndim == 2 else len(FEATURES)
    if not len(y) or y.min() == y.max():
        base = 0.0 if not len(y) else (3.0 if y[0] else -3.0)
        return AdditiveModel(base, (np.zeros(0),) * m, (np.zeros(1),) * m, (np.zeros(0),) * m, ())
    p = y.mean()
    base = float(np.log(p / (1 - p)))
    edges = [_edges(x[:, j], bins) for j in range(m)]
    at = [np.searchsorted(edges[j], x[:, j], side="right") for j in range(m)]
    single = [np.zeros(len(e) + 1) for e in edges]
    logit = np.full(len(y), base)

    def gradient():
        q = 1 / (1 + np.exp(-logit))
        return y - q, q * (1 - q)

    for _ in range(rounds):
        for j in range(m):
            if len(edges[j]):
                g, h = gradient()
                step = rate * _tree(np.bincount(at[j], g, len(single[j])), np.bincount(at[j], h, len(single[j])), leaves, ridge)
                single[j] += step
                logit += step[at[j]]
    coarse = [_edges(x[:, j], pair_bins) for j in range(m)]
    near = [np.searchsorted(coarse[j], x[:, j], side="right") for j in range(m)]

    def grid(a, b, values):
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        return np.bincount(near[a] * shape[1] + near[b], values, shape[0] * shape[1]).reshape(shape)

    g, h = gradient()
    gains = [(-_cross(grid(a, b, g), grid(a, b, h), ridge)[1], a, b) for a in range(m) for b in range(a + 1, m)]
    chosen = [(a, b, np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))) for gain, a, b in sorted(gains)[:pairs] if gain < 0]
    for _ in range(pair_rounds):
        for a, b, table in chosen:
            g, h = gradient()
            step = rate * _cross(grid(a, b, g), grid(a, b, h), ridge)[0]
            table += step
            logit += step[near[a], near[b]]
    return AdditiveModel(base, tuple(edges), tuple(single), tuple(coarse), tuple(chosen))


def labelled_features(docs: DataFrame, labels: DataFrame, where: Column, *, most_rows: int = 12_000, id: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most most_rows labelled texts, by the order of a hash of their ids; an id labelled both ways takes the rounded mean, one with several texts the smallest features."""
    chosen = labels.where(where & F.col(label).isNotNull() & F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col(label).cast("int").alias("y")).groupBy("id").agg(F.round(F.avg("y")).cast("int").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most_rows)
    found = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")  # most_rows bounds the broadcast

    def make():
        def compute(texts: pa.Array) -> dict:
            x = features(texts)
            return {"x": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))}

        return compute

    rows = map_texts(found, ["id", "y"], "text", make, "x array<double>").groupBy("id", "y").agg(F.min("x").alias("x")).orderBy("id").toArrow()
    if not rows.num_rows:
        return np.zeros((0, len(FEATURES))), np.zeros(0)
    return np.array(rows.column("x").to_pylist()), rows.column("y").to_numpy().astype(float)


def score_texts(docs: DataFrame, model: AdditiveModel, *, keep: list[str], text: str = "text") -> DataFrame:
    """keep, score (0 to 1) and predicted (1 from 0.5 up) for every whole text; null texts score as empty ones."""

    def make():
        def score(texts: pa.Array) -> dict:
            s = model.score(features(texts))
            return {"score": pa.array(s), "predicted": pa.array((s >= 0.5).astype(np.int32))}

        return score

    return map_texts(docs, keep, text, make, "score double, predicted int")


def keep_good(docs: DataFrame, model: AdditiveModel, *, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs, with all columns, whose text scores at least so much."""
    return filter_texts(docs, text, lambda: lambda texts: pa.array(model.score(features(texts)) >= least))
