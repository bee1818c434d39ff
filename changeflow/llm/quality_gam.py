"""Operator 8: quality classifier, a generalised additive model with pairwise interactions.

Each statistic is cut into quantile bins. Shallow trees are boosted in turn over
the statistics, each adding to its statistic's table of bin scores; then the
pairs of statistics with the strongest remaining signal get two-way tables in
the same way. A score is the logistic of the sum of the looked-up entries.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.llm.common import id_remainder, read, save
from changeflow.llm.quality_rules import FEATURES, features, statistics

# At most this many labelled rows are fitted on, those of smallest id hash.
MAX_TRAIN = 20_000
MAX_BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS = 60, 30
PAIRS = 5
RATE = 0.3
# Leaves of a shallow tree; weight that keeps a leaf's step small where rows are few.
LEAVES = 4
RIDGE = 5.0


def bin_edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Ascending cut points; a value's bin is the number of cuts at or below it."""
    return np.unique(np.quantile(x, np.arange(1, bins) / bins, method="higher")) if len(x) else np.empty(0)


def tree_steps(grad: np.ndarray, hess: np.ndarray, leaves: int) -> np.ndarray:
    """The step of every bin, by a tree that greedily cuts the ordered bins into ``leaves`` intervals."""
    g, h = np.r_[0, np.cumsum(grad)], np.r_[0, np.cumsum(hess)]
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + RIDGE)
    cuts = [0, len(grad)]
    for _ in range(leaves - 1):
        best, at = 1e-9, None
        for a, b in itertools.pairwise(cuts):
            if b - a > 1:
                k = np.arange(a + 1, b)
                gain = worth(a, k) + worth(k, b) - worth(a, b)
                if gain.max() > best:
                    best, at = gain.max(), int(k[gain.argmax()])
        if at is None:
            break
        cuts = sorted([*cuts, at])
    out = np.empty(len(grad))
    for a, b in itertools.pairwise(cuts):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + RIDGE)
    return out


def cross_steps(grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and steps of the best cross-shaped tree of a two-way table: one cut on each side, four quadrants."""
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    best, out = 0.0, np.zeros_like(grad)
    whole = g[-1, -1] ** 2 / (h[-1, -1] + RIDGE)
    for a in range(grad.shape[0] - 1):
        for b in range(grad.shape[1] - 1):
            gs = np.array([[g[a, b], g[a, -1] - g[a, b]], [g[-1, b] - g[a, b], g[-1, -1] - g[a, -1] - g[-1, b] + g[a, b]]])
            hs = np.array([[h[a, b], h[a, -1] - h[a, b]], [h[-1, b] - h[a, b], h[-1, -1] - h[a, -1] - h[-1, b] + h[a, b]]])
            gain = (gs**2 / (hs + RIDGE)).sum() - whole
            if gain > best:
                best, steps = gain, gs / (hs + RIDGE)
                out = np.repeat(np.repeat(steps, [a + 1, grad.shape[0] - a - 1], 0), [b + 1, grad.shape[1] - b - 1], 1)
    return best, out


class Gam:
    """Intercept, per-statistic tables and pair tables."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        """Fit to rows ``x`` with labels ``y`` in 0, 1; no rows give the score 0.5 everywhere."""
        self.edges = [bin_edges(c, MAX_BINS) for c in x.T]
        self.coarse = [bin_edges(c, PAIR_BINS) for c in x.T]
        self.intercept = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: dict[tuple[int, int], np.ndarray] = {}
        total = np.full(len(y), self.intercept)
        fine = [np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)]
        rough = [np.searchsorted(e, c, "right") for e, c in zip(self.coarse, x.T)]

        def residual() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-total))
            return y - p, p * (1 - p)

        for _, i in itertools.product(range(ROUNDS), range(len(self.tables))):
            grad, hess = residual()
            n = len(self.tables[i])
            step = RATE * tree_steps(np.bincount(fine[i], grad, n), np.bincount(fine[i], hess, n), LEAVES)
            self.tables[i] += step
            total += step[fine[i]]
        grad, hess = residual()

        def table(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
            shape = (len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)
            cell = rough[i] * shape[1] + rough[j]
            return np.bincount(cell, grad, shape[0] * shape[1]).reshape(shape), np.bincount(cell, hess, shape[0] * shape[1]).reshape(shape)

        strength = {(i, j): cross_steps(*table(i, j))[0] for i, j in itertools.combinations(range(len(self.tables)), 2)}
        for key in sorted(strength, key=lambda k: (-strength[k], k))[:PAIRS]:
            self.pairs[key] = np.zeros((len(self.coarse[key[0]]) + 1, len(self.coarse[key[1]]) + 1))
        for _, (i, j) in itertools.product(range(PAIR_ROUNDS), self.pairs):
            grad, hess = residual()
            step = RATE * cross_steps(*table(i, j))[1]
            self.pairs[i, j] += step
            total += step[rough[i], rough[j]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for c, e, t in zip(x.T, self.edges, self.tables):
            total += t[np.searchsorted(e, c, "right")]
        rough = [np.searchsorted(e, c, "right") for e, c in zip(self.coarse, x.T)]
        for (i, j), t in self.pairs.items():
            total += t[rough[i], rough[j]]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def train(rows: DataFrame) -> Gam:
    """Fit on rows (f: FEATURES struct, y 0/1, doc_id): all, or the MAX_TRAIN of smallest id hash."""
    some = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN).select("f.*", "y").toPandas()
    return Gam(some[FEATURES].to_numpy(float).reshape(-1, len(FEATURES)), some["y"].to_numpy(float))


def _scorer(model: Gam):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for f in frames:
            yield pd.Series(model.score(f[FEATURES].to_numpy(float)))

    return run


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out and score of every row of ``docs`` (doc_id, text, boolean held_out).

    Learned from rows that are not held out and have a label; a document with
    several labels counts as bad if any is. Null and empty texts are scored like
    any text of no words; null doc_ids are scored and never learned from. Without
    labels every score is 0.5. Only the named columns are read.
    """
    base = save(docs.select("doc_id", "held_out", features(statistics(F.col("text"))).alias("f")), "gam-features")
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    model = train(base.where("NOT held_out").join(marks, "doc_id"))
    scorer = F.pandas_udf(_scorer(model), "double")
    return base.select("doc_id", "held_out", scorer("f").alias("score"))


def op8_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from labels of documents whose crc32(doc_id as text) mod 3 is not 1 and scores all documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"))
    out = quality_scores(docs, read(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
