"""Quality classifier: histogram gradient-boosted trees in numpy, flattened for vectorised scoring."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .docstats import RATIOS, held_out, labelled_sample, with_statistics

SAMPLE_ROWS = 12_000  # labelled documents that training may see


@dataclass
class BoostedTrees:
    """Complete binary trees as arrays [tree, node] in heap order; a node sends x[feature] > split to 2k + 2, else to 2k + 1."""

    feature: np.ndarray
    split: np.ndarray
    leaf: np.ndarray
    bias: float

    @property
    def depth(self) -> int:
        return int(np.log2(self.leaf.shape[1])) if self.leaf.size else 0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, ridge: float = 1.0, least: int = 5) -> BoostedTrees:
        """Minimise logistic loss by second-order boosting on binned features."""
        n, width = x.shape
        p = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
        bias = float(np.log(p / (1 - p)))
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for f in range(width)]
        binned = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(width)], axis=1) if n else np.zeros((0, width), np.int64)
        inner, leaves = 2**depth - 1, 2**depth
        feature, split, leaf = np.zeros((trees, inner), np.int16), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
        margin = np.full(n, bias)
        for t in range(trees if n else 0):
            q = 1 / (1 + np.exp(-margin))
            g, h, node = q - y, np.maximum(q * (1 - q), 1e-6), np.zeros(n, dtype=np.int64)
            for level in range(depth):
                base, m = 2**level - 1, 2**level
                at = node - base
                best = np.full(m, 1e-6)
                for f in range(width):
                    if not len(edges[f]):
                        continue
                    k, nb = at * bins + binned[:, f], bins
                    hist = [np.bincount(k, weights=v, minlength=m * nb).reshape(m, nb) for v in (g, h, np.ones(n))]
                    (gl, hl, cl), (gs, hs, cs) = [np.cumsum(v, axis=1)[:, : len(edges[f])] for v in hist], [v.sum(axis=1, keepdims=True) for v in hist]
                    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    gain[(cl < least) | (cs - cl < least)] = 0
                    pick = gain.argmax(axis=1)
                    won = gain[np.arange(m), pick] > best
                    best[won] = gain[np.arange(m), pick][won]
                    feature[t, base + np.flatnonzero(won)] = f
                    split[t, base + np.flatnonzero(won)] = edges[f][pick[won]]
                node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > split[t, node])
            end = node - inner
            leaf[t] = -rate * np.bincount(end, weights=g, minlength=leaves) / (np.bincount(end, weights=h, minlength=leaves) + ridge)
            margin += leaf[t, end]
        return cls(feature, split, leaf, bias)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """All trees at once, a level a step."""
        out = np.full(len(x), self.bias)
        if not self.leaf.size:
            return out
        tree, inner = np.arange(len(self.leaf)), self.feature.shape[1]
        for at in range(0, len(x), 4096):
            rows = x[at : at + 4096]
            node, row = np.zeros((len(rows), len(tree)), dtype=np.int64), np.arange(len(rows))[:, None]
            for _ in range(self.depth):
                node = 2 * node + 1 + (rows[row, self.feature[tree, node]] > self.split[tree, node])
            out[at : at + 4096] += self.leaf[tree, node - inner].sum(axis=1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, **options: float) -> BoostedTrees | None:
    """Fit on at most rows labelled documents outside the held-out quarter; None if there are none."""
    allowed = labels.where(~held_out())
    sample = with_statistics(labelled_sample(docs, allowed, label, rows)).select("doc_id", "label", "ratios").toPandas()
    if not len(sample):
        return None
    sample = sample.sort_values("doc_id", kind="stable")
    return BoostedTrees.fit(np.stack(sample["ratios"].to_numpy()), (sample["label"].to_numpy() == 1).astype(np.float64), **options)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", cut: float = 0.7, rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs without text, with held_out, score (0 to 1, higher: label 1 likelier) and predicted (score >= cut).

    Scores depend on the text alone.  Null and empty texts have all-zero
    statistics and get a score too; without usable labels every score is 0.5.
    Columns of docs with a result's name or a count's (docstats.COUNTS) are replaced.
    Rows that repeat a doc_id are scored each by its own text; texts of any length are
    read whole; an empty docs gives an empty result.
    """
    model = train(docs, labels, label, rows)
    stats = with_statistics(docs.drop("held_out", "score", "predicted"))
    if model is None:
        scored = stats.withColumn("score", F.lit(0.5))
    else:

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for ratios in batches:
                yield pd.Series(model.probability(np.stack(ratios.to_numpy())) if len(ratios) else [], dtype="float64")

        scored = stats.withColumn("score", score("ratios"))
    scored = scored.withColumn("held_out", held_out()).withColumn("predicted", (F.col("score") >= cut).cast("int"))
    return scored.drop("ratios")


__all__ = ["RATIOS", "BoostedTrees", "classify", "train"]
