"""Quality rules: an isolation forest on rule statistics.

Hard rules look at exact counts.  What passes them is judged by an isolation
forest over the documents' ratios: random splits separate an odd document from
the rest after few steps, so a short mean path is an anomaly.  Trees are grown on
small subsamples, as the method has it; scales, path lengths and the threshold on the
anomaly score come from all labelled rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .docstats import COUNTS, RATIOS, usable_labels, with_statistics
from .work import materialize, release, small_batches

SCORE_BINS = 1 << 16  # steps of the scores that the threshold is chosen from
FULL_TRUST_WORDS = 200  # words from which a document's ratios count in full


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.maximum(np.asarray(n, dtype=np.float64), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


@dataclass
class IsolationForest:
    """Trees as arrays in heap order: node k has children 2k + 1 and 2k + 2; a feature of -1 is a leaf of the given path length."""

    feature: np.ndarray
    split: np.ndarray
    length: np.ndarray
    subsample: int

    @classmethod
    def grow(cls, x: np.ndarray, trees: int = 200, subsample: int = 64, seed: int = 7) -> IsolationForest:
        rng, m = np.random.default_rng(seed), min(subsample, max(1, len(x)))
        depth = int(np.ceil(np.log2(max(2, m))))
        nodes = 2 ** (depth + 1) - 1
        feature, split, length = np.full((trees, nodes), -1, np.int16), np.zeros((trees, nodes)), np.zeros((trees, nodes))
        for t in range(trees):
            stack = [(0, 0, x[rng.choice(len(x), m, replace=False)] if len(x) else np.zeros((0, x.shape[1])))]
            while stack:
                k, level, own = stack.pop()
                low, high = (own.min(axis=0), own.max(axis=0)) if len(own) else (np.zeros(0), np.zeros(0))
                open_ = np.flatnonzero(high > low)
                if level == depth or len(own) <= 1 or not len(open_):
                    length[t, k] = level + float(mean_path(len(own)))
                    continue
                f = int(rng.choice(open_))
                at = rng.uniform(low[f], high[f])
                feature[t, k], split[t, k] = f, at
                right = own[:, f] > at
                stack += [(2 * k + 1, level + 1, own[~right]), (2 * k + 2, level + 1, own[right])]
        return cls(feature, split, length, m)

    def leaves(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """The nodes where rows end, tree by tree."""
        rows = np.arange(len(x))
        for feature, split in zip(self.feature, self.split, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                step = 2 * node + 1 + (x[rows, np.maximum(f, 0)] > split[node])
                node = np.where(inner, step, node)
            yield node

    def weighed(self, share: np.ndarray) -> IsolationForest:
        """The forest with path lengths by the share of all rows in each leaf, in place of the subsample's rows in it."""
        level = np.floor(np.log2(np.arange(self.feature.shape[1]) + 1))
        return IsolationForest(self.feature, self.split, np.where(self.feature < 0, level + mean_path(share * self.subsample), 0.0), self.subsample)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1]: 2 ** -(mean path / expected path); 0.5 is usual, near 1 is odd."""
        total = np.zeros(len(x))
        for length, node in zip(self.length, self.leaves(x), strict=True):
            total += length[node]
        return 2.0 ** -(total / len(self.feature) / max(1e-9, float(mean_path(self.subsample))))


@dataclass
class Calibration:
    """Robust scales of the ratios, the forest, and the score above which a document is rejected."""

    centre: np.ndarray
    scale: np.ndarray
    forest: IsolationForest
    threshold: float

    def scaled(self, ratios: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        """Deviations, damped for short documents, whose ratios scatter more."""
        trust = np.minimum(1, np.sqrt(n_words / FULL_TRUST_WORDS))
        return np.clip((ratios - self.centre) / self.scale * trust[:, None], -4, 4)

    def score(self, ratios: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        return self.forest.score(self.scaled(ratios, n_words))


def threshold_from_labels(score: np.ndarray, good: np.ndarray, max_good_lost: float = 0.005) -> float:
    """The threshold with the best balanced accuracy among those that reject at most max_good_lost of the good rows.

    Without rows of both labels nothing is rejected.
    """
    values, at = np.unique(score, return_inverse=True)
    return threshold_from_counts(values, np.bincount(at[good], minlength=len(values)), np.bincount(at[~good], minlength=len(values)), max_good_lost)


def threshold_from_counts(values: np.ndarray, ok: np.ndarray, bad: np.ndarray, max_good_lost: float = 0.005) -> float:
    """The same from ascending scores with their numbers of good and bad rows."""
    if not ok.sum() or not bad.sum():
        return float("inf")
    cuts = np.concatenate([(values[1:] + values[:-1]) / 2, [values[-1] + 1e-6]])
    lost, caught = 1 - np.cumsum(ok) / ok.sum(), 1 - np.cumsum(bad) / bad.sum()
    gain = np.where(lost <= max_good_lost, caught - lost, -1)
    return float(cuts[int(np.flatnonzero(gain == gain.max())[-1])])


def base_failed() -> F.Column:
    """Hard rules: under 50 words, or over half of the words in repeated 3-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quantiles(rows: DataFrame, share: float, n: int, columns: int, values: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The exact value of rank floor(share * (n - 1)) of each column of values, none of them negative.

    Such doubles ascend as their bits do, so each of four passes finds sixteen more bits
    of all columns: what reaches the driver are counts of bit patterns.
    """
    found, rank = np.zeros(columns, np.int64), np.full(columns, int(share * (n - 1)), np.int64)
    for shift in (48, 32, 16, 0):
        above = shift + 16

        def count(batches: Iterator[pa.RecordBatch], shift: int = shift, above: int = above, found: np.ndarray = found) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bits = (np.abs(values(batch)) + 0.0).view(np.int64)
                mine = np.ones(bits.shape, bool) if above == 64 else bits >> above == found
                key, k = np.unique((np.broadcast_to(np.arange(columns) << 16, bits.shape) + (bits >> shift & 0xFFFF))[mine], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(k.astype(np.int64))], ["key", "k"])

        got = rows.mapInArrow(count, "key long, k long").groupBy("key").agg(F.sum("k").alias("k")).toPandas().sort_values("key")
        key, k, digits = got["key"].to_numpy(np.int64), got["k"].to_numpy(np.int64), np.zeros(columns, np.int64)
        for c in range(columns):
            own = key >> 16 == c
            upto = np.cumsum(k[own])
            at = int(np.searchsorted(upto, rank[c], "right"))
            digits[c], rank[c] = key[own][at] & 0xFFFF, rank[c] - (upto[at - 1] if at else 0)
        found = found << 16 | digits
    return found.view(np.float64)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    ratios = batch.column("ratios")
    return ratios.flatten().to_numpy().reshape(len(ratios), len(RATIOS))


def calibrate(stats: DataFrame, labels: DataFrame, trees: int = 200, subsample: int = 64, seed: int = 7) -> Calibration | None:
    """Scales, forest and threshold from all labelled rows of stats (with_statistics); None if none of them passes the hard rules.

    Scales are order statistics of all labelled rows.  As the method has it, a tree's
    splits come from a small subsample of them; its path lengths are set by how many
    of all labelled rows end in each leaf.  The threshold comes from the scores of all.
    Of rows that repeat a doc_id the one of the least statistics counts.
    """
    row = F.min(F.struct(*COUNTS, "ratios")).alias("row")
    rows = stats.select("doc_id", *COUNTS, "ratios").join(usable_labels(labels, "quality"), "doc_id").groupBy("doc_id", "label").agg(row)
    rows = materialize(rows.select("doc_id", "label", "row.*").where(~base_failed()).select("doc_id", "label", "n_words", "ratios"), "rules")
    n = rows.count()
    if not n:
        release(rows)
        return None
    small_batches(stats.sparkSession)
    centre = quantiles(rows, 0.5, n, len(RATIOS), _matrix)
    scale = np.maximum(quantiles(rows, 0.75, n, len(RATIOS), lambda batch: _matrix(batch) - centre), 1e-3)
    out = Calibration(centre, scale, None, 0.0)  # type: ignore[arg-type]
    order, most = F.xxhash64("doc_id", F.lit(17)), trees * subsample
    drawn = rows.where(F.pmod(order, F.lit(1 << 40)) < int(min(1.0, 1.2 * most / n) * (1 << 40)))
    x = drawn.select(order.alias("order"), "doc_id", "n_words", "ratios").toPandas().sort_values(["order", "doc_id"], kind="stable")[:most]
    ratios = np.stack(x["ratios"].to_numpy()) if len(x) else np.zeros((0, len(RATIOS)))
    out.forest = IsolationForest.grow(out.scaled(ratios, x["n_words"].to_numpy(np.float64)), trees, subsample, seed)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(out.forest.feature.shape, np.int64)
        for batch in batches:
            for t, node in enumerate(out.forest.leaves(out.scaled(_matrix(batch), batch.column("n_words").to_numpy()))):
                total[t] += np.bincount(node, minlength=total.shape[1])
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total.ravel()[cell])], ["cell", "k"])

    held = rows.mapInArrow(leaves, "cell long, k long").groupBy("cell").agg(F.sum("k").alias("k")).toPandas()
    counts = np.zeros(out.forest.feature.size)
    counts[held["cell"].to_numpy(np.int64)] = held["k"].to_numpy()
    forest = out.forest.weighed(counts.reshape(out.forest.feature.shape) / n)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = forest.score(out.scaled(_matrix(batch), batch.column("n_words").to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array((s * SCORE_BINS).astype(np.int64)), batch.column("label")], ["bin", "label"])

    got = rows.mapInArrow(scores, "bin long, label int").groupBy("bin").agg(F.sum((F.col("label") == 1).cast("long")).alias("ok"), F.count(F.lit(1)).alias("k")).toPandas().sort_values("bin")
    release(rows)
    ok = got["ok"].to_numpy(np.int64)
    threshold = threshold_from_counts((got["bin"].to_numpy(np.float64) + 0.5) / SCORE_BINS, ok, got["k"].to_numpy(np.int64) - ok)
    return Calibration(centre, scale, forest, threshold)


def apply_rules(docs: DataFrame, labels: DataFrame, trees: int = 200, subsample: int = 64, seed: int = 7) -> DataFrame:
    """docs without text, with the counts, base_failed, anomaly (score) and kept.

    docs needs doc_id and text, labels doc_id and quality (1 good, 0 bad, null
    unused); other columns pass through unless a result has their name.  A null
    or empty text has no words and fails; an empty docs gives an empty result;
    without usable labels only the hard rules decide.  Rows that repeat a doc_id are
    judged each by its own text; texts of any length are read whole, once: their
    statistics are written as a work table.
    """
    stats = materialize(with_statistics(docs.drop("base_failed", "anomaly", "kept")), "statistics")
    model = calibrate(stats, labels, trees, subsample, seed)
    stats = stats.withColumn("base_failed", base_failed())
    if model is None:
        return stats.drop("ratios").withColumn("anomaly", F.lit(0.5)).withColumn("kept", ~F.col("base_failed"))

    @F.pandas_udf("double")
    def anomaly(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ratios, n_words in batches:
            yield pd.Series(model.score(np.stack(ratios.to_numpy()), n_words.to_numpy()) if len(ratios) else [], dtype="float64")

    scored = stats.withColumn("anomaly", anomaly("ratios", "n_words")).drop("ratios")
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= model.threshold))


__all__ = ["COUNTS", "RATIOS", "Calibration", "IsolationForest", "apply_rules", "base_failed", "calibrate", "mean_path", "quantiles", "threshold_from_counts", "threshold_from_labels"]
