"""Language ID: a byte convolutional network, trained and run in numpy.

Texts are cut into windows of fixed length that together cover the whole text.
Filters of several widths slide over a window's bytes; each filter's greatest
response is pooled, and a softmax layer turns the pooled responses into language
probabilities.  A filter over one-hot bytes is a sum of table rows, one table an
offset, so a convolution is a few gathers.  A text's probabilities are the mean
over its windows, weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .docstats import held_out
from .textkernel import LOWER, buffers, chunks
from .work import small_batches

SAMPLE_ROWS = 8_000  # labelled documents that training may see
WINDOW = 128  # bytes
WIDTHS = (2, 3, 4)
UNDETERMINED = "und"


def windows(data: np.ndarray, bounds: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the windows, their texts, their lengths): every byte is in one window; short ones are filled with spaces."""
    length = np.diff(bounds)
    count = -(-length // size)
    doc = np.repeat(np.arange(len(length)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = bounds[:-1][doc] + nth * size
    used = np.minimum(size, bounds[1:][doc] - start)
    spot = np.arange(size)
    out = np.full((len(doc), size), 32, dtype=np.uint8)
    inside = spot < used[:, None]
    out[inside] = LOWER[data[(start[:, None] + spot)[inside]]]
    return out, doc, used


@dataclass
class ByteConvNet:
    """tables[w][k]: response of width-w filters to a byte at offset k, shape (256, filters)."""

    classes: list[str]
    tables: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Greatest response of each filter (rectified) and where it stood."""
        best, spots = [], []
        for table in self.tables:
            width, span = len(table), x.shape[1] - len(table) + 1
            response = table[0][x[:, :span]]
            for k in range(1, width):
                response += table[k][x[:, k : k + span]]
            at = response.argmax(axis=1)
            spots.append(at)
            best.append(np.take_along_axis(response, at[:, None, :], axis=1)[:, 0])
        return np.maximum(np.concatenate(best, axis=1) + self.bias, 0), spots

    def _best(self, x: np.ndarray) -> np.ndarray:
        best = []
        for table in self.tables:
            span = x.shape[1] - len(table) + 1
            response = table[0][x[:, :span]]
            for k in range(1, len(table)):
                response += table[k][x[:, k : k + span]]
            best.append(response.max(axis=1))
        return np.maximum(np.concatenate(best, axis=1) + self.bias, 0)

    def probabilities(self, x: np.ndarray, block: int = 128) -> np.ndarray:
        out = np.zeros((len(x), len(self.classes)), dtype=np.float64)
        for at in range(0, len(x), block):
            out[at : at + block] = softmax(self._best(x[at : at + block]) @ self.dense + self.dense_bias)
        return out

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, classes: list[str], filters: int = 16, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 3) -> ByteConvNet:
        """Adam on cross-entropy; the gradient of a pooled response goes to the bytes under its best position."""
        rng = np.random.default_rng(seed)
        shape = [(w, 256, filters) for w in WIDTHS]
        net = cls(classes, [rng.normal(0, 0.3, s).astype(np.float32) for s in shape], np.zeros(filters * len(WIDTHS), np.float32), rng.normal(0, 0.1, (filters * len(WIDTHS), len(classes))).astype(np.float32), np.zeros(len(classes), np.float32))
        params = [*net.tables, net.bias, net.dense, net.dense_bias]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                hidden, spots = net.pooled(x[own])
                p = softmax(hidden @ net.dense + net.dense_bias)
                p[np.arange(len(own)), y[own]] -= 1
                p = (p / len(own)).astype(np.float32)
                back = (p @ net.dense.T) * (hidden > 0)
                grads = []
                for n, (table, spot) in enumerate(zip(net.tables, spots, strict=True)):
                    g, own_back = np.zeros_like(table), back[:, n * filters : (n + 1) * filters]
                    for k in range(len(table)):
                        byte = x[own][np.arange(len(own))[:, None], spot + k].astype(np.int64)
                        g[k] = np.bincount((byte * filters + np.arange(filters)).ravel(), weights=own_back.ravel(), minlength=256 * filters).reshape(256, filters)
                    grads.append(g)
                grads += [back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
                step += 1
                pace = rate * 0.5 * (1 + np.cos(np.pi * (epoch + at / len(order)) / epochs)) + 1e-4
                for q, g, a, b in zip(params, grads, first, second, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    q -= (pace * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return net


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, per_doc: int = 2, seed: int = 3) -> ByteConvNet | None:
    """Fit on windows of at most rows documents that have a language and aren't held out; None if there are none.

    The sample is chosen by ids, so its bound holds before any text moves; of each
    document per_doc windows are collected, of random lengths so that short texts
    are seen too.
    """
    able = docs.where(F.col("lang").isNotNull() & ~held_out() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    picked = able.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(rows).distinct()
    # of rows that repeat a doc_id one is taken, so the bound holds for rows too
    sample = able.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("row")).select("doc_id", "row.text", "row.lang")
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            data, bounds = buffers(batch.column("text"))
            ids, langs, taken = batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), []
            for d, (i, lang) in enumerate(zip(ids, langs, strict=True)):
                rng = np.random.default_rng(abs(i) + seed)
                for n in range(per_doc):
                    size = WINDOW if n == 0 else int(rng.integers(12, WINDOW))
                    start = int(bounds[d] + rng.integers(0, max(1, bounds[d + 1] - bounds[d] - size)))
                    taken.append((i, n, lang, data[start : min(start + size, bounds[d + 1])].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*taken, strict=True)], ["doc_id", "n", "lang", "window"])

    got = sample.mapInArrow(cut, "doc_id long, n long, lang string, window binary").toPandas().sort_values(["doc_id", "n", "lang"], kind="stable")
    if not len(got):
        return None
    classes = sorted(got["lang"].unique())
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in got["window"]])])
    x, _, _ = windows(np.frombuffer(b"".join(got["window"]), dtype=np.uint8), bounds)
    return ByteConvNet.fit(x, np.array([classes.index(v) for v in got["lang"]]), classes, seed=seed)


def identify(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs without text, with held_out, lang_pred and score (the predicted language's probability).

    docs needs doc_id, text and lang; lang teaches, and never enters a prediction.
    A null text, or one without a letter, is ``und`` with score 0; so is every
    text where nothing can be learned.  Columns with a result's name are replaced.
    Rows that repeat a doc_id are told each by its own text; of a text of any length
    all windows are read; an empty docs gives an empty result.
    """
    spark, net = docs.sparkSession, train(docs, rows)
    small_batches(spark)
    docs = docs.drop("held_out", "lang_pred", "score").withColumn("__letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    keep = [c for c in docs.columns if c != "text"]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("__pred", T.StringType()), T.StructField("__p", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            data, bounds = buffers(batch.column("text"))
            pred, p = np.full(batch.num_rows, None, dtype=object), np.zeros(batch.num_rows)
            if net is not None:
                x, doc, used = windows(data, bounds)
                each = net.probabilities(x) * used[:, None]
                mean = np.stack([np.bincount(doc, weights=each[:, c], minlength=batch.num_rows) for c in range(len(net.classes))], axis=1) / np.maximum(1, np.diff(bounds))[:, None]
                pred, p = np.array(net.classes, dtype=object)[mean.argmax(axis=1)], np.clip(mean.max(axis=1), 0, 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(pred, pa.string()), pa.array(p)], schema.names)

    known = F.col("__letters") & F.col("__pred").isNotNull()
    out = docs.mapInArrow(run, schema).withColumn("lang_pred", F.when(known, F.col("__pred")).otherwise(UNDETERMINED)).withColumn("score", F.when(known, F.col("__p")).otherwise(0.0))
    return out.withColumn("held_out", held_out()).drop("__letters", "__pred", "__p")


__all__ = ["ByteConvNet", "identify", "train", "windows"]
