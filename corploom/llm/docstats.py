"""Statistics of whole documents, computed from bytes in numpy, for rules and classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkernel import ODD, buffers, chunks, mix, words
from .work import small_batches

SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Ratios, all independent of a document's length in expectation.
RATIOS = [
    "word_length", "word_length_spread", "symbols_per_word", "dup_line_share", "repeat_share", "distinct_share", "twin_share", "short_word_share",
    "long_word_share", "upper_share", "digit_share", "punct_share", "pipe_share", "bang_share", "ascii_share", "capital_word_share",
]


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[list(members)] = 1
    return out


_CLASS = {
    "symbol": _table(SYMBOLS), "upper": _table(bytes(range(65, 91))), "digit": _table(bytes(range(48, 58))), "punct": _table(b".,;:?\"'()-"),
    "pipe": _table(b"|"), "bang": _table(b"!"), "ascii": _table(bytes(range(128))),
    "lead": np.array([(b & 0xC0) != 0x80 for b in range(256)], dtype=np.int64),
}


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between bounds; a range may be empty."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _per_word(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n)


def _repeated(h: np.ndarray, doc: np.ndarray, width: int = 3) -> np.ndarray:
    """Flags of the words that lie in a window of width words found twice or more in their text."""
    flags = np.zeros(len(h), dtype=bool)
    m = len(h) - width + 1
    if m < 2:
        return flags
    acc = doc[:m].astype(np.uint64) * ODD[40]
    for j in range(width):
        acc = acc + h[j : m + j] * ODD[j]
    whole = np.flatnonzero(doc[:m] == doc[width - 1 :])
    key = mix(acc[whole])
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    for j in range(width):
        flags[whole[twice] + j] = True
    return flags


def _dup_lines(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    raw, out = data.tobytes(), np.zeros(len(bounds) - 1, dtype=np.int64)
    for d in range(len(out)):
        lines = [x for x in raw[bounds[d] : bounds[d + 1]].split(b"\n") if x and not x.isspace()]
        out[d] = len(lines) - len(set(lines))
    return out


def statistics(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(counts as in COUNTS, ratios as in RATIOS), a row for each text; null and empty texts give zeros."""
    data, bounds = buffers(column)
    n = len(bounds) - 1
    w = words(data, bounds)
    h, doc, lead = w.hashes(), w.doc, _CLASS["lead"]
    chars = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(lead[data], out=chars[1:])
    size = chars[w.end] - chars[w.start]
    n_words, word_chars = np.diff(w.first), _per_word(size, doc, n)
    n_chars = np.maximum(1, _sums(lead[data], bounds))
    share = {k: _sums(t[data], bounds) for k, t in _CLASS.items() if k != "lead"}
    dup_lines = _dup_lines(data, bounds)
    repeats = _per_word(_repeated(h, doc), doc, n)
    key = mix(h + doc.astype(np.uint64) * ODD[41])
    order = np.argsort(key, kind="stable")
    first_seen = np.ones(len(h), dtype=bool)
    first_seen[order[1:]] = key[order][1:] != key[order][:-1]
    distinct = _per_word(first_seen, doc, n)
    twin = np.zeros(len(h), dtype=bool)
    if len(h) > 1:
        twin[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    some, lines = np.maximum(1, n_words), _sums((data == 10).astype(np.int64), bounds) + 1
    mean = word_chars / some
    spread = np.sqrt(np.maximum(0, _per_word(size.astype(np.float64) ** 2, doc, n) / some - mean**2))
    capital = (data[w.start] >= 65) & (data[w.start] <= 90) if len(h) else np.zeros(0, bool)
    counts = np.stack([n_words, word_chars, share["symbol"], dup_lines, repeats], axis=1).astype(np.int64)
    ratios = np.stack([
        mean, spread, share["symbol"] / some, dup_lines / lines, repeats / some, distinct / some, _per_word(twin, doc, n) / some,
        _per_word(size <= 3, doc, n) / some, _per_word(size >= 12, doc, n) / some, share["upper"] / n_chars, share["digit"] / n_chars, share["punct"] / n_chars,
        share["pipe"] / some, share["bang"] / some, share["ascii"] / np.maximum(1, np.diff(bounds)), _per_word(capital, doc, n) / some,
    ], axis=1)
    return counts, ratios


def with_statistics(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of df (all but text) with the counts and an array column ``ratios``."""
    small_batches(df.sparkSession)
    keep = [c for c in (keep if keep is not None else df.columns) if c != text and c not in (*COUNTS, "ratios")]
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("ratios", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            counts, ratios = statistics(batch.column(text))
            bounds = pa.array(np.arange(len(ratios) + 1, dtype=np.int32) * len(RATIOS))
            arrays = [*(batch.column(c) for c in keep), *(pa.array(counts[:, k]) for k in range(len(COUNTS))), pa.ListArray.from_arrays(bounds, pa.array(ratios.reshape(-1)))]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return df.select(*keep, text).mapInArrow(run, schema)


def usable_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of each doc_id whose labels agree; null ones don't count."""
    one = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("__most"))
    return one.where(F.col("label") == F.col("__most")).select("doc_id", F.col("label").cast("int").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, seed: int = 17) -> DataFrame:
    """(doc_id, text, label) of at most bound labelled documents, the same ones at every run.

    The sample is of labels, taken by the least hash of doc_id, so its size is
    bounded whatever the tables' sizes, and it is what is broadcast.  Of rows that
    repeat a doc_id the one of the least text is taken.  Labels that are null or
    that disagree for one doc_id aren't used.
    """
    picked = usable_labels(labels, label).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(bound)
    held = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return held.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))


def held_out(doc_id: str = "doc_id"):
    """Rows that no model may learn from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
