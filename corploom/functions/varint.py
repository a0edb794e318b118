"""LEB128 integers and delta-coded posting blocks.

Sizes, gaps and encoding are expressions; decoding a block back is a vectorised
UDF, for readers of packed files only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from corploom.shipping import ship


def size(n: Column) -> Column:
    """Bytes of a non-negative integer: one for every seven bits."""
    out = F.lit(9)
    for groups in range(8, 0, -1):
        out = F.when(n < 1 << (7 * groups), groups).otherwise(out)
    return out.cast("long")


def encode(n: Column) -> Column:
    """Low seven bits first, the high bit set on all bytes but the last."""
    return F.unhex(_hex(n))


def _hex(n: Column) -> Column:
    """The bytes of encode as hex digits, spelt out byte by byte: a lambda in here would be nested within encode_block's, and a UDF over nested lambdas isn't evaluated."""
    out = []
    for k in range(9):
        low = F.shiftright(n, 7 * k).bitwiseAND(F.lit(127).cast("long"))
        byte = low if k == 8 else F.when(n >= 1 << (7 * (k + 1)), low.bitwiseOR(F.lit(128).cast("long"))).otherwise(low)
        digits = F.lpad(F.hex(byte), 2, "0")
        out.append(F.when(n >= 1 << (7 * k), digits).otherwise("") if k else digits)
    return F.concat(*out)


def encode_block(docnums: Column) -> Column:
    """Count, then the gaps of ascending docnums; the first gap is the first docnum."""
    gaps = F.transform(docnums, lambda d, i: d - F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(docnums, i - 1)))
    return F.unhex(F.array_join(F.transform(F.concat(F.array(F.size(docnums).cast("long")), gaps), _hex), ""))


def decode_array(block: bytes) -> np.ndarray:
    """All integers of a byte string; EOFError if the last one is cut short."""
    raw = np.frombuffer(block, dtype=np.uint8)
    ends = np.flatnonzero(raw < 128)
    if len(raw) and (not len(ends) or ends[-1] != len(raw) - 1):
        raise EOFError("truncated integer")
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts) if len(ends) else np.zeros(0, np.int64)


def decode_postings(block: bytes) -> np.ndarray:
    """Docnums of a block."""
    values = decode_array(block)
    if not len(values):
        raise EOFError("empty block")
    if len(values) <= values[0]:
        raise EOFError("fewer gaps than counted")
    return np.cumsum(values[1 : 1 + values[0]])


def decode_block(block: Column) -> Column:
    """array<bigint> of the docnums of a packed block.  As with any UDF, block may not hold a lambda within a lambda; encode_block's don't."""
    if (spark := SparkSession.getActiveSession()) is not None:
        ship(spark)

    @F.pandas_udf("array<bigint>")
    def unpack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(decode_postings, na_action="ignore")

    return unpack(block)
