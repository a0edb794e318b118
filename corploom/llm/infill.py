"""Fill-in-middle transformation: a text is cut into prefix, middle and suffix at unit ranks, and written with sentinels.

One automaton reads a text once and reports events: the ASCII characters where the
class of units changes, and sentinels that the text holds already.  Between two
events units are even, so their number is arithmetic on the gap's length; prefix
sums over the events alone tell where any unit begins.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkernel import chunks
from .work import small_batches

SENTINELS = ("<P>", "<S>", "<M>")  # of prefix, suffix and middle
RESULTS = ["n", "form", "prefix_chars", "middle_chars", "output"]


@dataclass(frozen=True)
class UnitRule:
    """What a unit is: each character of breaks (ASCII), and between them every width code points (None: all that lies between)."""

    breaks: str
    width: int | None

    def __post_init__(self) -> None:
        if not self.breaks.isascii() or (self.width is not None and self.width < 1):
            raise ValueError("breaks must be ASCII characters, width at least 1")


CODE_POINTS, WORDS, LINES = UnitRule("\n", 1), UnitRule(" \t\n\x0b\x0c\r", None), UnitRule("\n", None)


class EventScan:
    """Finds a rule's breaks and the sentinels of a text in one pass."""

    def __init__(self, rule: UnitRule, sentinels: tuple[str, ...]) -> None:
        self.automaton = ahocorasick.Automaton()
        for c in rule.breaks:
            self.automaton.add_word(c, False)
        for s in sentinels:
            self.automaton.add_word(s, True)
        self.automaton.make_automaton()

    def breaks(self, text: str) -> list[int] | None:
        """Where breaks stand; None if the text holds a sentinel."""
        at = []
        for end, is_sentinel in self.automaton.iter(text):
            if is_sentinel:
                return None
            at.append(end)
        return at


@lru_cache(maxsize=8)
def _scan(rule: UnitRule, sentinels: tuple[str, ...]) -> EventScan:
    return EventScan(rule, sentinels)


class Ranks:
    """Units of a text of so many code points, from its breaks alone."""

    def __init__(self, size: int, breaks: list[int], width: int | None) -> None:
        at = np.array(breaks, dtype=np.int64)
        self.width, self.start = width, np.concatenate([[0], at + 1])  # of the gaps
        self.size = np.concatenate([at, [size]]) - self.start
        own = self.size > 0 if width is None else -(-self.size // width)
        upto = np.cumsum(own + 1)  # the break behind a gap is a unit too
        self.before = np.concatenate([[0], upto[:-1]])
        self.total = int(upto[-1]) - 1

    def offset(self, k: int) -> int:
        """Code points of the first k units."""
        g = int(np.searchsorted(self.before, k, "right")) - 1
        left = k - int(self.before[g])
        inside = int(self.size[g]) if self.width is None else self.width * left
        return int(self.start[g]) + (min(inside, int(self.size[g])) if left else 0)


def draws(doc_id: object, seed: int) -> tuple[int, int, int, int]:
    """Four 32-bit draws of a document: the first digits of SHA-256 of ``seed:doc_id``."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def rearrange(text: str, doc_id: object, rule: UnitRule = CODE_POINTS, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> tuple[int, str, int | None, int | None, str]:
    """RESULTS of one text."""
    breaks = _scan(rule, sentinels).breaks(text)
    cuts, h = breaks, draws(doc_id, seed)
    if cuts is None:  # a sentinel ends the scan; the breaks alone are counted then
        cuts = _scan(rule, ()).breaks(text) if rule.breaks else []
    ranks = Ranks(len(text), cuts, rule.width)
    if breaks is None or not text or h[2] % 100 >= 100 - plain_percent:
        return ranks.total, "plain", None, None, text
    low, high = sorted((h[0] % (ranks.total + 1), h[1] % (ranks.total + 1)))
    a, b = ranks.offset(low), ranks.offset(high)
    p, s, m = sentinels
    if h[3] % 100 < spm_percent:
        return ranks.total, "spm", a, b - a, "".join((s, text[b:], p, text[:a], m, text[a:b]))
    return ranks.total, "psm", a, b - a, "".join((p, text[:a], s, text[b:], m, text[a:b]))


def transform(docs: DataFrame, rule: UnitRule = CODE_POINTS, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """docs without text, with n (units), form (plain, psm, spm), prefix_chars, middle_chars (code points, null where plain) and output.

    docs needs doc_id and text.  The draws depend on seed and doc_id alone, so rows
    that repeat a doc_id are cut by the same draws, and rows without one share
    those of the empty id.  Null texts count as empty; empty texts and texts that
    hold a sentinel stay plain; texts of any length are read whole.  Columns of
    docs with a result's name are replaced; an empty table gives an empty one.
    """
    if len(set(sentinels)) != 3 or "" in sentinels or any(a != b and a in b or any(a.endswith(b[:i]) for i in range(1, len(b))) for a in sentinels for b in sentinels):
        raise ValueError("three sentinels are needed that neither hold nor overlap each other")
    small_batches(docs.sparkSession)
    docs = docs.drop(*RESULTS)
    keep = [c for c in docs.columns if c != "text"]
    kinds = dict(zip(RESULTS, (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType()), strict=True))
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, k) for c, k in kinds.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            made = zip(*(rearrange(t or "", i, rule, seed, plain_percent, spm_percent, sentinels) for i, t in zip(ids, texts, strict=True)), strict=True)
            arrays = [pa.array(c, pa.string() if kinds[name] == T.StringType() else pa.int64()) for name, c in zip(RESULTS, made, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *arrays], schema.names)

    return docs.mapInArrow(run, schema)


def restore(df: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """df with restored: the exact text, from output and form alone.

    Outputs that aren't plain hold each sentinel once, since their texts hold none.
    """
    parts = F.split("output", "|".join(re.sub(r"([^\w])", r"\\\1", s) for s in sentinels), -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return df.withColumn("restored", F.when(F.col("form") == "plain", F.col("output")).when(F.col("form") == "psm", psm).otherwise(spm))
