"""A searchable index that grows by batches.

Every batch becomes a segment, an index of its own new documents, in a folder that
names the batches it holds.  TIER neighbouring segments of a size class are merged into one, so
n batches leave about TIER * log(n) segments; a merged one is written whole before it
counts, and then stands for those that it holds.  An opened index numbers a segment's documents
behind those of the segments before it and adds up df: blocks move by one addition to their first
document and are never decoded.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corploom.operators import blocks as B
from corploom.operators import index as I
from corploom.operators.shared import exists
from corploom.streaming.ingest import ARRIVED, first_arrived

TIER = 4


@dataclass(frozen=True)
class Segment:
    folder: str
    first: int
    last: int


def _paths(spark: SparkSession, target: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/segments")  # noqa: SLF001
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    return [s.getPath().toString() for s in system.listStatus(path)] if system.exists(path) else []


def live(spark: SparkSession, target: str) -> list[Segment]:
    """The segments that count, in order: written whole, and not held by a larger one."""
    found = [Segment(p, int(m[1]), int(m[2])) for p in _paths(spark, target) if (m := re.search(r"/(\d+)-(\d+)$", p)) and exists(spark, f"{p}/meta/_SUCCESS")]
    return sorted((s for s in found if not any(o != s and o.first <= s.first and s.last <= o.last for o in found)), key=lambda s: s.first)


def _folder(target: str, first: int, last: int) -> str:
    return f"{target}/segments/{first:012}-{last:012}"


def _joined(spark: SparkSession, segments: list[Segment]) -> I.Index:
    """One index over segments, nothing of it written."""
    parts, base = [I.Index.open(spark, s.folder) for s in segments], 0
    forward, blocks = [], []
    for part in parts:
        moved = lambda c, base=base: (F.col(c) + base).alias(c)
        forward.append(part.forward.withColumn("docnum", moved("docnum")))
        own = [moved(c) if c in ("first", "last") else F.lit(None).cast("long").alias(c) if c == "prev" else F.col(c) for c in part.blocks.columns]
        blocks.append(part.blocks.select(*own))
        base += part.meta.first()["docs_count"]
    vocab = reduce(DataFrame.unionByName, [p.vocab.select("term", "df", "df_postings") for p in parts]).groupBy("term").agg(F.sum("df").alias("df"), F.sum("df_postings").alias("df_postings"))
    facts = reduce(DataFrame.unionByName, [p.meta.select("docs_count", "total_tokens", "text_bytes", "build_seconds") for p in parts])
    meta = facts.agg(*[F.sum(c).alias(c) for c in facts.columns])
    return I.Index(reduce(DataFrame.unionByName, forward), reduce(DataFrame.unionByName, blocks), vocab, meta)


def open_index(spark: SparkSession, target: str) -> I.Index:
    """The index as the batches so far have made it, for search.find and search.rank; nothing yet raises ValueError."""
    segments = live(spark, target)
    if not segments:
        raise ValueError(f"no segment in {target}")
    return _joined(spark, segments)


def merge(spark: SparkSession, target: str, segments: list[Segment]) -> Segment:
    """Neighbouring segments as one: their blocks, moved and sorted, and their sums; no text is read."""
    out, folder = _joined(spark, segments), _folder(target, segments[0].first, segments[-1].last)
    order = ["term", "zone", "first"]
    out.forward.write.mode("overwrite").parquet(f"{folder}/forward")
    out.blocks.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").options(**B.WRITE).parquet(f"{folder}/blocks")
    out.vocab.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/vocab")
    out.meta.coalesce(1).write.mode("overwrite").json(f"{folder}/meta")
    return Segment(folder, segments[0].first, segments[-1].last)


def compact(spark: SparkSession, target: str, tier: int = TIER) -> None:
    """Merge the newest tier segments while they are of one size class: batches held, to the base tier."""
    size = lambda s: len(_digits(s.last - s.first + 1, tier))
    while len(now := live(spark, target)) >= tier and len({size(s) for s in now[-tier:]}) == 1:
        merge(spark, target, now[-tier:])


def _digits(n: int, base: int) -> list[int]:
    out = []
    while n:
        n, d = divmod(n, base)
        out.append(d)
    return out


def grow(stream: DataFrame, target: str, checkpoint: str, tier: int = TIER) -> StreamingQuery:
    """Index each batch of raw rows (RAW, and ARRIVED where the source has it) as a segment.

    Of rows with one id the first to arrive is kept, in whichever batch; rows without
    one are dropped.  A batch that runs again writes its segment anew, or nothing if a
    merged one holds it.  A batch without new documents leaves no segment.
    """

    def segment(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        segments = live(spark, target)
        if any(s.first <= number <= s.last and s.first < s.last for s in segments):
            return
        first = first_arrived(batch)
        if others := [s for s in segments if (s.first, s.last) != (number, number)]:
            known = reduce(DataFrame.union, [spark.read.parquet(f"{s.folder}/forward").select("docid") for s in others])
            first = first.join(known, "docid", "left_anti")
        if first.limit(1).count():
            I.build(first, order=("docid",), folder=_folder(target, number, number))
            compact(spark, target, tier)

    return stream.writeStream.foreachBatch(segment).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


__all__ = ["ARRIVED", "Segment", "compact", "grow", "live", "merge", "open_index"]
