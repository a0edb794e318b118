"""Blocked, positional postings.

Postings (term, zone, docnum, tf, places) are dealt by ranges of (term, zone, docnum), so a
term that most documents hold lies in many partitions; each partition streams
through its sorted rows and cuts them into blocks of at most BLOCK documents:

* ``term, zone, first, last, n`` - what a skip needs: whose block it is, and from which document to which;
* ``max_tf`` - the most that a document of the block can gain in ranking;
* ``docs`` (distances from first), ``tfs``, ``places`` (positions of each posting) - arrays that Parquet
  keeps as deltas and Spark explodes without leaving the JVM;
* ``gap_bytes, prev`` - for the sizes of delta-coded lists.  The document before a
  partition's first block is carried over from the partition before: one row a partition.

No step runs over all postings of one term in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corploom.functions import varint
from corploom.shipping import ship

BLOCK = 128
TEXT = "text"
POSTINGS = "term string, zone string, docnum long, tf int, forms int, places array<int>"
BLOCKS = "part int, nth int, term string, zone string, first long, last long, n int, prev long, gap_bytes long, forms long, max_tf int, docs array<long>, tfs array<int>, places array<array<int>>"
#: Whole numbers are written as deltas, bit-packed.
WRITE = {"parquet.writer.version": "PARQUET_2_0"}
_KEY = ["term", "zone", "docnum"]


def invert(tokens: DataFrame, zones: Sequence[str] = (TEXT,)) -> DataFrame:
    """POSTINGS of rows (docnum, and an array of tokens for each zone): a batch at a time, one row a document, zone and term."""
    ship(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docnum = batch.column("docnum").to_numpy(zero_copy_only=False)
            for zone in zones:
                column = batch.column(zone)
                counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                coded = column.flatten().dictionary_encode()
                if not len(coded):
                    continue
                code, doc = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(counts)), counts)
                place = np.arange(len(code)) - np.repeat(np.cumsum(counts) - counts, counts)
                key = doc * len(coded.dictionary) + code
                order = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.diff(key[order], prepend=-1))
                bounds = np.append(first, len(order))
                one = pa.array(np.ones(len(first), np.int32))
                yield pa.RecordBatch.from_arrays([
                    coded.dictionary.take(pa.array(code[order][first])).cast(pa.string()), pa.array([zone] * len(first), pa.string()), pa.array(docnum[doc[order][first]], pa.int64()),
                    pa.array(np.diff(bounds).astype(np.int32)), one, pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(place[order].astype(np.int32))),
                ], ["term", "zone", "docnum", "tf", "forms", "places"])

    return tokens.select("docnum", *zones).mapInArrow(run, POSTINGS)


def _list(bounds: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)


def _varint_size(n: np.ndarray) -> np.ndarray:
    out = np.ones(len(n), np.int64)
    for groups in range(1, 9):
        out += n >= 1 << (7 * groups)
    return out


def _cut(table: pa.RecordBatch, starts: np.ndarray, part: int, nth: int, before: tuple | None) -> pa.RecordBatch:
    """Blocks of sorted postings that begin at starts; before: key and last document of the block before, None for a partition's first."""
    docnum = table.column("docnum").to_numpy(zero_copy_only=False)
    ends = np.append(starts[1:], table.num_rows)
    bounds, first, last = np.append(starts, table.num_rows), docnum[starts], docnum[ends - 1]
    gaps = np.diff(docnum, prepend=docnum[:1])
    sizes = _varint_size(gaps)
    sizes[starts] = 0
    at = pa.array(starts)
    terms, zones = table.column("term").take(at), table.column("zone").take(at)
    keys = list(zip(terms.to_pylist(), zones.to_pylist(), strict=True))
    known = [before, *zip(keys[:-1], last[:-1].tolist(), strict=True)]
    prev = [None if b is None else b[1] if b[0] == k else 0 for b, k in zip(known, keys, strict=True)]
    tf, forms, places = table.column("tf"), table.column("forms").to_numpy(zero_copy_only=False), table.column("places")
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(len(starts), part, np.int32)), pa.array(np.arange(nth, nth + len(starts), dtype=np.int32)), terms, zones, pa.array(first), pa.array(last), pa.array((ends - starts).astype(np.int32)),
        pa.array(prev, pa.int64()), pa.array(np.add.reduceat(sizes, starts)), pa.array(np.add.reduceat(forms.astype(np.int64), starts)), pa.array(np.maximum.reduceat(tf.to_numpy(zero_copy_only=False), starts)),
        _list(bounds, pa.array(docnum - np.repeat(first, ends - starts))), _list(bounds, tf), _list(bounds, places),
    ], [f.split()[0] for f in BLOCKS.split(", ")])


def cut_blocks(postings: DataFrame, size: int = BLOCK) -> DataFrame:
    """BLOCKS of POSTINGS, in files that ascend by (term, zone, first) once written.  Repeated postings stay, with a gap of 0.

    What is missing of zone, tf, forms and places is the text zone, 1, 1 and none.
    """
    ship(postings.sparkSession)
    given = {"zone": F.lit(TEXT), "tf": F.lit(1), "forms": F.lit(1), "places": F.array().cast("array<int>")}
    rows = postings.withColumns({c: v for c, v in given.items() if c not in postings.columns}).select("term", "zone", F.col("docnum").cast("long"), F.col("tf").cast("int"), F.col("forms").cast("int"), "places")
    n = max(1, int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, before, held = TaskContext.get().partitionId(), 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            codes = [table.column(c).dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in ("term", "zone")]
            new = np.zeros(table.num_rows, dtype=bool)
            new[0] = True
            for c in codes:
                new[1:] |= c[1:] != c[:-1]
            begins = np.flatnonzero(new)
            place = np.arange(table.num_rows) - np.repeat(begins, np.diff(np.append(begins, table.num_rows)))
            starts = np.flatnonzero(place % size == 0)
            if len(starts) > 1:  # the last block may go on in the next batch
                out = _cut(table.slice(0, starts[-1]), starts[:-1], part, nth, before)
                yield out
                nth, before = nth + len(starts) - 1, ((out.column("term")[-1].as_py(), out.column("zone")[-1].as_py()), out.column("last")[-1].as_py())
            held = table.slice(starts[-1])
        if held is not None:
            yield _cut(held, np.zeros(1, np.int64), part, nth, before)

    return rows.repartitionByRange(n, *_KEY).sortWithinPartitions(*_KEY).mapInArrow(run, BLOCKS)


def with_prev(blocks: DataFrame) -> DataFrame:
    """blocks (written ones) with prev everywhere: the term's last document before the block, 0 if there is none."""
    ends = blocks.groupBy("part").agg(F.min_by(F.struct("term", "zone"), "nth").alias("head"), F.max_by(F.struct("term", "zone", "last"), "nth").alias("tail"))  # a row a partition
    tail = F.lag("tail").over(Window.orderBy("part"))
    same = (tail["term"] == F.col("head.term")) & (tail["zone"] == F.col("head.zone"))
    carry = ends.select("part", F.when(same, tail["last"]).otherwise(0).alias("__carried"))
    return blocks.join(F.broadcast(carry), "part").withColumn("prev", F.coalesce("prev", "__carried")).drop("__carried")


def entries(blocks: DataFrame, *columns: str) -> DataFrame:
    """A row a posting: term, zone, docnum, and of tfs and places those that are asked for.  Filters on term and zone reach the scan of blocks."""
    parts = F.explode(F.arrays_zip("docs", *columns)).alias("e")
    rows = blocks.select("term", "zone", "first", parts)
    named = {"tfs": "tf", "places": "places"}
    return rows.select("term", "zone", (F.col("first") + F.col("e.docs")).alias("docnum"), *[F.col(f"e.{c}").alias(named[c]) for c in columns])


def gaps(blocks: DataFrame, zone: str = TEXT) -> DataFrame:
    """(term, docnum, gap) of a zone of written blocks: distance to the term's posting before; of the first one the docnum itself."""
    zero = F.lit(0).cast("long")
    steps = F.transform("docs", lambda d, i: F.struct(d.alias("d"), F.when(i == 0, F.col("first") - F.col("prev")).otherwise(d - F.coalesce(F.get("docs", i - 1), zero)).alias("gap")))
    rows = with_prev(blocks).where(F.col("zone") == zone).select("term", "first", "prev", "docs").select("term", "first", F.explode(steps).alias("s"))
    return rows.select("term", (F.col("first") + F.col("s.d")).alias("docnum"), "s.gap")


def list_sizes(blocks: DataFrame, zone: str = TEXT) -> DataFrame:
    """(term, df, df_postings, length) of a zone of written blocks: length is the bytes of the whole list as one delta-coded block, from the blocks' own sums."""
    whole = with_prev(blocks).where(F.col("zone") == zone).groupBy("term").agg(F.sum("n").alias("df"), F.sum("forms").alias("df_postings"), F.sum(F.col("gap_bytes") + varint.size(F.col("first") - F.col("prev"))).alias("bytes"))
    return whole.select("term", "df", "df_postings", (varint.size(F.col("df")) + F.col("bytes")).alias("length"))


def packed(blocks: DataFrame) -> DataFrame:
    """(term, first, last, n, block): each block delta-coded as bytes, first document included; at most BLOCK documents each."""
    return blocks.select("term", "first", "last", "n", varint.encode_block(F.transform("docs", lambda d: F.col("first") + d)).alias("block"))


def density(blocks: DataFrame) -> DataFrame:
    """(band, terms, postings, bytes, bytes_per_posting) of rare (df up to BLOCK), middling (up to BLOCK squared) and frequent terms, delta-coded."""
    band = F.when(F.col("df") <= BLOCK, "rare").when(F.col("df") <= BLOCK * BLOCK, "middling").otherwise("frequent")
    sums = list_sizes(blocks).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("terms"), F.sum("df").alias("postings"), F.sum("length").alias("bytes"))
    return sums.withColumn("bytes_per_posting", F.col("bytes") / F.col("postings"))
