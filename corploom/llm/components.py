"""Connected components of an edge table, by joins; nothing is gathered on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import materialize, release, small_batches


FOREST_EDGES = 50_000  # edges of a partition that are joined at a time


def local_forests(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that join what edges joins, at most one for each node among FOREST_EDGES edges of a partition: dense groups shrink before they are shuffled."""
    small_batches(edges.sparkSession)

    def forest(a: list[int], b: list[int]) -> pa.RecordBatch:
        up: dict[int, int] = {}

        def find(i: int) -> int:
            while up.setdefault(i, i) != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for one, other in zip(a, b, strict=True):
            x, y = find(one), find(other)
            if x != y:
                up[max(x, y)] = min(x, y)
        pairs = [(find(i), i) for i in list(up)]
        pairs = [p for p in pairs if p[0] != p[1]]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for batch in batches:
            a += batch.column("a").to_pylist()
            b += batch.column("b").to_pylist()
            if len(a) >= FOREST_EDGES:
                yield forest(a, b)
                a, b = [], []
        if a:
            yield forest(a, b)

    return edges.mapInArrow(run, "a long, b long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (a, b): component is the least id reachable.

    Alternating large-star and small-star rounds: each node hooks its larger
    neighbours, then its smaller ones, onto the least id around it.  Every round
    ends in a written table; the edge count never grows, and the number of rounds
    is logarithmic in a component's size.  The rounds end when one leaves the edges
    as they were.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    e = materialize(local_forests(e).distinct(), "edges")
    seen = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a != b").distinct()
        # small star: the least neighbour of each larger end
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("x"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("y"))
        new = materialize(small.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a != b").distinct(), "edges")
        sums = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        release(e)
        e = new
        if sums == seen:
            break
        seen = sums
    return e.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component")).union(e.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
