"""Work tables in the cluster's shared folder, and the shape of Python batches.

Long jobs cut their lineage by writing Parquet into the application's folder (see
``corploom.operators.shared``): every executor and the driver can read it, so a lost
executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from corploom.operators.shared import materialize, release, scratch
from corploom.shipping import ship

__all__ = ["materialize", "parallelism", "release", "scratch", "small_batches"]


BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20  # of an Arrow batch that a Python worker gets


def small_batches(spark: SparkSession) -> None:
    """Ready Python workers: they can import this package, and their Arrow batches are bounded in rows and in bytes (long texts).

    Results are lazy, so the bounds must hold when the caller runs them: the session's
    settings are lowered where they are wider, and never raised.
    """
    ship(spark)
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    held = int(spark.conf.get(rows))
    if not 0 < held <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    bound = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size))  # noqa: SLF001
    if not 0 < bound <= BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))


def parallelism(spark: SparkSession) -> int:
    """Partitions to deal rows to by an explicit key."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
