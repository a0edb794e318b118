"""New documents become index segments as their files arrive."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corploom.functions import text as X
from corploom.sources.files import RAW

ARRIVED = "arrived"  # where a row of raw_stream comes from, in the order in which files are taken


def raw_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Rows of RAW and ARRIVED from files of any age, the oldest files first."""
    # by default the source passes over files a week older than the newest it has seen
    rows = spark.readStream.schema(RAW).option("maxFilesPerTrigger", max_files).option("maxFileAge", "36500d").json(folder)
    return rows.select("*", F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start").alias(ARRIVED))


def first_arrived(batch: DataFrame) -> DataFrame:
    """(docid, title, text), cleaned: of rows with one id the first to arrive; rows without an id are dropped."""
    arrived = [ARRIVED] if ARRIVED in batch.columns else []
    placed = batch.where("id <> ''").withColumn("place", F.struct(*arrived, F.monotonically_increasing_id()))
    first = placed.groupBy("id").agg(F.min_by(F.struct("title", "text"), "place").alias("row"))
    return first.select(F.col("id").alias("docid"), X.clean(F.col("row.title")).alias("title"), X.clean(F.col("row.text")).alias("text"))


def ingest(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append the terms of new documents to target/terms and their rows to target/documents.

    Of rows with one id the first to arrive is kept, however old the others are:
    a batch drops what other batches have written to target/documents, and its
    own repeats.  Rows without an id are dropped.  A segment is written under its
    batch number, so a batch that runs again replaces its own output.
    """

    def segment(batch: DataFrame, number: int) -> None:
        spark, rows = batch.sparkSession, first_arrived(batch)
        try:
            written = spark.read.schema("docid string, batch long").parquet(f"{target}/documents").where(F.col("batch") != number)
            rows = rows.join(written, "docid", "left_anti")
        except AnalysisException as missing:  # nothing is written yet
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
        rows.write.mode("overwrite").parquet(f"{target}/documents/batch={number}")
        own = spark.read.parquet(f"{target}/documents/batch={number}")
        terms = own.select("docid", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term"))
        terms.write.mode("overwrite").parquet(f"{target}/terms/batch={number}")

    return stream.writeStream.foreachBatch(segment).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
