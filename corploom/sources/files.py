"""File sources and sinks of the pipeline: JSON lines, tab-separated parts, vocabularies, query files."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW = T.StructType([T.StructField(n, T.LongType() if n == "bytes" else T.StringType()) for n in ("id", "title", "text", "source", "retrieved_at", "bytes")])
VOCAB = T.StructType([T.StructField("term", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("df", "offset", "length"))])
HEADER_IDS = ("id", "docid", "document_id")


PLACE = ["part_file", "block", "line_no"]  # where a line stands: order of lines over all files


def _lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """value and PLACE of every line."""
    reader = spark.read.schema("value string")
    lines = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    lines = lines.select("value", F.col("_metadata.file_name").alias("part_file"), F.col("_metadata.file_block_start").alias("block"))
    return lines.withColumn("line_no", F.monotonically_increasing_id())  # ascending within a file: its splits are read in order of their start


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of raw documents with their place; a malformed line stops the job, blank ones are skipped, missing fields are null."""
    lines = _lines(spark, path).where(F.trim("value") != "")
    parsed = F.from_json("value", RAW, {"mode": "FAILFAST"})
    return lines.select(parsed.alias("d"), (F.octet_length("value") + 1).cast("long").alias("line_bytes"), *PLACE).select("d.*", "line_bytes", *PLACE)


def read_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Corpus rows (part_file, line_no, docid, title, text) of part_*.tsv, or of write_parts' files, in file-name order.

    Short rows and rows whose id is a header word are skipped wherever they
    stand; later tabs stay in the text.
    """
    lines = _lines(spark, folder, "part{_*.tsv,-*.txt}")
    f = F.split("value", "\t", 3)
    rows = lines.where((F.col("value") != "") & (F.size(f) == 3)).select("part_file", "block", "line_no", f[0].alias("docid"), f[1].alias("title"), f[2].alias("text"))
    return rows.where(~F.lower("docid").isin(*HEADER_IDS))


def last_texts(parts: DataFrame) -> DataFrame:
    """(docid, text), of repeated ids the last row."""
    return parts.groupBy("docid").agg(F.max_by("text", F.struct("part_file", "block", "line_no")).alias("text"))


def write_parts(corpus: DataFrame, folder: str, rows: int = 1000) -> None:
    """Tab-separated files of at most rows rows (id, title, text), in order of input_no where corpus has it."""
    ordered = corpus.orderBy("input_no") if "input_no" in corpus.columns else corpus
    line = ordered.select(F.concat_ws("\t", "docid", "title", "text").alias("value"))
    line.write.mode("overwrite").option("maxRecordsPerFile", rows).text(folder)


def write_rejects(rejects: DataFrame, path: str) -> None:
    """Tab-separated lines (kind, docid, title) of what prepare turned down, in order of input."""
    rejects.orderBy("input_no").select(F.concat_ws("\t", "kind", "docid", "title").alias("value")).write.mode("overwrite").text(path)


def write_lines(df: DataFrame, path: str) -> None:
    """The columns of df, tab-separated, null as empty."""
    df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("value")).write.mode("overwrite").text(path)


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """Titles that a crawl has processed; a missing file has none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):  # noqa: SLF001
        return spark.createDataFrame([], "title string")
    return spark.read.text(path).select(F.trim("value").alias("title")).where("title <> ''")


def append_raw(docs: DataFrame, path: str) -> None:
    docs.write.mode("append").json(path)


def append_titles(titles: DataFrame, path: str) -> None:
    titles.select("title").write.mode("append").text(path)


def _tsv(spark: SparkSession, path: str):
    return spark.read.option("sep", "\t").option("quote", "").option("escape", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)


def read_vocab(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Vocabulary rows.  strict: four columns or the job stops; else rows without a whole df are skipped."""
    if strict:
        return _tsv(spark, path).schema(VOCAB).option("mode", "FAILFAST").csv(path)
    f = F.split("value", "\t")
    return spark.read.text(path).where(F.size(f) >= 2).select(f[0].alias("term"), F.expr("try_cast(split(value, '\t')[1] AS BIGINT)").alias("df")).where("df IS NOT NULL")


def write_vocab(vocab: DataFrame, path: str) -> None:
    vocab.select("term", "df", "offset", "length").write.mode("overwrite").option("sep", "\t").option("quote", "").csv(path)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """One query a line, stripped; blank lines are skipped, nothing is a comment."""
    return spark.read.text(path).select(F.trim("value").alias("q")).where("q <> ''")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Synonyms (a, b): tab-separated lines; shorter lines are skipped."""
    f = F.split("value", "\t")
    return spark.read.text(path).where(F.size(f) >= 2).select(F.trim(f[0]).alias("a"), F.trim(f[1]).alias("b")).where("a <> '' AND b <> ''")


def read_grades(spark: SparkSession, path: str) -> DataFrame:
    """Judged results (query_id, rank, grade, max_grade): tab-separated whole numbers."""
    return _tsv(spark, path).schema("query_id string, rank int, grade int, max_grade int").option("mode", "FAILFAST").csv(path)


def write_json_row(row: DataFrame, path: str) -> None:
    """A one-row table as a JSON file."""
    row.coalesce(1).write.mode("overwrite").json(path)


def file_sha1(path: str) -> str:
    """Provenance of a source file, on the driver."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha1").hexdigest()
