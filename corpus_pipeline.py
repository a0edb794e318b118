"""The corpus pipeline: stages that each apply one operator to all that the stage before kept.

Each stage takes (spark, docs, sf_dir), where docs has the columns of documents,
and returns a DataFrame; all but the last return those columns again.  Other columns
of docs are left out.  An empty table gives an empty one; null and empty texts, rows
without a doc_id and rows that repeat one are told at each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corploom.llm import bpe, linededup, mixing, ngram_join, queries, toxicity
from corploom.llm.work import materialize, release, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIX_SHARE = 0.9  # part of the tokens that the mixture keeps


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go; a null or empty text has nothing to reject, and rows are judged by their text alone, whatever their doc_id."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score(docs.select(*COLUMNS), labels).where("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in one document; texts and n_chars change.

    No row goes.  Null texts become empty; rows without a doc_id keep all their lines
    and count for no line; rows that share a doc_id are one document.
    """
    kept = linededup.dedup_lines(docs.select(*COLUMNS))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group whose five-word shingles are alike to 0.8 stays: that of the least doc_id.

    Rows are told apart by a key of their own, so contents alone decide: rows
    without a doc_id stay where no like row has one, and rows that share a doc_id
    form a group only if they are alike.  Of like rows with one doc_id the one of
    the least hash stays.  Texts without a word are like no other.
    """
    rows = materialize(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "rows")
    groups = ngram_join.jaccard_components(rows.select(F.col("row").alias("doc_id"), "text"), k=5, percent=80).select(F.col("doc_id").alias("row"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text", "lang", "source", "n_chars"), "row")
    ranked = rows.select("row", order.alias("at")).join(groups, "row")
    first = ranked.groupBy("component_id").agg(F.min("at").alias("at")).select("at.row")
    return rows.join(first, "row", "left_semi").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights, no document more than once.

    Null languages and sources are sources of their own; texts without words cost
    nothing; rows that share a doc_id stand or fall together.
    """
    chosen = mixing.choose(queries.with_domain(docs.select(*COLUMNS)), queries.MIX_LEVELS, queries.MIX_WEIGHTS, MIX_SHARE, 1, queries.MIX_SEED)
    return chosen.where("copies > 0").select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, one row a row, with the digest of the text that they decode to; null and empty texts have none."""
    path = queries.vocabulary_path()
    coded = bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), path)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", tokenize),
]
#: Toxicity and near duplicates aren't SQL; the stages are tested against brute-force versions instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to the documents table; between stages the documents are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scratch() as keep:  # a stage's work tables go once its result is written
            out = materialize(stage(spark, docs, sf_dir), "stage")
            keep(out)
        release(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
