"""The inverted index: forward table, postings, vocabulary with block sizes and offsets, document lengths, metadata."""

from __future__ import annotations

import subprocess
import time
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corploom.functions import text as X
from corploom.sources.files import file_sha1

from . import blocks as B
from .corpus import number_rows
from .fuzzy import deletion_index
from .shared import exists, materialize, new_folder, release


@dataclass
class Index:
    """Tables of an index: forward (docnum, docid, title, n_tokens), blocks of positional postings, vocab (term, df, df_postings, offset, length), meta.

    Titles are a zone of the blocks; postings, vocab and lengths are those of the texts.
    """

    forward: DataFrame
    blocks: DataFrame
    vocab: DataFrame
    meta: DataFrame
    folder: str | None = None

    @property
    def postings(self) -> DataFrame:
        """(term, docnum) of the texts; a filter on term reaches the blocks' scan."""
        return B.entries(self.blocks.where(F.col("zone") == B.TEXT)).select("term", "docnum")

    def soft_terms(self, distance: int = 2) -> DataFrame:
        """The vocabulary by what deletions leave of its terms (fuzzy.deletion_index), written beside the index the first time that it is asked for."""
        spark = self.vocab.sparkSession
        if self.folder is None:
            return deletion_index(self.vocab, distance)
        path = f"{self.folder}/soft{distance}"
        if not exists(spark, f"{path}/_SUCCESS"):
            deletion_index(self.vocab, distance).repartitionByRange("remainder").sortWithinPartitions("remainder").write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    def save(self, folder: str) -> Index:
        """Write all tables to a folder of the caller's and return the index as read back.  build(folder=...) writes there at once."""
        if folder == self.folder:
            return self
        self.forward.write.mode("overwrite").parquet(f"{folder}/forward")
        order = ["term", "zone", "first"]
        sorted_ = self.blocks.repartitionByRange(*order).sortWithinPartitions(*order)
        sorted_.write.mode("overwrite").options(**B.WRITE).parquet(f"{folder}/blocks")
        self.vocab.write.mode("overwrite").parquet(f"{folder}/vocab")
        self.meta.write.mode("overwrite").json(f"{folder}/meta")
        return Index.open(self.forward.sparkSession, folder)

    @staticmethod
    def open(spark: SparkSession, folder: str) -> Index:
        read = spark.read.parquet
        return Index(read(f"{folder}/forward"), read(f"{folder}/blocks"), read(f"{folder}/vocab"), spark.read.json(f"{folder}/meta"), folder)


def number(corpus: DataFrame, *order: str, project: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """corpus with docnum, by the given order (default: part file and line, else docid)."""
    if not order:
        order = ("part_file", "block", "line_no") if "part_file" in corpus.columns else ("docid",)
    return number_rows(corpus, *order, project=project)


def stem_once(terms: DataFrame, stemmer: Callable[[Column], Column]) -> DataFrame:
    """terms with stems for terms, every distinct term stemmed once and joined back: for stemmers dearer than a shuffle of the postings."""
    stems = terms.select("term").distinct().withColumn("__stem", stemmer(F.col("term")))
    return terms.join(stems, "term").withColumn("term", F.col("__stem")).drop("__stem")


def _posted(terms: DataFrame, mode: str, stemmer: Callable[[Column], Column] | None) -> DataFrame:
    """Surface terms as they are indexed: the built-in stemmer is a few substrings and stays in line, any other is asked once a term."""
    if stemmer is X.stem:
        terms = terms.withColumn("term", X.stem(F.col("term")))
    elif stemmer is not None:
        terms = stem_once(terms, stemmer)
    # a token of the unicode tokenizer begins with a letter or a digit, and the built-in stemmer keeps beginnings
    return terms if mode == "unicode" and stemmer in (None, X.stem) else terms.where(X.has_alnum(F.col("term")))


def document_terms(numbered: DataFrame, mode: str = "unicode", stemmer: Callable[[Column], Column] | None = None, compose: bool = True) -> DataFrame:
    """(docnum, term) once for each distinct surface token, stemmed afterwards: forms that share a stem repeat it."""
    surface = F.explode(F.array_distinct(X.tokens(F.col("text"), mode, compose)))
    return _posted(numbered.select("docnum", surface.alias("term")), mode, stemmer)


def vocabulary(terms: DataFrame) -> DataFrame:
    """(term, df, df_postings): distinct documents, and postings with a stem's repeats."""
    per_doc = terms.groupBy("term", "docnum").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("df_postings"))


def block_table(postings: DataFrame) -> DataFrame:
    """Postings (term, docnum) as a written table of blocks."""
    held = materialize(postings, "postings")  # else the ranges' sample would make them once more
    out = materialize(B.cut_blocks(held), "blocks", **B.WRITE)
    release(held)
    return out


def gaps(postings: DataFrame) -> DataFrame:
    """(term, docnum, gap): distance to the term's posting before; of the first one the docnum itself."""
    return B.gaps(block_table(postings))


def block_sizes(postings: DataFrame) -> DataFrame:
    """(term, df, length): bytes of the delta-coded list, without building it."""
    return B.list_sizes(block_table(postings)).select("term", "df", "length")


def with_offsets(blocks: DataFrame) -> DataFrame:
    """blocks with offset: where a block starts when blocks stand in order of their terms.

    Range partitions sum locally; a partition's base comes from the totals of
    those before it, one row a partition.
    """
    n = max(1, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = materialize(blocks.repartitionByRange(n, "term").withColumn("__part", F.spark_partition_id()), "blocks")
    totals = placed.groupBy("__part").agg(F.sum("length").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    local = Window.partitionBy("__part").orderBy("term").rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(F.broadcast(base), "__part").withColumn("offset", (F.col("__base") + F.coalesce(F.sum("length").over(local), F.lit(0))).cast("long")).drop("__part", "__base")


def packed(postings: DataFrame) -> DataFrame:
    """(term, first, last, n, block): delta-coded blocks of at most blocks.BLOCK documents."""
    return B.packed(block_table(postings))


def _commit() -> str | None:
    """The commit that this package was built from, where it lies in a repository."""
    try:
        told = subprocess.run(["git", "rev-parse", "HEAD"], cwd=Path(__file__).parent, capture_output=True, text=True, timeout=10, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    return told.stdout.strip()


def _restemmed(postings: DataFrame, mode: str, stemmer: Callable[[Column], Column] | None) -> DataFrame:
    """Postings of surface terms as those of their stems: forms counts the different ones of a document."""
    if stemmer is None:
        return postings if mode == "unicode" else _posted(postings, mode, None)
    merged = F.array_sort(F.flatten(F.collect_list("places")))
    return _posted(postings, mode, stemmer).groupBy("term", "zone", "docnum").agg(F.sum("tf").cast("int").alias("tf"), F.sum("forms").cast("int").alias("forms"), merged.alias("places"))


def build(corpus: DataFrame, mode: str | Callable[[Column], Column] = "unicode", stemmer: Callable[[Column], Column] | None = None, sample: int = 0, compose: bool = True, order: tuple[str, ...] = (), folder: str | None = None) -> Index:
    """Index of a corpus (docid, title, text, order columns), written to folder (default: a work folder); sample N keeps the first N documents, 0 all.

    mode names a tokenizer, or is one: a function from a text Column to one of arrays
    of tokens.  Every text is tokenized once, into a work table that the other tables
    come from, and its tokens are shuffled once, as postings.
    meta tells the stemmer's name, the digests of the files that define index and tokens, and how long the build took.
    """
    spark, began = corpus.sparkSession, time.monotonic()
    folder = folder or new_folder(spark, "index")
    name = mode if isinstance(mode, str) else "own"
    toks = lambda c: X.tokens(F.col(c), mode, compose)
    tokenized = lambda df: df.select("docid", "title", toks("text").alias(B.TEXT), toks("title").alias("in_title"), F.octet_length("text").cast("long").alias("bytes"))
    if sample:  # the few are numbered before they are tokenized
        few = number(corpus, *order)
        work = number_rows(few.where(F.col("docnum") <= sample), "docnum", name="nth", project=tokenized)
        cut = work.withColumnRenamed("nth", "docnum")
        release(few)
    else:
        cut = work = number(corpus, *order, project=tokenized)
    cut.select("docnum", "docid", "title", F.size(B.TEXT).cast("long").alias("n_tokens"), "bytes").write.mode("overwrite").parquet(f"{folder}/forward")
    forward = spark.read.parquet(f"{folder}/forward")
    zoned = cut.select("docnum", B.TEXT, F.col("in_title").alias("title"))
    inverted = materialize(B.invert(zoned, (B.TEXT, "title")), "inverted")
    release(work)
    posted = _restemmed(inverted, name, stemmer)
    if stemmer is not None:
        posted = materialize(posted, "stemmed")  # else the ranges' sample would group them once more
    B.cut_blocks(posted).write.mode("overwrite").options(**B.WRITE).parquet(f"{folder}/blocks")
    release(inverted, posted)
    blocks = spark.read.parquet(f"{folder}/blocks")
    with_offsets(B.list_sizes(blocks)).select("term", "df", "df_postings", "offset", "length").write.mode("overwrite").parquet(f"{folder}/vocab")
    vocab = spark.read.parquet(f"{folder}/vocab")
    stats = forward.agg(F.count(F.lit(1)).alias("docs_count"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total_tokens"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("text_bytes"))
    text = lambda x: F.lit(x).cast("string")
    meta = stats.crossJoin(vocab.agg(F.count(F.lit(1)).alias("unique_terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("total_postings"))).withColumns({
        "created_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"), "sample": F.lit(sample or None).cast("long"), "stemmed": F.lit(stemmer is not None), "tokenizer": F.lit(name),
        "stemmer": text(getattr(stemmer, "__name__", None)), "build_sha1": text(file_sha1(__file__)), "tokenizer_sha1": text(file_sha1(X.__file__)), "commit": text(_commit()),
        "build_seconds": F.lit(time.monotonic() - began),
    })
    meta.coalesce(1).write.mode("overwrite").json(f"{folder}/meta")
    return Index.open(spark, folder)


def speed(ix: Index) -> DataFrame:
    """One row: documents, kilobytes of text, seconds of the build, seconds a document and a kilobyte."""
    kb = F.col("text_bytes") / 1024
    return ix.meta.select("docs_count", kb.alias("text_kb"), "build_seconds", F.try_divide("build_seconds", "docs_count").alias("seconds_per_document"), F.try_divide(F.col("build_seconds"), kb).alias("seconds_per_kb"))
