"""Consistency of an index with its corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corploom.functions import text as X

from .shared import materialize


def top_by_df(vocab: DataFrame, k: int = 10) -> DataFrame:
    return vocab.orderBy(F.desc("df"), "term").limit(k)


def verify(vocab: DataFrame, postings: DataFrame, numbered: DataFrame, top: int = 10, per_term: int = 100, stemmer: Callable[[Column], Column] | None = None, mode: str = "unicode", compose: bool = True) -> DataFrame:
    """(term, df, n_postings, checked, mismatches) of the top terms by df.

    A term's first per_term postings are checked against the documents' own tokens,
    in lower case or stemmed; the term counts in its lower case too.  A posting
    without a document is a mismatch.
    """
    rows = top_by_df(vocab, top).select("term", "df").collect()  # top rows; as an IN list they reach the scan of the postings
    few = vocab.sparkSession.createDataFrame(rows, vocab.select("term", "df").schema)
    held = postings.where(F.col("term").isin(*[r["term"] for r in rows])).join(F.broadcast(few), "term")
    first = materialize(held.withColumn("nth", F.row_number().over(Window.partitionBy("term").orderBy("docnum"))).where(F.col("nth") <= per_term), "checked")
    toks = X.tokens(F.col("text"), mode, compose)
    forms = F.transform(toks, stemmer if stemmer is not None else F.lower)
    # at most top * per_term documents are asked for, so they are broadcast and only their texts are cut
    asked = numbered.join(F.broadcast(first.select("docnum").distinct()), "docnum", "left_semi")
    texts = asked.select("docnum", F.array_distinct(forms).alias("forms"))
    seen = first.select("term", "df", "docnum").join(texts, "docnum", "left")
    good = F.coalesce(F.array_contains("forms", F.col("term")) | F.array_contains("forms", F.lower("term")), F.lit(False))
    checked = seen.groupBy("term", "df").agg(F.count(F.lit(1)).alias("checked"), F.count_if(~good).alias("mismatches"))
    sizes = held.groupBy("term").agg(F.count(F.lit(1)).alias("n_postings"))
    return checked.join(sizes, "term").select("term", "df", "n_postings", "checked", "mismatches")


def verify_all(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """One row: postings that no document supports, and document terms without a posting - both directions, whole tables."""
    own = terms.select("term", "docnum").distinct()
    stray = postings.join(own, ["term", "docnum"], "left_anti").agg(F.count(F.lit(1)).alias("unsupported"))
    lost = own.join(postings, ["term", "docnum"], "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    return stray.crossJoin(lost)
