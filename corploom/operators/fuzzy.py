"""Soft term lookup: words and terms meet on what is left of them when letters are deleted.

Two strings within d edits have a common remainder after at most d deletions from
each, and so have their first letters, if these are more than d: a pair that the alignment
takes across the end of one beginning costs that beginning as many deletions.  So
a vocabulary is indexed by the remainders of its terms' beginnings, a batch of words
is looked up in one join, and every pair that meets is measured once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LETTERS = 10  # of a term's beginning that are indexed: 56 remainders at most for two deletions


def _less_one(word: Column) -> Column:
    """word without each of its letters in turn, and word itself."""
    size = F.char_length(word)
    shorter = F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.concat(F.left(word, i - 1), F.substr(word, i + 1)))
    return F.array_distinct(F.concat(F.array(word), shorter))


def remainders(word: Column, distance: int = 2, letters: int = LETTERS) -> Column:
    """What at most distance deletions leave of a word's first letters."""
    if letters <= distance:
        raise ValueError("more letters than deletions are needed")
    out = F.array(F.left(word, F.lit(letters)))
    for _ in range(distance):
        out = F.array_distinct(F.flatten(F.transform(out, _less_one)))
    return out


def deletion_index(vocab: DataFrame, distance: int = 2, letters: int = LETTERS) -> DataFrame:
    """(remainder, term, df) of a vocabulary (term, df); write it once, by remainder, for many batches."""
    return vocab.select(F.explode(remainders(F.col("term"), distance, letters)).alias("remainder"), "term", "df")


def suggest_many(words: DataFrame, index: DataFrame, distance: int = 2, limit: int = 10, letters: int = LETTERS) -> DataFrame:
    """(word, nth, term, distance, df): for each different word (in lower case) the terms within so many edits, the nearest first, then the most frequent, then in order; at most limit a word (0: all)."""
    asked = words.select(F.lower("word").alias("word")).where("word IS NOT NULL").distinct()
    keys = asked.select("word", F.explode(remainders(F.col("word"), distance, letters)).alias("remainder"))
    met = keys.join(index, "remainder").select("word", "term", "df").distinct()
    near = met.withColumn("distance", F.levenshtein("word", "term", distance).cast("long")).where("distance >= 0")
    order = Window.partitionBy("word").orderBy("distance", F.desc("df"), "term")
    ranked = near.withColumn("nth", F.row_number().over(order).cast("long"))
    return (ranked.where(F.col("nth") <= limit) if limit else ranked).select("word", "nth", "term", "distance", "df")
