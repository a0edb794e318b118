"""Synonyms: pairs of words, closed into classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, release

FEW = 10_000  # members of a query's classes that an IN list may hold


def close(pairs: DataFrame) -> DataFrame:
    """(word, class) of pairs (a, b): words that a chain of pairs joins, in either direction, share the least word of all as their class.

    Each round a word takes the least class among its neighbours' and its own, and
    then the class of that class, so chains halve; it ends when no class changes.
    Nulls pair with nothing; cycles and repeats don't matter.
    """
    both = pairs.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    edges = materialize(both.union(both.select("b", "a")).distinct(), "pairs")
    labels = materialize(edges.groupBy(F.col("a").alias("word")).agg(F.least(F.min("b"), F.first("a")).alias("class")), "classes")
    while True:
        near = edges.join(labels, edges["b"] == labels["word"]).groupBy(edges["a"].alias("word")).agg(F.min("class").alias("near"))
        step = labels.join(near, "word").select("word", F.least("class", "near").alias("class"))
        jumped = step.alias("x").join(labels.alias("y"), F.col("x.class") == F.col("y.word")).select("x.word", F.least("x.class", "y.class").alias("class"))
        new = materialize(jumped, "classes")
        changed = new.alias("n").join(labels.alias("o"), "word").where("n.class <> o.class").limit(1).count()
        release(labels)
        labels = new
        if not changed:
            release(edges)
            return labels


def classes_of(synonyms: DataFrame, words: set[str]) -> dict[str, list[str]]:
    """The members of each word's class, for the words that have one; a query's own words ask, and FEW members may answer."""
    own = synonyms.where(F.col("word").isin(*sorted(words))).select(F.col("word").alias("asked"), "class").distinct()
    rows = synonyms.join(F.broadcast(own), "class").select("asked", "word").limit(FEW + 1).collect()  # own: one row a word of the query
    if len(rows) > FEW:
        raise ValueError(f"the classes of {sorted(words)} have over {FEW} members")
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["asked"], []).append(r["word"])
    return out
