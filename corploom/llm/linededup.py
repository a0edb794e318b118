"""Line dedup: drop lines that several documents repeat, keep them in one.

The path is DataFrame operations only.

1. Every line that is long enough becomes ``(key, doc_id, pos)``; the key is 16
   bytes of SHA-256 of the normalised line, so the text itself is not shuffled.
2. These rows are range-partitioned by ``(key, doc_id)`` and sorted within the
   partition by key, document and position.  Ranges are cut on
   the pair, so the rows of one very frequent line lie in as many partitions as
   its share asks for.  Each partition streams through its sorted rows, lets the
   first occurrence in each document pass, and folds those into a count and the
   largest document; these partial results (one per key and partition) are
   merged by key.
3. Occurrences outside the keeping document become one bitmap per document,
   compressed as runs of dropped lines; only bitmaps come back, never text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import materialize, parallelism

STRIPPED = " \t\n\x0b\x0c\r"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else; all-ASCII texts take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UP, _LOW))


def line_keys(text: Column) -> Column:
    """The normalised lines of a text, in order (null: one empty line)."""
    lines = F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n", -1)
    return F.transform(lines, lambda x: F.btrim(x, F.lit(STRIPPED)))


def _digest(key: Column) -> Column:
    return F.unhex(F.substring(F.sha2(key, 256), 1, 32))


def occurrences(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """(key, doc_id, pos) of every line whose key has at least min_chars code points."""
    lines = docs.select(F.col("doc_id").alias("doc_id"), F.posexplode(line_keys(F.col("text"))).alias("pos", "line"))
    return lines.where(F.char_length("line") >= min_chars).select(_digest(F.col("line")).alias("key"), "doc_id", "pos")


def keepers(occ: DataFrame, min_docs: int = 3) -> DataFrame:
    """(key, keeper): keys of at least min_docs documents, with the largest doc_id that holds them."""
    n = parallelism(occ.sparkSession)
    ranged = occ.repartitionByRange(n, F.col("key"), F.col("doc_id"))
    # the ranges satisfy the window's clustering, so this streams the sorted partition without another exchange
    stream = Window.partitionBy("key", "doc_id").orderBy("pos")
    firsts = ranged.withColumn("nth", F.row_number().over(stream)).where(F.col("nth") == 1)
    return firsts.groupBy("key").agg(F.max("doc_id").alias("keeper"), F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs).select("key", "keeper")


def _with_runs(per_doc: DataFrame) -> DataFrame:
    """per_doc (dropped: ascending positions) with bitmap: runs [gap, length, gap, length, ...]; the gap counts kept lines before a run.

    First the places in dropped where a run starts, then each run from its start and
    the next one's: two passes, whatever the number of runs.
    """
    n = F.size("dropped")
    before = lambda i: F.get("dropped", i - 1) + 1
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("dropped", i) != before(i)))
    gap = lambda s: F.get("dropped", s) - F.when(s == 0, F.lit(0)).otherwise(before(s))
    run = F.transform("__starts", lambda s, k: F.array(gap(s), F.coalesce(F.get("__starts", k + 1), n) - s))
    return per_doc.withColumn("__starts", starts).withColumn("bitmap", F.flatten(run)).drop("__starts")


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, n_dropped, bitmap) of the documents that lose lines.

    docs needs doc_id and text; other columns are ignored.  doc_id names a
    document: rows that share one count once.  bitmap is an array of run lengths,
    kept and dropped lines by turns.  Rows with a null doc_id keep all lines.
    """
    occ = materialize(occurrences(docs.where(F.col("doc_id").isNotNull()), min_chars), "lines")
    # a written table, so that both sides of the join are plain exchanges: the adaptive skew join can then split a line of a third of all documents
    kept = materialize(keepers(occ, min_docs), "keepers")
    lost = occ.join(kept, "key").where(F.col("doc_id") != F.col("keeper"))
    per_doc = lost.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.col("pos").cast("int"))).alias("dropped"))
    return _with_runs(per_doc).select("doc_id", F.size("dropped").cast("long").alias("n_dropped"), "bitmap")


def _flags(bitmap: Column) -> Column:
    """The bitmap spelt out, one boolean a line up to the last dropped one: true is dropped."""
    runs = F.transform(bitmap, lambda n, i: F.array_repeat(i % 2 == 1, n))
    return F.flatten(runs)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with kept_text, n_lines and n_dropped in place of text."""
    taken = docs.columns
    marks = bitmaps.select(F.col("doc_id").alias("__doc"), F.col("bitmap").alias("__bitmap"), F.col("n_dropped").alias("__n"))
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    kept = F.filter(F.col("__lines"), lambda x, i: ~F.coalesce(F.get(F.col("__flags"), i), F.lit(False)))
    out = docs.join(marks.hint("shuffle_hash"), docs["doc_id"] == marks["__doc"], "left")
    out = out.withColumn("__lines", F.when(F.col("__bitmap").isNotNull(), lines)).withColumn("__flags", _flags(F.col("__bitmap")))
    text = F.coalesce(F.col("text"), F.lit(""))
    return out.select(
        *[F.col(c) for c in taken if c not in ("text", "n_lines", "n_dropped", "kept_text")],
        (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.col("__n"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("__bitmap").isNull(), text).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs without the repeated lines.

    A line's key is the line without white space ``[ \\t-\\r]`` at its ends, A-Z in
    lower case.  Keys of min_chars code points or more that min_docs documents
    hold lose all their lines but those in the largest doc_id.  A null or empty
    text is one empty line; an empty table gives an empty table.  Rows that repeat a
    doc_id are one document; texts of any length are cut whole.  text gives way to
    kept_text; columns named n_lines, n_dropped or kept_text are replaced.
    """
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))
