"""Corpus preparation: numbering, first-wins deduplication, rejects, statistics, parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corploom.functions import text as X
from corploom.sources.files import PLACE

from .shared import materialize, release


def number_rows(df: DataFrame, *order: Column | str, name: str = "docnum", project: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """df with a dense 1-based number in the given order, without a single-partition window and without a join of df.

    Rows are range-partitioned, sorted and written once with their partition and
    their place in it; each partition's base comes from the counts of those before
    it - one row a partition, so the broadcast is bounded by their number.  Rows
    that tie in order get numbers of their own, nulls come first.  project is
    applied to the sorted rows before they are written, row by row: what is dear is done once, and
    what isn't needed afterwards isn't written.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tied = df.withColumn("__row", F.monotonically_increasing_id())  # so that equal keys don't have to share a partition
    spot = F.monotonically_increasing_id()
    placed = tied.repartitionByRange(n, *keys, "__row").sortWithinPartitions(*keys, "__row").drop("__row")
    placed = project(placed) if project is not None else placed
    placed = materialize(placed.withColumn("__id", spot).withColumns({"__part": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__id"), "numbered")
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    out = placed.join(F.broadcast(base), "__part").withColumn(name, (F.col("__base") + F.col("__at") + 1).cast("long")).drop("__part", "__at", "__base")
    out._work_path = placed._work_path  # noqa: SLF001  release(out) deletes what was written
    return out


def first_wins(df: DataFrame, key: str, order: Column | str) -> DataFrame:
    """df with nth: the place of a row among those with its key, in order.

    Rows are dealt by ranges of (key, order), so the copies of one text lie in
    many partitions; what lies before a partition is one number a key and
    partition, joined on both.  Send narrow rows.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = df.withColumn("__order", F.col(order) if isinstance(order, str) else order).withColumn("__row", F.monotonically_increasing_id())
    by = [key, "__order", "__row"]
    ranged = keyed.repartitionByRange(n, *by).sortWithinPartitions(*by).drop("__order", "__row")
    spot = F.monotonically_increasing_id()
    placed = materialize(ranged.withColumn("__id", spot).withColumns({"__part": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__id"), "ranked")
    spans = placed.groupBy(key, "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    spans = spans.select(F.col(key).alias("__key"), F.col("__part").alias("__in"), (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first") + 1).alias("__base"))
    on = placed[key].eqNullSafe(spans["__key"]) & (placed["__part"] == spans["__in"])
    return placed.join(spans, on).withColumn("nth", (F.col("__base") + F.col("__at")).cast("long")).drop("__key", "__in", "__base", "__part", "__at")


def prepare(raw: DataFrame, input_no: str = "input_no", glue: bool = True, compose: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, rejects, statistics) of raw rows (id, title, text, line_bytes, and input_no or the place that read_raw gives).

    Titles and texts are cleaned, once: the cleaned rows are a work table that all three come from.  A missing id is rejected, of repeated ids the
    first row is kept.  text_bytes counts rejected rows too, so avg_compat is
    larger than the kept documents' mean, avg_unique.
    """
    if input_no not in raw.columns:
        raw = number_rows(raw, *PLACE, name=input_no)
    ident = F.coalesce(F.col("id").cast("string"), F.lit(""))
    rows = raw.select(F.col(input_no).alias("input_no"), ident.alias("docid"), X.clean(F.col("title"), glue, compose).alias("title"), X.clean(F.col("text"), glue, compose).alias("text"), "line_bytes")
    rows = materialize(rows.withColumn("size", F.octet_length("text").cast("long")), "cleaned")
    # only each id's first place is looked for, so an id that very many rows share is one row after partial aggregation; places name rows
    firsts = rows.where("docid <> ''").groupBy("docid").agg(F.min("input_no").alias("input_no"))
    told = materialize(rows.join(firsts.select("input_no", F.lit(True).alias("is_first")), "input_no", "left").withColumn("is_first", F.coalesce("is_first", F.lit(False))), "told")
    release(rows)
    corpus = told.where("is_first").select("input_no", "docid", "title", "text")
    kind = F.when(F.col("docid") == "", "MISSING_ID").otherwise("DUPLICATE").alias("kind")
    rejects = told.where("NOT is_first").select(kind, "input_no", "docid", "title")
    stats = told.agg(
        F.count(F.lit(1)).alias("input_docs"), F.count_if("is_first").alias("unique_docs"), F.coalesce(F.sum("line_bytes"), F.lit(0)).alias("raw_bytes"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("text_bytes"), F.coalesce(F.sum(F.when(F.col("is_first"), F.col("size"))), F.lit(0)).alias("unique_bytes"),
    )
    stats = stats.withColumn("avg_compat", F.coalesce(F.try_divide("text_bytes", "unique_docs"), F.lit(0.0))).withColumn("avg_unique", F.coalesce(F.try_divide("unique_bytes", "unique_docs"), F.lit(0.0)))
    return corpus, rejects, stats


def info_text(stats: DataFrame, rows: int = 1000) -> DataFrame:
    """The statistics as lines of text."""
    parts = F.ceil(F.col("unique_docs") / rows)
    return stats.select(F.concat_ws("\n",
        F.concat(F.lit("documents in: "), F.col("input_docs")), F.concat(F.lit("unique documents: "), F.col("unique_docs")),
        F.concat(F.lit("raw bytes: "), F.format_number("raw_bytes", 0)), F.concat(F.lit("text bytes: "), F.format_number("text_bytes", 0)),
        F.concat(F.lit("mean document bytes: "), F.format_string("%.0f", "avg_compat")), F.concat(F.lit("parts: "), parts),
    ).alias("value"))


def parts(numbered: DataFrame, rows: int = 1000) -> DataFrame:
    """(part, n_docs): part numbers of numbered rows, rows to a part."""
    return numbered.groupBy((F.floor((F.col("docnum") - 1) / rows) + 1).cast("long").alias("part")).agg(F.count(F.lit(1)).alias("n_docs"))
