"""Mixing sources to target weights: a token budget flows down a tree of domains, languages and sources.

A node's budget is shared among its children by weight.  A child that hasn't as
many tokens as its share is filled to its capacity, and what it lacks goes to its
siblings by weight; only what all of them together can't take was never given to
their parent in the first place, so it went to the parent's siblings.  That level
- ``sum(min(capacity, level * weight)) = budget`` - is found exactly with prefix
sums over the children in order of capacity / weight.

A leaf reads its documents in seeded orders, one order an epoch: as many whole
epochs as fit its budget, then a prefix of the next one, ending before the first
document that would exceed the budget.  The prefix needs no sort of the leaf: hash
buckets that lie wholly inside are taken by their sums, the bucket in which the
budget ends is found digit by digit, and only that one is summed row by row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import materialize, scratch

SPACE = r"[ \t-\r]+"
MISSING = "(none)"  # stands for a null domain, language or source
BUCKET_DIGITS = 3  # hex digits at least: 4096 buckets a leaf; more digits where a leaf's buckets would hold over BUCKET_ROWS documents
BUCKET_ROWS = 10_000


def count_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text (null: 0)."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACE))).cast("long")


def draw(doc_id: Column, seed: int, epoch: Column) -> Column:
    """Place of a document in an epoch's order: hex digits of a seeded hash."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), doc_id.cast("string")).cast("binary"))


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    """Whole-number weight of a node by its name at this level; 1 unless given."""
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(int(w))).otherwise(out)
    return out.cast("long")


def share_out(nodes: DataFrame, parent: list[str], level: str) -> DataFrame:
    """nodes (parent, level, capacity, weight, parent_budget) with their budget."""
    family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = family.orderBy(F.col("capacity") / F.col("weight"), F.col(level))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("capacity").over(before), F.lit(0))
    open_weight = F.sum("weight").over(family) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    step = nodes.withColumn("lift", (F.col("parent_budget") - spent).cast("double") / open_weight.cast("double"))
    fits = F.col("lift") <= F.col("capacity").cast("double") / F.col("weight").cast("double")
    step = step.withColumn("nth", F.row_number().over(order))
    step = step.withColumn("at", F.min(F.when(fits, F.col("nth"))).over(family))
    step = step.withColumn("level_lift", F.max(F.when(F.col("nth") == F.col("at"), F.col("lift"))).over(family))
    budget = F.when(F.col("at").isNull() | (F.col("nth") < F.col("at")), F.col("capacity")).otherwise(F.least("capacity", F.floor(F.col("level_lift") * F.col("weight").cast("double"))))
    return step.withColumn("budget", F.greatest(F.lit(0).cast("long"), budget.cast("long"))).drop("lift", "nth", "at", "level_lift")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: Mapping[str, Mapping[str, int]], share: float, max_epochs: int) -> DataFrame:
    """leaves (levels, tokens) with budget: share of all tokens, handed down level by level."""
    out = leaves.withColumn("capacity_leaf", F.col("tokens") * max_epochs)
    total = leaves.agg(F.floor(F.sum("tokens").cast("double") * share).cast("long").alias("parent_budget"))
    for n, level in enumerate(levels):
        parent, path = levels[:n], levels[: n + 1]
        nodes = out.groupBy(*path).agg(F.sum("capacity_leaf").alias("capacity"))
        # the corpus total is one row; further down budgets join by the parent's path
        nodes = nodes.crossJoin(F.broadcast(total)) if not parent else nodes.join(above, parent)
        above = share_out(nodes.withColumn("weight", _weight(level, weights)), parent, level).select(*path, F.col("budget").alias("parent_budget"))
    return out.join(above.withColumnRenamed("parent_budget", "budget"), levels).drop("capacity_leaf")


def plan(docs: DataFrame, levels: list[str], weights: Mapping[str, Mapping[str, int]], share: float, max_epochs: int = 1, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(leaf plan, winners in the buckets where budgets end); docs needs doc_id, text and the levels."""
    slim = docs.select("doc_id", *levels, count_words(F.col("text")).alias("n_tokens"))
    slim = materialize(slim, "tokens")
    leaves = materialize(slim.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents")), "leaves")
    most, size = leaves.agg(F.max("documents")).first()[0] or 0, BUCKET_DIGITS
    while most > BUCKET_ROWS << (4 * size):
        size += 1
    budgets = leaf_budgets(leaves, levels, weights, share, max_epochs)
    budgets = budgets.withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.greatest("tokens", F.lit(1)))).otherwise(0).cast("long"))
    budgets = materialize(budgets.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")), "budgets")
    drawn = slim.join(budgets.select(*levels, "epochs", "rest"), levels).withColumn("draw", draw(F.col("doc_id"), seed, F.col("epochs"))).withColumn("bucket", F.substring("draw", 1, size))
    # digit by digit: sixteen sums a leaf tell in which part the budget ends, and only that part is opened
    sums = materialize(drawn.groupBy(*levels, "rest", "bucket").agg(F.sum("n_tokens").alias("n")), "sums")
    running, ends = Window.partitionBy(*levels).orderBy("part"), None
    for digits in range(1, size + 1):
        own = sums.withColumn("base", F.lit(0).cast("long")) if ends is None else sums.join(ends, levels).where(F.substring("bucket", 1, digits - 1) == F.col("end.part")).withColumn("base", F.col("end.base"))
        parts = own.groupBy(*levels, F.substring("bucket", 1, digits).alias("part")).agg(F.sum("n").alias("n"), F.first("rest").alias("rest"), F.first("base").alias("base"))
        over = parts.withColumn("upto", F.col("base") + F.sum("n").over(running)).where(F.col("upto") > F.col("rest"))
        ends = over.groupBy(*levels).agg(F.min_by(F.struct("part", (F.col("upto") - F.col("n")).alias("base")), "part").alias("end"))
        ends = materialize(ends, "ends")
    leaf_plan = materialize(budgets.join(ends, levels, "left").select(*levels, "documents", "tokens", "budget", "epochs", "rest", F.col("end.part").alias("end_bucket"), F.col("end.base").alias("base")), "plan")
    # rows that repeat a doc_id have one draw and stand or fall together, so they are summed first
    inside = Window.partitionBy(*levels, "bucket").orderBy("draw").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    edge = drawn.join(leaf_plan.select(*levels, "end_bucket", "base"), levels).where(F.col("bucket") == F.col("end_bucket"))
    edge = edge.groupBy(*levels, "bucket", "draw", "doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.first("base").alias("base"), F.first("rest").alias("rest"))
    edge = edge.withColumn("upto", F.col("base") + F.sum("n_tokens").over(inside)).where(F.col("upto") <= F.col("rest"))
    return leaf_plan, materialize(edge.select("doc_id", *levels).distinct(), "winners")


def choose(docs: DataFrame, levels: list[str], weights: Mapping[str, Mapping[str, int]], share: float, max_epochs: int = 1, seed: int = 0) -> DataFrame:
    """docs with ``copies``: in how many epochs of its leaf each row is read.

    share is the token budget as a part of all tokens, max_epochs how often a leaf
    may be read.  Tokens are words.  Null levels form a leaf of their own; a null
    or empty text has no tokens and is read whenever the prefix reaches it; rows
    that repeat a doc_id stand or fall together, as do rows without one that have the
    same text, which draws for them; an empty table gives none.  Other
    columns pass through; a column named copies is replaced.
    """
    own = F.concat(F.lit("text "), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    named = docs.drop("copies").withColumns({f"__{c}": F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in levels})
    named = named.withColumn("__ident", F.when(F.col("doc_id").isNull(), own).otherwise(F.col("doc_id").cast("string")))
    work = named.select(F.col("__ident").alias("doc_id"), "text", *[F.col(f"__{c}").alias(c) for c in levels])
    with scratch() as keep:
        leaf_plan, winners = plan(work, levels, weights, share, max_epochs, seed)
        keep(leaf_plan, winners)
    leaf = leaf_plan.select(*[F.col(c).alias(f"__{c}") for c in levels], F.col("epochs").alias("__epochs"), F.col("end_bucket").alias("__end"))
    edge = winners.select(F.col("doc_id").alias("__won"), *[F.col(c).alias(f"__{c}") for c in levels])
    path = [f"__{c}" for c in levels]
    placed = named.join(leaf, path)
    bucket = F.substr(draw(F.col("__ident"), seed, F.col("__epochs")), F.lit(1), F.length("__end"))
    placed = placed.withColumn("__bucket", bucket)
    match = [placed[c] == edge[c] for c in path] + [placed["__ident"] == edge["__won"], placed["__bucket"] == placed["__end"]]
    on = match[0]
    for m in match[1:]:
        on &= m
    taken = placed.join(edge.withColumn("__in", F.lit(True)), on, "left")
    part = F.when(F.col("__end").isNull() | (F.col("__bucket") < F.col("__end")), 1).when(F.col("__bucket") == F.col("__end"), F.coalesce(F.col("__in").cast("int"), F.lit(0))).otherwise(0)
    # a leaf whose rest is 0 has an end in its first bucket with tokens, a leaf read whole has rest 0 too: nothing but token-less rows precede
    return taken.select(*[placed[c] for c in docs.columns if c != "copies"], (F.col("__epochs") + part).cast("long").alias("copies"))
