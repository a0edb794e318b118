"""Merkle dataset manifest with parent preimages.

Leaves are hashes of rows.  In each group they stand in order, and every fan_out
of them become a parent, level by level, until one node, the subroot, is left; the
subroots become the root in the same way.  A parent's preimage - the digests of
its children, one behind the other - is kept.  A row's proof then needs no search
for siblings: it joins the preimages of its ancestors, and at each level cuts its
own 64 characters out (the siblings) or puts another digest in their place (folding).

Ancestors are joined from the root down, where tables are small: a node has
at most fan_out children, so no key of these joins is hot, whatever a group's size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .linededup import ascii_lower
from .work import materialize, parallelism, release

FAN_OUT, DIGEST = 16, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def row_digest(*fields: Column) -> Column:
    """SHA-256 of the fields one behind the other, each as its UTF-8 bytes' number, a colon and its value; a null is ``-``."""
    told = [F.coalesce(F.concat(F.octet_length(v), F.lit(":"), v), F.lit("-")) for v in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*told), 256)


def _group_key(group: str) -> Column:
    """A group's name without nulls, in the same order: null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))


def place(nodes: DataFrame, *order: str) -> DataFrame:
    """nodes with pos: a dense number from 0 within grp, in the given order.

    Rows are dealt by ranges of (grp, order), so a hot group lies in many
    partitions.  What a partition adds to a group's numbers is the count of the group's
    rows in the partitions before it: one number a group and partition, joined on both.
    """
    n = parallelism(nodes.sparkSession)
    tied = nodes.withColumn("__row", F.monotonically_increasing_id())  # equal rows needn't share a partition
    ranged = tied.repartitionByRange(n, "grp", *order, "__row").sortWithinPartitions("grp", *order, "__row").drop("__row")
    spot = F.monotonically_increasing_id()
    placed = materialize(ranged.withColumn("__id", spot).withColumns({"__part": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__id"), "placed")
    spans = placed.groupBy("grp", "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("grp").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    spans = spans.withColumn("__base", F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first"))
    out = materialize(placed.join(spans.select("grp", "__part", "__base"), ["grp", "__part"]).withColumn("pos", F.col("__base") + F.col("__at")).drop("__part", "__at", "__base"), "nodes")
    release(placed)
    return out


def _parents(nodes: DataFrame, fan_out: int) -> DataFrame:
    """(grp, pos, preimage, digest) of the nodes' parents.

    A node that is alone in its group is passed on without a preimage: positions
    are dense, so that is a single child of parent 0.
    """
    runs = nodes.groupBy("grp", F.expr(f"pos div {fan_out}").alias("pos")).agg(F.array_sort(F.collect_list(F.struct(nodes["pos"].alias("at"), "digest"))).alias("run"))  # fan_out at most
    joined = F.array_join(F.col("run.digest"), "")
    alone = (F.col("pos") == 0) & (F.size("run") == 1)
    return runs.select("grp", "pos", F.when(~alone, joined).alias("preimage"), F.when(alone, joined).otherwise(F.sha2(joined, 256)).alias("digest"))


def grow(nodes: DataFrame, fan_out: int = FAN_OUT) -> list[DataFrame]:
    """The levels above nodes (grp, pos, digest), written one by one; the last has one node a group."""
    levels = []
    while True:
        levels.append(materialize(_parents(levels[-1] if levels else nodes, fan_out), "level"))
        if not levels[-1].agg(F.max("pos")).first()[0]:
            return levels


@dataclass
class Manifest:
    """leaves (grp, pos, digest and what was carried), levels of the groups' trees, and levels of the tree over the subroots."""

    leaves: DataFrame
    levels: list[DataFrame]
    tops: DataFrame  # (grp = "", pos, digest, name): the subroots, numbered in order of their groups' names
    top_levels: list[DataFrame]
    fan_out: int = FAN_OUT

    def root(self) -> str | None:
        row = self.top_levels[-1].first()
        return row and row["digest"]

    def save(self, folder: str) -> None:
        """Write the manifest: leaves, the parents of each level, subroots, the levels above them."""
        self.leaves.write.mode("overwrite").parquet(f"{folder}/leaves")
        self.tops.write.mode("overwrite").parquet(f"{folder}/subroots")
        for name, levels in (("levels", self.levels), ("top_levels", self.top_levels)):
            for n, level in enumerate(levels):
                level.write.mode("overwrite").parquet(f"{folder}/{name}/{n:03}")
        self.leaves.sparkSession.createDataFrame([(self.fan_out, len(self.levels), len(self.top_levels))], "fan_out int, n_levels int, n_top_levels int").coalesce(1).write.mode("overwrite").json(f"{folder}/meta")

    @staticmethod
    def open(spark: SparkSession, folder: str) -> Manifest:
        meta, read = spark.read.json(f"{folder}/meta").first(), spark.read.parquet
        levels = lambda name, n: [read(f"{folder}/{name}/{i:03}") for i in range(n)]
        return Manifest(read(f"{folder}/leaves"), levels("levels", meta["n_levels"]), read(f"{folder}/subroots"), levels("top_levels", meta["n_top_levels"]), meta["fan_out"])


def build(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "source", fan_out: int = FAN_OUT, carry: dict[str, Column] | None = None) -> Manifest:
    """The manifest of docs: leaves ascend by key within a group.

    A null key or group comes first and is a key or group of its own.  Rows that
    share a key ascend by their digests; equal rows are leaves each.  Other
    columns of docs don't count.  carry adds columns over docs to the leaves, such
    as a claimed digest.  Texts are hashed where they are read and never shuffled.
    An empty table has no leaf and no root.  fan_out is a power of two.
    """
    if fan_out < 2 or fan_out & (fan_out - 1):
        raise ValueError("fan_out must be a power of two")
    own = [F.col(f) for f in fields]
    leaves = docs.select(_group_key(group).alias("grp"), F.col(key).alias("key"), row_digest(*own).alias("digest"), *[c.alias(n) for n, c in (carry or {}).items()])
    hashed = materialize(leaves, "hashed")  # else the ranges' sample would hash every text once more
    nodes = place(hashed, "key", "digest")
    release(hashed)
    levels = grow(nodes.select("grp", "pos", "digest"), fan_out)
    tops = place(levels[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"), "name")
    return Manifest(nodes, levels, tops, grow(tops.select("grp", "pos", "digest"), fan_out), fan_out)


def _with_ancestors(levels: list[DataFrame], roots: DataFrame, fan_out: int) -> DataFrame:
    """(grp, parent, preimages, roots' other columns): the preimages from each lowest parent up; roots has a row a group with the preimages beyond."""
    top = levels[-1].select("grp", F.col("pos").alias("parent"), "preimage").join(roots, "grp")
    add = lambda df: df.withColumn("preimages", F.when(F.col("preimage").isNull(), F.col("preimages")).otherwise(F.concat(F.array("preimage"), "preimages"))).drop("preimage")
    out = add(top)
    for level in reversed(levels[:-1]):
        below = level.select("grp", F.col("pos").alias("at"), "preimage").withColumn("parent", F.expr(f"at div {fan_out}"))
        out = add(below.join(out, ["grp", "parent"]).drop("parent").withColumnRenamed("at", "parent"))
    return out


def proofs(manifest: Manifest) -> DataFrame:
    """leaves with subroot, root and steps: array of (preimage, slot) from the leaf's parent up to the root.

    Preimages of a group's tree and of the tree over subroots follow each other;
    a slot is the place of the node below in its parent's preimage.
    """
    k = manifest.fan_out
    empty = F.array().cast("array<string>").alias("preimages")
    root = manifest.top_levels[-1].select("grp", F.col("digest").alias("root"), empty)
    above = _with_ancestors(manifest.top_levels, root, k).withColumnRenamed("preimages", "upper")
    tops = manifest.tops.withColumn("parent", F.expr(f"pos div {k}")).join(above, ["grp", "parent"])
    roots = tops.select(F.col("name").alias("grp"), F.col("digest").alias("subroot"), F.col("pos").alias("nth"), "root", "upper", empty)
    own = _with_ancestors(manifest.levels, roots, k)
    leaves = manifest.leaves.withColumn("parent", F.expr(f"pos div {k}")).join(own, ["grp", "parent"])
    bits = k.bit_length() - 1
    slot = lambda place, i: F.call_function("shiftright", place, i * bits).bitwiseAND(F.lit(k - 1)).cast("int")
    steps = lambda preimages, place: F.transform(preimages, lambda p, i: F.struct(p.alias("preimage"), slot(F.col(place), i).alias("slot")))
    return leaves.withColumn("steps", F.concat(steps("preimages", "pos"), steps("upper", "nth"))).drop("parent", "preimages", "upper", "nth")


def siblings(steps: Column) -> Column:
    """The siblings' digests as one text, level by level, left to right: each preimage without the node's own place."""
    return F.array_join(F.transform(steps, lambda s: F.concat(F.left(s["preimage"], s["slot"] * DIGEST), F.substr(s["preimage"], (s["slot"] + 1) * DIGEST + 1))), "")


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf's digest leads to: put into its place in each preimage, hashed, and so on upwards."""
    put = lambda s, digest: F.concat(F.left(s["preimage"], s["slot"] * DIGEST), digest, F.substr(s["preimage"], (s["slot"] + 1) * DIGEST + 1))
    return F.aggregate(steps, leaf, lambda digest, s: F.sha2(put(s, digest), 256))


def tampered(every: int = 5) -> Column:
    """Whether a row of documents is tampered with in the audit: every divides crc32 of the decimal doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, F.lit(False))


def audit(docs: DataFrame, every: int = 5) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of documents, one of every `every` rows claimed with its text in lower case.

    Claims are folded with the untampered siblings.  A text without A-Z, or none,
    is the same in lower case and stays verified, as does a row without a doc_id.
    """
    lowered = [ascii_lower(F.col(f)) if f == "text" else F.col(f) for f in FIELDS]
    claim = F.when(tampered(every), row_digest(*lowered))
    told = proofs(build(docs, carry={"claim": claim}))
    folded = told.withColumn("folded_root", fold(F.coalesce("claim", "digest"), F.col("steps")))
    return folded.select(F.col("key").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings(F.col("steps")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
