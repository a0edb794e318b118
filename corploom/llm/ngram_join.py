"""N-gram Jaccard join: documents whose sets of k-word shingles have a Jaccard similarity of at least t.

Equal sets are found by their hash and stand for each other from then on; the
join runs over one representative of each.

* Shingles are ordered rare-first.  Their frequencies come from a counting sketch
  of fixed size over all documents, so the order is the same everywhere and the
  table that carries it has a bound.  Any order is correct; this one keeps
  frequent passages out of prefixes.  In a corpus so large that every counter is
  full the sketch tells little, but what it misses shows: shingles that stand in the
  prefixes of HEAVY sets or more are counted exactly, put last in everybody's order,
  and the prefixes that held them are cut anew - the others don't change.
* A set of n shingles needs only its first ``n - ceil(t n) + 1`` as a prefix: two
  similar sets share a shingle of their prefixes.  Prefix entries carry size,
  position and a summary of the set's suffix, of what stands behind the position:
  the parities of its shingle counts in 512 hash classes, as bits.
* Pairs from a shared prefix shingle pass the length filter, the positional filter
  (what can still overlap from the shared position on) and the suffix filter: of
  the differences that a linked pair may have, those before the shared shingle
  are used up, and the summaries' distance bounds the suffixes' differences from
  below.  Then, once a pair, fine summaries of the whole sets, of a class for about
  16 shingles, sieve long documents.
* Both filters take the shared shingle for the first that the sets share.
  A pair that links shares its first shingle within both prefixes and passes there;
  at its later shingles it may fail, which only saves repeated rows.
* Each surviving pair is verified once on the whole sets.

A result by component doesn't need every pair of a dense group.  So a first round
joins each entry only with the leader of its shingle (a different one for each
shingle, chosen by hash), verifies those pairs and forms components; the second
round takes every remaining pair whose ends lie in different components.  No link
between different components is left out, and a group of thousands of near copies
costs thousands of pairs, not millions.  Of two sets in different components one
at least lies outside the component that most of a shingle's sets are in, so only
those few are joined with all; and the entries of a shingle that MANY sets hold
meet by shingle, by a band of sizes, of which the length filter allows only neighbours,
and by tiles of TILE entries, so no task gets a whole group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .textkernel import buffers, chunks, mix, shingles, words
from .work import materialize, release, scratch, small_batches

SKETCH_BITS = 20  # counters of the frequency sketch: 2 ** 20, whatever the corpus
BROADCAST_IDS = 1_000_000  # ids (8 bytes each) that may be broadcast; beyond it they are shuffled
HEAVY = 10_000  # sets whose prefixes may share a shingle before it is put last
HEAVY_LIST = 250_000  # such shingles (8 bytes each) at one time at most: the bound on sets rises with the number of entries, so no more can exist
HEAVY_ROUNDS = 4  # times that prefixes are cut anew; any order is correct, so more would only save time
MANY = 1_000  # entries of a shingle from which the second round deals them by bands of sizes too
TILE = 2_000  # entries of such a shingle that meet others in one place
SUMMARY_LONGS = 8  # of 64 parity bits each: the summary that entries carry
CLASSES = 64 * SUMMARY_LONGS
SUMMARY = [f"s{i}" for i in range(SUMMARY_LONGS)]
FINE_CLASSES = (8, 4096)  # fewest and most classes of a document's fine summary: about one for 16 shingles


def document_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, bounds): those of each text ascending, one text after another."""
    data, bounds = buffers(column)
    w = words(data, bounds, lower=True)
    h, doc = shingles(w, w.hashes(), k)
    # ascending within each text: sort by hash, then stably by text
    order = np.argsort(h)
    order = order[np.argsort(doc[order], kind="stable")]
    h, doc = h[order], doc[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[fresh], doc[fresh]
    return h, np.searchsorted(doc, np.arange(len(column) + 1))


def frequency_sketch(docs: DataFrame, k: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """How many documents hold a shingle of each counter, over all documents; 2 ** bits numbers."""
    small_batches(docs.sparkSession)
    parts = 1 << 8  # counters travel in runs, so that a task sends few rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, dtype=np.int64)
        for batch in chunks(batches):
            h, _ = document_sets(batch.column("text"), k)
            total += np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        run_size = len(total) // parts
        for p in range(parts):
            own = total[p * run_size : (p + 1) * run_size]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([own.tolist()], pa.list_(pa.int32()))], ["part", "n"])

    size = (1 << bits) // parts

    def fold(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            total += b.column("n").flatten().to_numpy().reshape(-1, size).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tolist()], pa.list_(pa.int64()))], ["part", "n"])

    local = docs.select("text").mapInArrow(run, "part int, n array<int>")
    out = np.zeros(1 << bits, dtype=np.int64)
    for r in local.groupBy("part").applyInArrow(fold, "part int, n array<long>").collect():
        out[r["part"] * size : (r["part"] + 1) * size] = r["n"]
    return out


def parities(row: np.ndarray, of: np.ndarray, rows: int) -> np.ndarray:
    """SUMMARY_LONGS numbers a row: for each class the parity of how often it occurs."""
    odd = np.bincount(row * CLASSES + of, minlength=rows * CLASSES) & 1
    return np.packbits(odd.astype(bool)).view(np.int64).reshape(-1, SUMMARY_LONGS)


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    """n - ceil(t n) + 1 for t = percent / 100, in whole numbers."""
    return np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)


def fine_classes(n: np.ndarray) -> np.ndarray:
    """Classes of a fine summary of n shingles: the power of two nearest n / 16, within FINE_CLASSES."""
    power = np.round(np.log2(np.maximum(n, 1) / 16)).astype(np.int64)
    return np.clip(1 << np.maximum(power, 0), *FINE_CLASSES)


def signatures(docs: DataFrame, k: int, percent: int, sketch: np.ndarray, last: np.ndarray | None = None) -> DataFrame:
    """(doc_id, n, set_key, prefix, classes, fine, s0, s1 ...) of every document: prefix in rare-first order, the shingles of last (ascending) behind all others; classes are the hash classes of the prefix, s0 ... the summary of the whole set."""
    bits = int(len(sketch)).bit_length() - 1
    level = np.floor(np.log2(np.maximum(sketch, 1) / max(1.0, float(np.median(sketch))) + 1e-9) * 8).astype(np.int64)
    level = np.clip(level, 0, 254).astype(np.uint8)  # counters near the median are equally rare

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            h, bounds = document_sets(batch.column("text"), k)
            n = np.diff(bounds)
            doc = np.repeat(np.arange(len(n)), n)
            keys = np.zeros((len(n), 2), dtype=np.uint64)
            sums = np.zeros((2, len(h) + 1), dtype=np.uint64)
            np.cumsum(mix(h), out=sums[0, 1:])
            np.cumsum(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=sums[1, 1:])
            for j in range(2):
                keys[:, j] = sums[j, bounds[1:]] - sums[j, bounds[:-1]]
            rarity = level[(h >> np.uint64(64 - bits)).astype(np.int64)]
            if last is not None and len(last):
                rarity[last[np.minimum(np.searchsorted(last, h), len(last) - 1)] == h] = 255
            by_hash = mix(h)
            order = np.lexsort((by_hash, rarity, doc))
            position = np.arange(len(h)) - np.repeat(bounds[:-1], n)
            take = position < np.repeat(prefix_size(n, percent), n)
            chosen = h[order][take]
            of = (by_hash & np.uint64(CLASSES - 1)).astype(np.int64)
            own = parities(doc, of, len(n))
            p_bounds = np.concatenate([[0], np.cumsum(prefix_size(n, percent))])
            width = fine_classes(n)
            f_bounds = np.concatenate([[0], np.cumsum(width)])
            # a class is the hash's low bits, so half as many classes are the sums of pairs; counts stop at 127, halves too, so equal sets always have equal counts
            fine = np.bincount(f_bounds[:-1][doc] + (h & (width[doc] - 1).astype(np.uint64)).astype(np.int64), minlength=f_bounds[-1])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(n.astype(np.int64)),
                    pa.array([r.tobytes() if m else None for r, m in zip(keys, n, strict=True)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(p_bounds.astype(np.int32)), pa.array(chosen.view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(p_bounds.astype(np.int32)), pa.array(of[order][take].astype(np.int16))),
                    pa.ListArray.from_arrays(pa.array(f_bounds.astype(np.int32)), pa.array(np.minimum(fine, 127).astype(np.int8))),
                    *(pa.array(own[:, i]) for i in range(SUMMARY_LONGS)),
                ],
                ["doc_id", "n", "set_key", "prefix", "classes", "fine", *SUMMARY],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, set_key binary, prefix array<long>, classes array<smallint>, fine array<tinyint>, " + ", ".join(f"{s} long" for s in SUMMARY))


def _without_heavy(owners: DataFrame, docs: DataFrame, k: int, percent: int, sketch: np.ndarray, heavy: int) -> DataFrame:
    """owners (set_key, rep, prefix ...) with prefixes cut anew where they held shingles that the sketch took for rare."""
    last = np.zeros(0, np.uint64)
    for _ in range(HEAVY_ROUNDS):
        entries = owners.select("set_key", "rep", F.explode("prefix").alias("shingle"))
        total = owners.agg(F.sum(F.size("prefix"))).first()[0] or 0
        counted = entries.groupBy("shingle").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > max(heavy, total // HEAVY_LIST))
        found = np.array([r["shingle"] for r in counted.select("shingle").collect()], dtype=np.int64).view(np.uint64)
        fresh = np.setdiff1d(found, last)
        if not len(fresh):
            return owners
        last = np.union1d(last, fresh)
        spark = owners.sparkSession
        listed = spark.createDataFrame(pa.table({"shingle": pa.array(fresh.view(np.int64))}))
        touched = materialize(entries.join(F.broadcast(listed), "shingle", "left_semi").select("set_key", "rep").distinct(), "touched")
        anew = signatures(_only(docs, touched.select("rep").distinct()), k, percent, sketch, last).select("doc_id", "set_key", F.struct("prefix", "classes").alias("cut"))
        anew = anew.join(touched.select(F.col("rep").alias("doc_id"), "set_key"), ["doc_id", "set_key"], "left_semi").dropDuplicates(["set_key"]).select("set_key", "cut")
        changed = owners.join(anew, "set_key", "left").withColumns({c: F.coalesce(f"cut.{c}", c) for c in ("prefix", "classes")}).drop("cut")
        before, owners = owners, materialize(changed, "representatives")
        release(before, touched)
    return owners


def _bands(n: Column, percent: int) -> Column:
    """Number of a set's band of sizes: sets that can link lie in one band or in neighbouring ones."""
    if percent >= 100:
        return n * 2  # only equal sizes can link, and no two are neighbours
    # a band is a little wider than the length filter, so rounding can't put two such sets two bands apart
    return F.floor(F.ln(n.cast("double")) / float(-np.log(percent / 100) * (1 + 1e-9) + 1e-9))


def _suffixes(entries: DataFrame, owners: DataFrame) -> DataFrame:
    """entries (shingle, rep, n, pos, leads) with the summary of each suffix: the whole set's without the classes up to pos."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, pos = batch.column("classes"), batch.column("pos").to_numpy(zero_copy_only=False).astype(np.int64)
            size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(size)), size)
            taken = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) <= pos[row]
            gone = parities(row[taken], column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)[taken], len(size))
            rest = [pa.array(batch.column(s).to_numpy(zero_copy_only=False) ^ gone[:, i]) for i, s in enumerate(SUMMARY)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *rest], [*keep, *SUMMARY])

    keep = ["shingle", "rep", "n", "pos", "leads"]
    # as long as the prefix may be, of a row only its classes up to pos are sent
    rows = entries.join(owners.select("rep", "classes", *SUMMARY), "rep").withColumn("classes", F.slice("classes", F.lit(1), F.col("pos") + 1))
    return rows.mapInArrow(run, "shingle long, rep long, n long, pos int, leads boolean, " + ", ".join(f"{s} long" for s in SUMMARY))


def _may_link(percent: int) -> Column:
    """Length, positional and suffix filters of an entry a and an entry b of one shingle, the first that they share."""
    a, b = F.col("a.n"), F.col("b.n")
    length = (100 * F.least(a, b)) >= percent * F.greatest(a, b)
    # 100 |x & y| >= percent |x | y|  <=>  (100 + percent) |x & y| >= percent (|x| + |y|)
    need = F.ceil((percent * (a + b)) / F.lit(100 + percent) - F.lit(1e-9))
    positional = F.least(a - F.col("a.pos"), b - F.col("b.pos")) >= need
    apart = reduce(Column.__add__, [F.bit_count(F.col(f"a.{s}").bitwiseXOR(F.col(f"b.{s}"))) for s in SUMMARY])
    # a + b - 2 need differences are allowed; what stands before the first shared shingle differs
    suffix = apart <= a + b - 2 * need - F.col("a.pos") - F.col("b.pos")
    return length & positional & suffix


def _pass_suffix(pairs: DataFrame, fines: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose fine summaries allow a link; fines (rep, n, fine)."""
    side = lambda x: fines.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("fine").alias(f"f{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    full = lambda x: F.transform(x, lambda i: i.cast("int"))
    # to m classes, in runs of m: the longer summary is folded until the lengths agree
    fold = lambda x, m: F.aggregate(F.sequence(m, F.size(x) - m, m), full(F.slice(x, F.lit(1), m)), lambda t, at: F.zip_with(t, F.slice(x, at + 1, m), lambda i, j: F.least(i + j.cast("int"), F.lit(127))))
    fa, fb = F.col("fa"), F.col("fb")
    x = F.when(F.size(fa) > F.size(fb), fold(fa, F.size(fb))).otherwise(full(fa))
    y = F.when(F.size(fb) > F.size(fa), fold(fb, F.size(fa))).otherwise(full(fb))
    apart = F.aggregate(F.zip_with(x, y, lambda i, j: F.abs(i - j)), F.lit(0), lambda t, i: t + i)
    need = F.ceil((percent * (F.col("na") + F.col("nb"))) / F.lit(100 + percent) - F.lit(1e-9))
    return both.where(apart <= F.col("na") + F.col("nb") - 2 * need).select("a", "b")


def linked(one: pa.Array, other: pa.Array, k: int, percent: int) -> np.ndarray:
    """Which texts of one link with the text beside them in other, on whole sets."""
    (h, at), (g, to) = document_sets(one, k), document_sets(other, k)
    n, m = np.diff(at), np.diff(to)
    tag = mix(np.arange(1, len(n) + 1, dtype=np.uint64))
    x, y = mix(h ^ np.repeat(tag, n)), mix(g ^ np.repeat(tag, m))
    _, where, _ = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = np.bincount(np.repeat(np.arange(len(n)), n)[where], minlength=len(n))
    return (n > 0) & (100 * shared >= percent * (n + m - shared))


def _verify(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b), a written table, that link.  Texts travel rather than sets: compressed, they are half the size."""
    ids = materialize(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), "ids")
    texts = materialize(_only(docs, ids), "texts")
    both = pairs.select("a", "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "ta"):
            ok = pa.array(linked(batch.column("ta"), batch.column("tb"), k, percent))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs with an id of ids (rep), which is a written table and so is counted at no cost.

    Up to BROADCAST_IDS ids go to every executor and no text is shuffled; more are
    joined by shuffle.
    """
    ids = ids.select(F.col("rep").alias("doc_id"))
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90, heavy: int = HEAVY, many: int = MANY) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    Texts are lower-cased in A-Z and cut into words ``[^\\x20\\x09-\\x0D]+``; a
    document's set is its distinct k-word shingles, of fewer words the whole
    sequence as one.  Documents link when 100 |x & y| >= percent |x | y|;
    component_id is the least doc_id reachable.  Null or empty texts have no
    shingles and link with nothing; their component is their own id.  Rows that
    repeat a doc_id are kept as rows and count as copies of the id; an empty table
    gives an empty result.  Texts of any length are read whole; other columns of docs
    don't count.
    """
    with scratch() as keep:
        return _components(docs.select("doc_id", "text"), k, percent, heavy, many, keep)


def _components(docs: DataFrame, k: int, percent: int, heavy: int, many: int, keep: Callable[..., None]) -> DataFrame:
    small_batches(docs.sparkSession)
    sketch = frequency_sketch(docs, k)
    marked = materialize(signatures(docs, k, percent, sketch), "signatures")
    owners = marked.where("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("n", "prefix", "classes", "fine", *SUMMARY), "doc_id").alias("s"))
    owners = materialize(owners.select("set_key", "rep", "s.*"), "representatives")
    keys, classes = materialize(marked.select("doc_id", "n", "set_key"), "keys"), materialize(owners.select("set_key", "rep"), "classes")
    fines = materialize(owners.select("rep", "n", "fine"), "fines")
    release(marked)
    owners = _without_heavy(owners, docs, k, percent, sketch, heavy)
    entries = owners.select("rep", "n", F.posexplode("prefix").alias("pos", "shingle"))
    place = F.xxhash64("rep", "shingle")
    # shingles of two representatives or more; the leader is the one of the least hash
    spread = entries.groupBy("shingle").agg(F.count(F.lit(1)).alias("held"), F.min(place).alias("lead"))
    leaders = materialize(spread.where("held > 1").select("shingle", "lead"), "leaders")
    shared = materialize(entries.select("shingle", "rep", "n", "pos").join(leaders, "shingle").withColumn("leads", place == F.col("lead")).drop("lead"), "shared")
    release(leaders)
    full = materialize(_suffixes(shared, owners), "entries")
    release(shared)
    release(owners)
    heads = full.where("leads")
    star = full.alias("a").join(heads.alias("b"), (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.rep") != F.col("b.rep")) & _may_link(percent))
    star = star.select(F.least("a.rep", "b.rep").alias("a"), F.greatest("a.rep", "b.rep").alias("b")).distinct()
    tried = materialize(_pass_suffix(star, fines, percent), "star")
    found = materialize(connected_components(materialize(_verify(tried, docs, k, percent), "links")), "components")

    placed = full.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    placed = materialize(placed, "placed")
    release(full)
    each = placed.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("own"))
    split = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("parts"), F.sum("own").alias("held"), F.max_by("component", F.struct("own", "component")).alias("main")).where("parts > 1").select("shingle", "held", "main")
    rest = materialize(placed.join(split, "shingle"), "rest")
    release(placed)
    # one end of a pair lies outside the shingle's main component
    minor = F.col("component") != F.col("main")
    apart = (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.component") != F.col("b.component")) & ((F.col("a.rep") < F.col("b.rep")) | (F.col("b.component") == F.col("b.main")))
    few, lots, band = rest.where(F.col("held") <= many), rest.where(F.col("held") > many), _bands(F.col("n"), percent)
    ends = [F.least("a.rep", "b.rep").alias("a"), F.greatest("a.rep", "b.rep").alias("b")]
    pairs = few.where(minor).alias("a").join(few.alias("b"), apart & _may_link(percent)).select(*ends)
    tiles = F.ceil(F.col("held") / TILE).cast("int")
    one = lots.where(minor).withColumn("band", F.explode(F.array(band - 1, band, band + 1))).withColumn("tile", F.explode(F.sequence(F.lit(0), tiles - 1)))
    other = lots.withColumn("band", band).withColumn("tile", F.pmod(F.xxhash64("rep"), tiles).cast("int"))
    pairs = pairs.union(one.alias("a").join(other.alias("b"), (F.col("a.band") == F.col("b.band")) & (F.col("a.tile") == F.col("b.tile")) & apart & _may_link(percent)).select(*ends))
    pairs = pairs.distinct().join(tried, ["a", "b"], "left_anti")
    more = materialize(_verify(materialize(_pass_suffix(pairs, fines, percent), "pairs"), docs, k, percent), "links")
    final = materialize(connected_components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more)), "components")

    keep(keys, classes, final)
    by_key = classes.join(final.select(F.col("id").alias("rep"), "component"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    out = keys.select("doc_id", F.col("n").alias("n_shingles"), "set_key").join(by_key, "set_key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
