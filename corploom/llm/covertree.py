"""Embedding near-dedup: exact cosine threshold pairs by dual traversal of cover trees.

Vectors of one label are compared with each other, as unit vectors: a cosine of
at least t is a chord of at most sqrt(2 - 2 t).  Equal vectors are merged first
and counted.  What travels is not a vector but its code, two bytes a component,
with the distance between both: bounds on codes hold for the vectors, and only
vectors that codes can't decide are fetched whole.

* Upper levels, over the cluster: a label is a region; regions of too many vectors
  are divided around pivots, level by level, until each is a block of bounded
  bytes with a centre and a covering radius.
* Lower levels, in a block: a cover tree - nested levels of centres, radii halved
  from level to level - built once and kept with the block.
* Pairs of regions are opened from the top; a pair is dropped when the distance of
  the centres minus both radii exceeds the chord.  Pairs of blocks that lie wholly
  within the chord are counted by their sizes; each other surviving pair is a task
  of its own that walks both trees at once by the same rules.
* A task tells how many links each vector is sure to have, one forest edge for it,
  and which vectors have a partner so near the threshold that codes can't tell.
  The vectors of those alone are fetched and compared in double precision.

No pairs leave a task: a group of thousands of near copies costs as many rows as it
has members.  Vectors without any structure (all far from each other, all in one
label) leave only single vectors for nodes: then blocks prune nothing, and codes are
compared block by block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .work import materialize, parallelism, scratch, small_batches

BLOCK_ROWS = 4096  # vectors of a block at most
BLOCK_BYTES = 1 << 20  # of codes of a block at most
PIVOTS = 24  # parts that a region is divided into at most, at one level
LEVELS = 8  # divisions at most; what is too large then (vectors that no pivot parts) is dealt by hash
LEAF = 24  # a node of so few vectors isn't divided
TILE = 1024  # rows of a distance matrix at a time
CODE = 32767  # a component of 1
EPS = 1e-9


def pair_squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of y."""
    out = -2 * (x @ y.T)
    out += (x * x).sum(axis=1)[:, None]
    out += (y * y).sum(axis=1)
    return np.maximum(out, 0, out=out)


def _slack(x: np.ndarray) -> float:
    """What rounding may add to a squared distance."""
    return 4 * x.shape[1] * float(np.finfo(x.dtype).eps) + 1e-12 if x.size else 0.0


def _net(x: np.ndarray, reach: float) -> np.ndarray:
    """For each row the number of its centre; centres are rows, chosen in order among those that no earlier one covers."""
    label, left, centres = np.full(len(x), -1, np.int64), np.arange(len(x)), 0
    while len(left):
        ahead = left[:256]
        near = pair_squares(x[ahead], x[ahead]) <= reach * reach
        covered, chosen = np.zeros(len(ahead), bool), []
        for i in range(len(ahead)):
            if not covered[i]:
                chosen.append(i)
                covered |= near[i]
        inside = pair_squares(x[left], x[ahead[chosen]]) <= reach * reach
        inside[chosen, np.arange(len(chosen))] = True  # the first rows of left are ahead
        got = inside.any(axis=1)
        got[: len(ahead)] = True
        label[left[got]] = centres + np.where(inside[got].any(axis=1), inside[got].argmax(axis=1), 0)
        late = np.flatnonzero(got[: len(ahead)] & ~inside[: len(ahead)].any(axis=1))  # covered by rounding only: centres of their own
        label[ahead[late]] = centres + len(chosen) + np.arange(len(late))
        centres += len(chosen) + len(late)
        left = left[~got]
    return label


@dataclass
class CoverTree:
    """Nodes in arrays: members[lo:hi] are a node's vectors, radius covers them around its centre; kids[p]:kids[p] + n_kids[p] are its children.

    err is how far each row of x may be from the vector that it stands for; radius includes it.
    """

    x: np.ndarray
    err: np.ndarray
    members: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    kids: np.ndarray
    n_kids: np.ndarray

    ARRAYS = {"members": np.int32, "centre": np.int32, "radius": np.float64, "lo": np.int32, "hi": np.int32, "kids": np.int32, "n_kids": np.int32}

    @classmethod
    def build(cls, x: np.ndarray, err: np.ndarray | None = None) -> CoverTree:
        err = np.zeros(len(x)) if err is None else err
        members, centre, radius, spread, lo, hi, kids, n_kids = np.arange(len(x)), [], [], [], [], [], [], []

        def node(a: int, b: int) -> int:
            own = members[a:b]
            d = np.sqrt(((x[own].astype(np.float64) - x[own[0]]) ** 2).sum(axis=1))
            centre.append(own[0])
            spread.append(float(d.max()))
            radius.append(float((d + err[own]).max()) + EPS)
            lo.append(a)
            hi.append(b)
            kids.append(0)
            n_kids.append(0)
            return len(centre) - 1

        stack = [node(0, len(x))] if len(x) else []
        while stack:
            p = stack.pop()
            a, b = lo[p], hi[p]
            if b - a <= LEAF or spread[p] <= 1e-6:
                continue
            # nesting: the centre stands first, so it is a centre of all finer levels
            label = _net(x[members[a:b]], spread[p] / 2)
            order = np.argsort(label, kind="stable")
            members[a:b] = members[a:b][order]
            ends = a + np.concatenate([[0], np.cumsum(np.bincount(label))])
            kids[p], n_kids[p] = len(centre), len(ends) - 1
            if len(ends) == 2:  # rounding kept all in one
                n_kids[p] = 0
                continue
            made = [node(int(i), int(j)) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            stack += [m for m in made if hi[m] - lo[m] > LEAF]
        arrays = dict(members=members, centre=centre, radius=radius, lo=lo, hi=hi, kids=kids, n_kids=n_kids)
        return cls(x, err, **{k: np.array(v, dtype=cls.ARRAYS[k]) for k, v in arrays.items()})


class _Union:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


@dataclass
class Walk:
    """One traversal of two trees (or of one with itself): summed weights that each row links with, a forest, undecided rows, and what was pruned.

    sure(rows, cols) gives (linked, undecided) of all pairs.  Rows that are marked in
    skip_x and skip_y are not counted with each other.
    """

    s: CoverTree
    t: CoverTree
    weight_x: np.ndarray
    weight_y: np.ndarray
    chord: float
    decide: object
    skip_x: np.ndarray
    skip_y: np.ndarray
    seen: int = 0
    pruned: int = 0
    count_x: np.ndarray = field(init=False)
    count_y: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.same = self.s is self.t
        self.shift = 0 if self.same else len(self.s.x)
        self.count_x, self.count_y = np.zeros(len(self.s.x), np.int64), np.zeros(len(self.t.x), np.int64)
        self.open_x, self.open_y = np.zeros(len(self.s.x), bool), np.zeros(len(self.t.x), bool)
        self.union = _Union(len(self.s.x) + (0 if self.same else len(self.t.x)))

    def run(self) -> Walk:
        s, t, slack = self.s, self.t, _slack(self.s.x)
        stack = [(0, 0)] if len(s.x) and len(t.x) else []
        while stack:
            p, q = stack.pop()
            twin = self.same and p == q
            if (2 * s.radius[p] if twin else np.sqrt(float(pair_squares(s.x[[s.centre[p]]], t.x[[t.centre[q]]])[0, 0]) + slack) + s.radius[p] + t.radius[q]) < self.chord - EPS:
                self._whole(p, q)
                continue
            kp = np.arange(s.kids[p], s.kids[p] + s.n_kids[p]) if s.n_kids[p] else np.array([p])
            kq = np.arange(t.kids[q], t.kids[q] + t.n_kids[q]) if t.n_kids[q] else np.array([q])
            if not s.n_kids[p] and not t.n_kids[q]:
                self._leaves(p, q)
                continue
            y, ry = t.x[t.centre[kq]], t.radius[kq]
            alone_q = t.hi[kq] - t.lo[kq] == 1
            for at in range(0, len(kp), TILE):  # pairs of children, a tile at a time
                part = kp[at : at + TILE]
                near = pair_squares(s.x[s.centre[part]], y) <= (self.chord + s.radius[part][:, None] + ry + EPS) ** 2 + slack
                if twin:
                    near &= part[:, None] <= kq
                    self.seen += int((part[:, None] <= kq).sum())
                else:
                    self.seen += near.size
                i, j = np.nonzero(near)
                self.pruned -= len(i)
                alone = (s.hi[part[i]] - s.lo[part[i]] == 1) & alone_q[j]
                one, other = s.members[s.lo[part[i[alone]]]], t.members[t.lo[kq[j[alone]]]]
                if self.same:
                    one, other = one[one != other], other[one != other]
                if len(one):
                    self._singles(one, other)
                stack += zip(part[i[~alone]].tolist(), kq[j[~alone]].tolist(), strict=True)
        self.pruned += self.seen
        return self

    def _count(self, rows: np.ndarray, cols: np.ndarray, linked: np.ndarray, both: bool) -> None:
        linked = linked & ~(self.skip_x[rows][:, None] & self.skip_y[cols])
        self.count_x[rows] += linked @ self.weight_y[cols]
        if both:
            (self.count_x if self.same else self.count_y)[cols] += self.weight_x[rows] @ linked
        for i in np.flatnonzero(linked.any(axis=1)):
            for j in cols[linked[i]]:
                self.union.join(int(rows[i]), int(j) + self.shift)

    def _singles(self, rows: np.ndarray, cols: np.ndarray) -> None:
        """Pairs of single vectors, side by side."""
        linked, unsure = self.decide(rows, cols, True)
        self.open_x[rows[unsure]], self.open_y[cols[unsure]] = True, True
        linked &= ~(self.skip_x[rows] & self.skip_y[cols])
        rows, cols = rows[linked], cols[linked]
        np.add.at(self.count_x, rows, self.weight_y[cols])
        np.add.at(self.count_x if self.same else self.count_y, cols, self.weight_x[rows])
        for i, j in zip(rows.tolist(), cols.tolist(), strict=True):
            self.union.join(i, j + self.shift)

    def _whole(self, p: int, q: int) -> None:
        rows, cols = self.s.members[self.s.lo[p] : self.s.hi[p]], self.t.members[self.t.lo[q] : self.t.hi[q]]
        own, other = self.weight_x[rows], self.weight_y[cols]
        self.count_x[rows] += other.sum() - np.where(self.skip_x[rows], (other * self.skip_y[cols]).sum(), 0)
        if self.same and p == q:
            self.count_x[rows] -= np.where(self.skip_x[rows], 0, own)
        else:
            (self.count_x if self.same else self.count_y)[cols] += own.sum() - np.where(self.skip_y[cols], (own * self.skip_x[rows]).sum(), 0)
        for i in rows:
            self.union.join(int(i), int(cols[0]) + self.shift)
        for j in cols:
            self.union.join(int(rows[0]), int(j) + self.shift)

    def _leaves(self, p: int, q: int) -> None:
        rows, cols = self.s.members[self.s.lo[p] : self.s.hi[p]], self.t.members[self.t.lo[q] : self.t.hi[q]]
        for at in range(0, len(rows), TILE):
            part = rows[at : at + TILE]
            linked, unsure = self.decide(part, cols, False)
            if self.same and p == q:
                linked &= part[:, None] != cols
                unsure = unsure & (part[:, None] != cols)
            self.open_x[part[unsure.any(axis=1)]] = True
            self.open_y[cols[unsure.any(axis=0)]] = True
            if linked.any():
                self._count(part, cols, linked, both=not (self.same and p == q))

    def roots(self) -> np.ndarray:
        return np.array([self.union.find(i) for i in range(len(self.union.up))], dtype=np.int64)


def _chord(cosine: float) -> float:
    return float(np.sqrt(max(0.0, 2 - 2 * cosine)))


def dual_links(x: np.ndarray, y: np.ndarray, weight_x: np.ndarray, weight_y: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(summed weights that each x links with, the same of each y, forest over x then y as parents), of unit vectors in double precision.

    same: y is x, and a vector isn't compared with itself; the second result is then zero.
    """
    s = CoverTree.build(x)
    t = s if same else CoverTree.build(y)

    def decide(rows: np.ndarray, cols: np.ndarray, beside: bool) -> tuple[np.ndarray, np.ndarray]:
        linked = np.einsum("ij,ij->i", x[rows], y[cols]) >= cosine if beside else x[rows] @ y[cols].T >= cosine
        return linked, np.zeros_like(linked)

    none_x, none_y = np.zeros(len(x), bool), np.zeros(len(y), bool)
    w = Walk(s, t, weight_x, weight_y, _chord(cosine), decide, none_x, none_y).run()
    return w.count_x, np.zeros(len(y), np.int64) if same else w.count_y, w.roots()


def coded_links(s: CoverTree, t: CoverTree, weight_x: np.ndarray, weight_y: np.ndarray, cosine: float) -> Walk:
    """The walk over codes.  Rows in open_x and open_y aren't counted with each other: those pairs are left to their vectors."""
    chord, slack = _chord(cosine), _slack(s.x)

    def decide(rows: np.ndarray, cols: np.ndarray, beside: bool) -> tuple[np.ndarray, np.ndarray]:
        if beside:
            d, err = ((s.x[rows] - t.x[cols]) ** 2).sum(axis=1), s.err[rows] + t.err[cols] + EPS
        else:
            d, err = pair_squares(s.x[rows], t.x[cols]), s.err[rows][:, None] + t.err[cols] + EPS
        linked = d + slack < np.maximum(chord - err, 0) ** 2
        return linked, ~linked & (d <= (chord + err) ** 2 + slack)

    skip_x, skip_y = np.zeros(len(s.x), bool), np.zeros(len(t.x), bool)
    w = Walk(s, t, weight_x, weight_y, chord, decide, skip_x, skip_y).run()
    if s is t:
        w.open_x |= w.open_y
        w.open_y = w.open_x
    if w.open_x.any():  # again, now that they are known; the same numbers make the same decisions
        again = Walk(s, t, weight_x, weight_y, chord, decide, w.open_x, w.open_y).run()
        again.open_x, again.open_y = w.open_x, w.open_y
        return again
    return w


def _unit(rows: list) -> np.ndarray:
    x = np.array([np.asarray(r, dtype=np.float64) for r in rows])
    if not len(x):
        return np.zeros((0, 1))
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(two-byte codes of unit vectors, how far each code is from its vector)."""
    code = np.rint(x * CODE).astype(np.int16)
    return code, np.sqrt(((code / CODE - x) ** 2).sum(axis=1)) + EPS


def _points(codes: list[bytes] | bytes, dim: int) -> np.ndarray:
    raw = codes if isinstance(codes, bytes) else b"".join(codes)
    return (np.frombuffer(raw, np.int16).reshape(-1, dim) / np.float32(CODE)).astype(np.float32)


def _coded(copies: DataFrame) -> DataFrame:
    """(rep, copies, path, dim, code, err) of distinct vectors; path is the region, a label's to begin with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, dims = batch.column("v"), batch.column("dim").to_numpy()
            codes, err = np.full(batch.num_rows, None, dtype=object), np.zeros(batch.num_rows)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                code, err[at] = encode(_unit(v.take(pa.array(at)).flatten().to_numpy().reshape(-1, dim)))
                codes[at] = [c.tobytes() for c in code]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "copies", "path", "dim")), pa.array(codes, pa.binary()), pa.array(err)], ["rep", "copies", "path", "dim", "code", "err"])

    path = F.concat_ws("/", F.hex(F.col("label").cast("string")), F.col("dim").cast("string"))  # free of the signs that regions are named with
    return copies.select("rep", "copies", path.alias("path"), "dim", "v").mapInArrow(run, "rep long, copies long, path string, dim long, code binary, err double")


def _room(dim: Column, block_rows: int) -> Column:
    """Vectors that a block may hold."""
    return F.greatest(F.lit(16), F.least(F.lit(block_rows), F.floor(F.lit(BLOCK_BYTES) / (2 * dim)))).cast("long")


def _divide(rows: DataFrame, large: DataFrame) -> DataFrame:
    """rows of the regions in large (path, n, room), each in the part of its nearest pivot: path grows by the pivot's number."""
    parts = F.least(F.lit(PIVOTS), F.ceil(2 * F.col("n") / F.col("room"))).cast("int")
    own = rows.join(large.select("path", parts.alias("parts")), "path")
    h = F.xxhash64("rep", F.length("path"))
    picked = own.select("path", "code", h.alias("h"), "rep", F.pmod(h, F.col("parts")).alias("salt")).groupBy("path", "salt").agg(F.min_by("code", F.struct("h", "rep")).alias("code"))
    pivots = picked.groupBy("path").agg(F.sort_array(F.collect_list("code")).alias("pivots"))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, dims, spot = batch.column("path").to_pylist(), batch.column("dim").to_pylist(), {}
            codes, out = batch.column("code").to_pylist(), np.zeros(batch.num_rows, dtype=object)
            for i, p in enumerate(path):
                spot.setdefault(p, []).append(i)
            for p, at in spot.items():
                dim = dims[at[0]]
                near = pair_squares(_points([codes[i] for i in at], dim), _points(batch.column("pivots")[at[0]].as_py(), dim)).argmin(axis=1)
                out[at] = [f"{p}.{n}" for n in near]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("copies"), pa.array(out, pa.string()), *(batch.column(c) for c in ("dim", "code", "err"))], ["rep", "copies", "path", "dim", "code", "err"])

    return rows.join(pivots, "path").select("rep", "copies", "path", "dim", "code", "err", "pivots").mapInArrow(nearest, "rep long, copies long, path string, dim long, code binary, err double")


def _blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """rows with block: regions are divided level by level until each has room; what can't be parted is dealt by hash."""
    done, left = [], rows
    for _ in range(LEVELS):
        sizes = left.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.first("dim").alias("dim"))
        large = materialize(sizes.withColumn("room", _room(F.col("dim"), block_rows)).where("n > room"), "large")
        done.append(left.join(large, "path", "left_anti"))
        if large.isEmpty():
            left = None
            break
        left = materialize(_divide(left.join(large, "path", "left_semi"), large), "regions")
    if left is not None:
        sizes = left.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.first("dim").alias("dim"))
        parts = sizes.select("path", F.ceil(2 * F.col("n") / _room(F.col("dim"), block_rows)).alias("parts"))
        dealt = left.join(parts, "path").withColumn("path", F.when(F.col("parts") > 2, F.concat("path", F.lit("#"), F.pmod(F.xxhash64("rep"), F.col("parts")).cast("string"))).otherwise(F.col("path")))
        done.append(dealt.select(*rows.columns))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumnRenamed("path", "block")


_PACKED = ["codes", "reps", "weights", "errs", *CoverTree.ARRAYS]


def _packed(placed: DataFrame) -> DataFrame:
    """One row a block: its centre and covering radius, its codes, and its cover tree."""

    def pack(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("rep").to_numpy(), kind="stable")
        dim, reps, weights, err = table.column("dim")[0].as_py(), *(table.column(c).to_numpy()[order] for c in ("rep", "copies", "err"))
        codes = table.column("code").to_pylist()
        x = _points([codes[i] for i in order], dim)
        tree = CoverTree.build(x, err)
        blobs = [b"".join(codes[i] for i in order), reps.astype(np.int64).tobytes(), weights.astype(np.int64).tobytes(), err.tobytes(), *(getattr(tree, k).tobytes() for k in CoverTree.ARRAYS)]
        facts = {"block": table.column("block")[0].as_py(), "dim": dim, "n": len(reps), "weight": int(weights.sum()), "least": int(reps[0]), "centre": codes[order[tree.centre[0]]], "reach": float(tree.radius[0])}
        return pa.table({**{k: [v] for k, v in facts.items()}, **{f"b_{k}": pa.array([b], pa.binary()) for k, b in zip(_PACKED, blobs, strict=True)}})

    schema = "block string, dim long, n long, weight long, least long, centre binary, reach double, " + ", ".join(f"b_{k} binary" for k in _PACKED)
    return placed.groupBy("block").applyInArrow(pack, schema)


def _unpack(row: dict) -> tuple[CoverTree, np.ndarray, np.ndarray]:
    get = lambda k, t: np.frombuffer(row[f"b_{k}"], t)
    tree = CoverTree(_points(row["b_codes"], row["dim"]), get("errs", np.float64), **{k: get(k, t) for k, t in CoverTree.ARRAYS.items()})
    return tree, get("reps", np.int64), get("weights", np.int64)


def _bounded(pairs: DataFrame, cosine: float) -> DataFrame:
    """pairs with verdict by centres (ca, cb) and radii (ra, rb): far, whole or open."""
    chord = _chord(cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c: batch.column(c)  # noqa: B023, E731
            one, other = get("ca").to_pylist(), get("cb").to_pylist()
            d = np.array([float(np.sqrt((((np.frombuffer(a, np.int16).astype(np.float64) - np.frombuffer(b, np.int16)) / CODE) ** 2).sum())) for a, b in zip(one, other, strict=True)])
            ra, rb = get("ra").to_numpy(), get("rb").to_numpy()
            twin = np.array([a == b for a, b in zip(get("a").to_pylist(), get("b").to_pylist(), strict=True)], dtype=bool)
            far, whole = d - ra - rb > chord + EPS, np.where(twin, 2 * ra, d + ra + rb) < chord - EPS
            yield pa.RecordBatch.from_arrays([get("a"), get("b"), pa.array(np.where(far, "far", np.where(whole, "whole", "open")).astype(object), pa.string())], ["a", "b", "verdict"])

    return pairs.select("a", "b", "ca", "cb", "ra", "rb").mapInArrow(run, "a string, b string, verdict string")


def _region_pairs(blocks: DataFrame, placed: DataFrame, cosine: float, report: dict | None) -> DataFrame:
    """(a, b, verdict) of the pairs of blocks that bounds don't drop, opened level by level from the labels' regions.

    A region's ancestors are the beginnings of its name.  An inner region's centre is
    its largest block's, its radius what covers the blocks' own balls around it.
    """
    # every region above a block, and the block itself as its last level
    steps = F.split("block", r"\.")
    depth = F.size(steps)
    chain = blocks.select("block", "n", "centre", "reach", "dim", F.explode(F.sequence(F.lit(1), depth)).alias("level"), steps.alias("steps"), depth.alias("depth"))
    chain = chain.withColumn("region", F.array_join(F.slice("steps", F.lit(1), F.col("level")), "."))
    leaf = (F.col("level") == F.col("depth")).alias("leaf")
    heads = chain.groupBy("region").agg(F.max_by("centre", F.struct("n", "block")).alias("core"))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = batch.column("centre").to_pylist(), batch.column("core").to_pylist()
            d = np.array([float(np.sqrt((((np.frombuffer(a, np.int16).astype(np.float64) - np.frombuffer(b, np.int16)) / CODE) ** 2).sum())) for a, b in zip(one, other, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("region"), batch.column("core"), pa.array(d + batch.column("reach").to_numpy() + EPS), batch.column("leaf"), batch.column("level")], ["region", "core", "radius", "leaf", "level"])

    covered = chain.select("region", "level", "centre", "reach", leaf).join(heads, "region").select("region", "core", "centre", "reach", "leaf", "level").mapInArrow(cover, "region string, core binary, radius double, leaf boolean, level int")
    # a dealt block has its siblings' region as its own name up to the last "#", so it is a leaf beside leaves
    regions = materialize(covered.groupBy("region").agg(F.first("core").alias("core"), F.max("radius").alias("radius"), F.max("leaf").alias("leaf"), F.max("level").alias("level")), "tree")
    parent = F.array_join(F.slice(F.split("region", r"\."), F.lit(1), F.col("level") - 1), ".")
    kids = regions.withColumn("up", F.when(F.col("level") > 1, parent).otherwise(F.regexp_replace("region", "#[0-9]+$", "")))
    # a leaf stands for itself where the other side of its pair is still opened
    opens = materialize(kids.where("level > 1").select(F.col("up").alias("region"), F.col("region").alias("kid")).union(regions.where("leaf").select("region", F.col("region").alias("kid"))).join(regions.select(F.col("region").alias("kid"), "core", "radius", F.col("leaf").alias("ends")), "kid"), "kids")
    root = F.regexp_replace("region", "#[0-9]+$", "")
    tops = regions.where("level = 1").select("region", root.alias("label"), "core", "radius", "leaf")
    side = lambda df, x: df.select(F.col("region").alias(x), *([F.col("label")] if "label" in df.columns else []), F.col("core").alias(f"c{x}"), F.col("radius").alias(f"r{x}"), F.col("leaf").alias(f"l{x}"))
    pairs = side(tops, "a").join(side(tops, "b"), "label").where("a <= b")
    out, counts = [], []
    while True:
        judged = materialize(_bounded(pairs, cosine), "verdicts")
        told = judged.groupBy("verdict").count().collect()
        counts.append({r["verdict"]: r["count"] for r in told})
        ends = regions.where("leaf").select("region")
        both = judged.where("verdict <> 'far'").join(ends.select(F.col("region").alias("a"), F.lit(True).alias("la")), "a", "left").join(ends.select(F.col("region").alias("b"), F.lit(True).alias("lb")), "b", "left")
        both = both.withColumn("ends", F.coalesce(F.col("la") & F.col("lb"), F.lit(False)))
        out.append(both.where("ends").select("a", "b", "verdict"))
        more = materialize(both.where("not ends").select("a", "b"), "open")
        if more.isEmpty():
            break
        kid = lambda x: opens.select(F.col("region").alias(x), F.col("kid").alias(f"k{x}"), F.col("core").alias(f"c{x}"), F.col("radius").alias(f"r{x}"))
        pairs = more.join(kid("a"), "a").join(kid("b"), "b").select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), F.when(F.col("ka") <= F.col("kb"), F.col("ca")).otherwise(F.col("cb")).alias("ca"), F.when(F.col("ka") <= F.col("kb"), F.col("cb")).otherwise(F.col("ca")).alias("cb"), F.when(F.col("ka") <= F.col("kb"), F.col("ra")).otherwise(F.col("rb")).alias("ra"), F.when(F.col("ka") <= F.col("kb"), F.col("rb")).otherwise(F.col("ra")).alias("rb")).dropDuplicates(["a", "b"])
    if report is not None:
        report["region_pairs"] = counts
    pairs = out[0]
    for o in out[1:]:
        pairs = pairs.union(o)
    return materialize(pairs, "pairs")


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, block_rows: int = BLOCK_ROWS, report: dict | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding, label); other columns are ignored.

    Rows are compared when their labels are equal and not null and their vectors
    are as long.  A vector that is null, empty, zero, or has null or non-finite
    components links with nothing, nor does one without a vec_id.  A vec_id names
    one vector: of rows that repeat it one usable vector stands for all (the one of
    the least hash), all of them carry its result, and it is no link of its own.
    kept: the row is the least of its component.  Equal vectors of different ids
    link and are compared once; an empty table gives an empty result.

    report, if given, is filled with what was compared and pruned.
    """
    with scratch() as keep:
        return _near_duplicates(vectors, cosine, block_rows, report, keep)


def _near_duplicates(vectors: DataFrame, cosine: float, block_rows: int, report: dict | None, keep: Callable[..., None]) -> DataFrame:
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))) & F.exists("v", lambda c: c != 0)
    # -0.0 and 0.0 are one component; two hashes of 64 bits are the key of equal vectors
    usable = rows.where(F.coalesce(sound, F.lit(False))).select("vec_id", "label", F.transform("v", lambda c: c + F.lit(0.0)).alias("v")).withColumns({"k1": F.xxhash64("label", "v"), "k2": F.xxhash64(F.lit(11), "v", "label")})
    ids = materialize(usable.groupBy("vec_id").agg(F.min(F.struct("k1", "k2")).alias("k")).select("vec_id", "k.k1", "k.k2"), "ids")
    held = ids.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    whole = usable.groupBy("k1", "k2").agg(F.first("label").alias("label"), F.first("v").alias("v"))
    copies = materialize(held.join(whole, ["k1", "k2"]).withColumn("dim", F.size("v").cast("long")), "vectors")

    placed = materialize(_blocks(materialize(_coded(copies), "codes"), block_rows), "placed")
    blocks = materialize(_packed(placed), "blocks")
    pairs = _region_pairs(blocks.select("block", "n", "centre", "reach", "dim"), placed, cosine, report)

    # pairs of blocks that lie within the chord: sizes are enough
    sizes = blocks.select("block", "n", "weight", "least")
    near = pairs.where("verdict = 'whole'")
    both = near.select(F.col("a").alias("block"), F.col("b").alias("other")).union(near.where("a <> b").select(F.col("b").alias("block"), F.col("a").alias("other")))
    by_block = both.join(sizes.select(F.col("block").alias("other"), "weight", F.col("least").alias("head")), "other").groupBy("block").agg(F.sum("weight").alias("weight"), F.max((F.col("block") == F.col("other"))).alias("own"), F.min("head").alias("head"))
    by_block = materialize(by_block.join(sizes.select("block", "least"), "block"), "wholes")
    in_whole = placed.join(by_block, "block")
    sums = in_whole.select("rep", (F.col("weight") - F.when(F.col("own"), F.col("copies")).otherwise(0)).alias("links"))
    edges = in_whole.select(F.col("rep").alias("a"), F.col("head").alias("b"))

    tasks = materialize(pairs.where("verdict = 'open'").select(F.concat_ws("|", "a", "b").alias("task"), "a", "b"), "tasks")
    ends = tasks.select("task", F.col("a").alias("block"), F.lit(0).alias("side")).union(tasks.where("a <> b").select("task", F.col("b").alias("block"), F.lit(1).alias("side")))

    def compare(table: pa.Table) -> pa.Table:
        ends = sorted(table.to_pylist(), key=lambda r: r["side"])
        s, reps, weights = _unpack(ends[0])
        t, reps_t, weights_t = (s, reps, weights) if len(ends) == 1 else _unpack(ends[1])
        w = coded_links(s, t, weights, weights_t, cosine)
        root = w.roots()
        if s is t:
            ids, links, unsure, side = reps, w.count_x, w.open_x, np.zeros(len(reps), np.int32)
        else:
            ids, links, unsure = np.concatenate([reps, reps_t]), np.concatenate([w.count_x, w.count_y]), np.concatenate([w.open_x, w.open_y])
            side = np.repeat(np.array([0, 1], np.int32), [len(reps), len(reps_t)])
        some = (links > 0) | unsure
        n = int(some.sum()) + 1  # and a row of what was pruned
        facts = lambda values, last, kind: pa.concat_arrays([pa.array(values, kind), pa.array([last], kind)])
        return pa.table({
            "task": pa.array([ends[0]["task"]] * n), "side": facts(side[some], None, pa.int32()), "rep": facts(ids[some], None, pa.int64()), "links": facts(links[some], w.seen, pa.int64()),
            "root": facts(ids[root][some], w.pruned, pa.int64()), "unsure": facts(unsure[some], None, pa.bool_()),
        })

    n_tasks = max(1, tasks.count())
    # few bytes make much work here, so partitions go by tasks and not by bytes
    dealt = ends.join(blocks.select("block", "dim", *[f"b_{k}" for k in _PACKED]), "block").repartition(min(max(n_tasks // 4, parallelism(spark)), 20_000), "task")
    found = materialize(dealt.groupBy("task").applyInArrow(compare, "task string, side int, rep long, links long, root long, unsure boolean"), "links")

    # what codes can't tell: vectors, in double precision
    asked = materialize(found.where("unsure").select("task", "side", "rep"), "unsure")
    fetched = asked.join(copies.select("rep", "copies", "v"), "rep")

    def exact(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        rep, weight, v = table.column("rep").to_numpy(), table.column("copies").to_numpy(), table.column("v").to_pylist()
        order = np.lexsort((rep, side))
        first, second = order[side[order] == 0], order[side[order] == 1]
        a, _, b = table.column("task")[0].as_py().partition("|")
        same = a == b
        x, y = _unit([v[i] for i in first]), _unit([v[i] for i in second])
        cx, cy, root = dual_links(x, x if same else y, weight[first], weight[first] if same else weight[second], cosine, same)
        ids, links = (rep[first], cx) if same else (np.concatenate([rep[first], rep[second]]), np.concatenate([cx, cy]))
        return pa.table({"rep": ids, "links": links.astype(np.int64), "root": ids[root]})

    decided = materialize(fetched.groupBy("task").applyInArrow(exact, "rep long, links long, root long"), "decided")
    if report is not None:
        told = found.where("rep IS NULL").agg(F.sum("links").alias("node_pairs"), F.sum("root").alias("node_pairs_pruned")).first()
        report |= told.asDict() | {"vectors": copies.count(), "blocks": blocks.count(), "block_pairs_compared": tasks.count(), "codes_sent": ends.join(sizes, "block").agg(F.sum("n")).first()[0] or 0, "vectors_fetched": asked.count()}
    told = found.where("rep IS NOT NULL").select("rep", "links", "root").union(decided)
    links = told.select("rep", "links").union(sums).groupBy("rep").agg(F.sum("links").alias("links"))
    joined = connected_components(told.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")).union(edges))
    by_rep = held.join(links, "rep", "left").join(joined.withColumnRenamed("id", "rep"), "rep", "left")
    by_rep = by_rep.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    by_rep = materialize(by_rep, "answers")
    keep(ids, by_rep)
    by_id = ids.join(by_rep, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    out = vectors.select("vec_id").join(by_id, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
