"""Search over an index: one query, a batch in one job, ranked results, pages, documents.

``find`` and ``rank`` read the blocks of an index; ``matches`` and its kin take any
postings (term, docnum).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corploom.functions import text as X
from corploom.plans.boolean import BINDS, Leaf, compile_query, lex, postfix, read_leaf, required

from . import blocks as B
from .index import Index
from .synonyms import classes_of

PAGE = 50
ZONES = (B.TEXT, "title")
RANGES = 1 << 16  # document ranges that skips and bounds are told for, whatever the number of documents


def lookup(words: list[str], vocab: DataFrame | None, postings: DataFrame) -> DataFrame:
    """(word, docnum): postings of each word, of its lower case where the word itself is in no document.

    The words are the query's own, so the filter on term is an IN list that
    reaches the scan.  Only words that have a lower case of their own ask the
    vocabulary (without one, the postings) whether they exist.
    """
    spark = postings.sparkSession
    plain, capital = [w for w in sorted(set(words)) if w == w.lower()], [w for w in sorted(set(words)) if w != w.lower()]
    held = postings.where(F.col("term").isin(*plain)).select(F.col("term").alias("word"), "docnum")
    if not capital:
        return held
    known = (vocab if vocab is not None else postings).where(F.col("term").isin(*capital)).select("term").distinct()
    wanted = spark.createDataFrame([(w, w.lower()) for w in capital], "word string, low string")
    term = wanted.join(F.broadcast(known), F.col("word") == F.col("term"), "left").select("word", F.coalesce("term", "low").alias("term"))
    asked = sorted({*capital, *(w.lower() for w in capital)})
    return held.union(postings.where(F.col("term").isin(*asked)).join(F.broadcast(term), "term").select("word", "docnum"))


def _flags(names: dict[str, str], vocab: DataFrame | None, postings: DataFrame) -> DataFrame:
    """(docnum, a flag for each word) of the documents that have any: names maps words to the flags' names."""
    found = lookup(list(names), vocab, postings)
    return found.groupBy("docnum").agg(*[F.max(F.col("word") == w).alias(name) for w, name in names.items()])


def matches(query: str, postings: DataFrame, forward: DataFrame, adjacency: str = "last", vocab: DataFrame | None = None) -> DataFrame:
    """forward rows (docnum, docid, title) that satisfy the query, unordered.

    One pass: a flag for each word by document, then the compiled condition.  A
    query that can't match a document without any of its words becomes an inner
    join by Catalyst; only a NOT at the top scans the whole forward table.
    """
    compiled = compile_query(query, adjacency)
    rows = forward.select("docnum", "docid", "title")
    if not compiled.terms:
        return rows.where(compiled.condition)
    return rows.join(_flags(compiled.terms, vocab, postings), "docnum", "left").where(compiled.condition).select("docnum", "docid", "title")


@dataclass
class Reading:
    """A query of the wider dialect, read against an index: its leaves, and for each word the indexed terms that stand for it."""

    form: list[str]
    leaves: dict[str, Leaf]
    terms: dict[tuple[str, str], list[str]] = field(default_factory=dict)
    df: dict[tuple[str, str], int] = field(default_factory=dict)

    def keys(self, lexemes: Sequence[str] | None = None) -> set[tuple[str, str]]:
        """(zone, term) of some leaves, or of all."""
        some = [self.leaves[x] for x in (self.leaves if lexemes is None else lexemes)]
        return {(leaf.zone, t) for leaf in some for w in leaf.words for t in self.terms[leaf.zone, w]}

    def least(self, lexeme: str) -> tuple[int, list[tuple[str, str]]]:
        """The fewest postings that any document of a leaf has to be in, and their keys: of its rarest word."""
        leaf = self.leaves[lexeme]
        each = [[(leaf.zone, t) for t in self.terms[leaf.zone, w]] for w in leaf.words]
        return min((sum(self.df.get(k, 0) for k in keys), keys) for keys in each) if each else (0, [])


def document_frequencies(ix: Index, keys: set[tuple[str, str]]) -> dict[tuple[str, str], int]:
    """df of terms by zone: the texts' from the vocabulary, other zones' from the blocks' heads.  As many rows as keys at most."""
    out: dict[tuple[str, str], int] = {}
    for zone in sorted({z for z, _ in keys}):
        words = [t for z, t in sorted(keys) if z == zone]
        if zone == B.TEXT:
            found = ix.vocab.where(F.col("term").isin(*words)).select("term", "df")
        else:
            found = ix.blocks.where((F.col("zone") == zone) & F.col("term").isin(*words)).groupBy("term").agg(F.sum("n").alias("df"))
        out |= {(zone, r["term"]): r["df"] for r in found.collect()}
    return out


def read_query(ix: Index, query: str, adjacency: str = "last", synonyms: DataFrame | None = None, frequencies: bool = False) -> Reading:
    """Lex, order and resolve a query.  A word that no document has gives way to its lower case; synonyms (word, class) let a word stand for its whole class."""
    form = postfix(lex(query, quotes=True), adjacency)
    out = Reading(form, {x: read_leaf(x, ZONES) for x in form if x not in BINDS})
    words = {(leaf.zone, w) for leaf in out.leaves.values() for w in leaf.words}
    out.terms = {k: [k[1]] for k in words}
    if frequencies or any(w != w.lower() for _, w in words):
        known = document_frequencies(ix, words | {(z, w.lower()) for z, w in words})
        out.terms = {(z, w): [w if (z, w) in known else w.lower()] for z, w in words}
        out.df = known
    if synonyms is not None:
        members = classes_of(synonyms, {t for ts in out.terms.values() for t in ts})
        out.terms = {k: sorted({m for t in ts for m in members.get(t, [t])}) for k, ts in out.terms.items()}
        if frequencies:
            out.df |= document_frequencies(ix, out.keys() - out.df.keys())
    return out


def _is_key(keys: Sequence[tuple[str, str]]) -> Column:
    """Whether a row is of one of the keys: an IN list a zone, which reaches the scan."""
    by_zone = {z: [t for y, t in sorted(keys) if y == z] for z in sorted({z for z, _ in keys})}
    return reduce(lambda a, b: a | b, [(F.col("zone") == z) & F.col("term").isin(*ts) for z, ts in by_zone.items()], F.lit(False))


def _shift(ix: Index) -> int:
    """Documents to a range, as a power of two, so that RANGES ranges hold all."""
    top = ix.forward.agg(F.max("docnum")).first()[0] or 0
    return max(0, int(top).bit_length() - (RANGES.bit_length() - 1))


def in_ranges(blocks: DataFrame, wanted: np.ndarray, shift: int) -> DataFrame:
    """The blocks that may hold a document of a wanted range (a boolean a range): no block is decoded, and none is looked at twice.

    How many wanted ranges lie before each range goes to all tasks, RANGES numbers
    at most; a block's own first and last range are all that is compared.
    """
    spark = blocks.sparkSession
    upto = np.concatenate([[0], np.cumsum(wanted)]).tolist()
    table = spark.createDataFrame([(upto,)], "__upto array<int>")
    place = lambda c: F.least(F.shiftright(c, shift), F.lit(len(wanted) - 1)).cast("int")
    hit = F.get("__upto", place("last") + 1) > F.get("__upto", place("first"))
    return blocks.crossJoin(F.broadcast(table)).where(hit).drop("__upto")


def skipped(ix: Index, reading: Reading) -> tuple[DataFrame, DataFrame]:
    """(held, read): the blocks of a query's terms, and those that can matter.

    Where every match must hold some leaf, the rarest word of such a leaf is decoded
    alone; of all other words only blocks whose ranges its documents fall in are read.
    """
    keys = reading.keys()
    held = ix.blocks.where(_is_key(sorted(keys)))
    must = [reading.least(x) for x in sorted(required(reading.form) & reading.leaves.keys()) if reading.leaves[x].words]
    if not must or len(keys) < 2 or not reading.df:
        return held, held
    size, rare = min(must)
    if max(reading.df.get(k, 0) for k in keys) < 2 * B.BLOCK + size:  # nothing is long enough to be skipped
        return held, held
    shift = _shift(ix)
    at = F.least(F.shiftright("docnum", shift), F.lit(RANGES - 1)).cast("int")
    rows = B.entries(ix.blocks.where(_is_key(rare))).select(at.alias("at")).distinct().collect() if rare else []  # RANGES at most
    wanted = np.zeros(RANGES, dtype=np.int64)
    wanted[[r["at"] for r in rows]] = 1
    return held, in_ranges(held, wanted, shift)


def in_a_row(places: list[Column]) -> Column:
    """Whether positions, an array a word, have the words one behind the other."""
    begin = lambda i: lambda x: x - i
    return F.size(reduce(F.array_intersect, [F.transform(p, begin(i)) for i, p in enumerate(places)])) > 0


def in_order(places: list[Column], within: int) -> Column:
    """Whether the words stand in order, each at a place of its own, the last at most within places behind the first.

    Places are passed in ascending order once; what is kept is, for each beginning of
    the list of words, the latest place where it can have begun.
    """
    n = len(places)
    # among words that share a place the later one goes first, so no place serves two
    event = lambda i: lambda x: F.struct(x.alias("at"), F.lit(-i).alias("word"))
    events = F.array_sort(F.flatten(F.array(*[F.transform(p, event(i)) for i, p in enumerate(places)])))
    zero = F.struct(F.array(*[F.lit(None).cast("int")] * n).alias("begun"), F.lit(False).alias("hit"))

    def step(s: Column, e: Column) -> Column:
        word = -e["word"]
        begin = F.when(word == 0, e["at"]).otherwise(F.get(s["begun"], word - 1))
        done = (word == n - 1) & F.coalesce(e["at"] - begin <= within, F.lit(False))
        return F.struct(F.transform(s["begun"], lambda b, j: F.when(j == word, begin).otherwise(b)).alias("begun"), (s["hit"] | done).alias("hit"))

    return F.aggregate(events, zero, step, lambda s: s["hit"])


def _holds(reading: Reading, leaf: Leaf) -> Column:
    return _is_key([(leaf.zone, t) for w in leaf.words for t in reading.terms[leaf.zone, w]])


def find(ix: Index, query: str, adjacency: str = "last", synonyms: DataFrame | None = None, score: bool = False) -> DataFrame:
    """forward rows (docnum, docid, title) that satisfy a query of the wider dialect, unordered; score adds the sum of tf * ln(N / df) over its words.

    The blocks of all words are read once, less those that skips rule out; positions
    are read only where the query has a quotation.  Words under a NOT score as others do, but
    documents that hold them are mostly out.
    """
    form = postfix(lex(query, quotes=True), adjacency)
    words = {(leaf.zone, w) for leaf in (read_leaf(x, ZONES) for x in form if x not in BINDS) for w in leaf.words}
    narrow = bool(required(form)) and len(words) > 1  # only then can a rare word spare blocks of another
    reading = read_query(ix, query, adjacency, synonyms, frequencies=score or narrow)
    names = {x: f"t{i}" for i, x in enumerate(reading.leaves)}
    condition = compile_query(query, adjacency, lambda x: F.coalesce(F.col(names[x]), F.lit(False)), quotes=True).condition
    rows = ix.forward.select("docnum", "docid", "title")
    if not reading.keys():
        empty = rows.withColumns({n: F.lit(False) for n in names.values()}).where(condition).select("docnum", "docid", "title")
        return empty.withColumn("score", F.lit(0.0)) if score else empty
    quoted = {x: leaf for x, leaf in reading.leaves.items() if len(leaf.words) != 1}
    columns = [*(["tfs"] if score else []), *(["places"] if quoted else [])]
    posted = B.entries(skipped(ix, reading)[1], *columns)
    aggs = [F.max(_holds(reading, leaf)).alias(names[x]) for x, leaf in reading.leaves.items() if x not in quoted]
    for x, leaf in quoted.items():
        for j, w in enumerate(leaf.words):
            own = F.when(_is_key([(leaf.zone, t) for t in reading.terms[leaf.zone, w]]), F.col("places"))
            aggs.append(F.array_sort(F.flatten(F.collect_list(own))).alias(f"{names[x]}_{j}"))  # of one document, all its places
    if score:
        total = ix.forward.count()
        gain = [F.coalesce(F.max(F.when(_is_key([k]), F.col("tf"))), F.lit(0)) * F.lit(math.log(total / reading.df[k])) for k in sorted(reading.keys()) if reading.df.get(k)]
        aggs.append(reduce(lambda a, b: a + b, gain, F.lit(0.0)).alias("score"))
    flags = posted.groupBy("docnum").agg(*aggs)
    for x, leaf in quoted.items():
        places = [F.col(f"{names[x]}_{j}") for j in range(len(leaf.words))]
        there = reduce(lambda a, b: a & b, [F.size(p) > 0 for p in places], F.lit(bool(places)))
        near = F.lit(False) if not places else in_a_row(places) if leaf.within is None else in_order(places, leaf.within)
        flags = flags.withColumn(names[x], there & near)
    found = rows.join(flags, "docnum", "left").where(condition)
    return found.select("docnum", "docid", "title", *([F.coalesce("score", F.lit(0.0)).alias("score")] if score else []))


@dataclass
class Ranked:
    """The best documents; the blocks of the query's terms, and those of them that were read."""

    rows: DataFrame
    held_blocks: DataFrame
    read_blocks: DataFrame

    @property
    def held(self) -> int:
        return self.held_blocks.count()

    @property
    def read(self) -> int:
        return self.read_blocks.count()


def _scores(blocks: DataFrame, gains: dict[tuple[str, str], float]) -> DataFrame:
    """(docnum, score): gains by (zone, term) times tf, added up in one order."""
    each = [F.coalesce(F.max(F.when(_is_key([k]), F.col("tf"))), F.lit(0)) * F.lit(g) for k, g in sorted(gains.items())]
    return B.entries(blocks, "tfs").groupBy("docnum").agg(reduce(lambda a, b: a + b, each).alias("score"))


def best(scored: DataFrame, k: int) -> DataFrame:
    """The k highest scores; scores that agree to nine places are ties, in order of docnum."""
    return scored.orderBy(F.desc(F.round("score", 9)), "docnum").limit(k)


def top_k(ix: Index, gains: dict[tuple[str, str], float], k: int = PAGE) -> Ranked:
    """The k documents with the highest sum of gain * tf over the terms, without reading blocks that can't hold one; exact.

    The heads of the blocks bound what a document of each range can score.  The most
    promising ranges are scored first; their k-th score is a floor that the answer
    can't fall below, and ranges whose bound is under it are never decoded.
    """
    held = ix.blocks.where(_is_key(sorted(gains)))
    shift = _shift(ix)
    most = reduce(lambda a, kv: F.when(_is_key([kv[0]]), F.col("max_tf") * F.lit(kv[1])).otherwise(a), gains.items(), F.lit(0.0))
    at = lambda c: F.least(F.shiftright(c, shift), F.lit(RANGES - 1)).cast("int")
    # blocks of a term follow each other, so all of them together cover RANGES ranges, and one more each
    spread = held.select("term", "zone", (F.col("n") / (at("last") - at("first") + 1)).alias("n"), most.alias("most"), F.explode(F.sequence(at("first"), at("last"))).alias("at"))
    by_term = spread.groupBy("at", "term", "zone").agg(F.max("most").alias("most"), F.sum("n").alias("n"))
    bounds = by_term.groupBy("at").agg(F.sum("most").alias("most"), F.max("n").alias("n")).collect()  # RANGES rows at most
    bound, docs = np.full(RANGES, -1.0), np.zeros(RANGES)
    for r in bounds:
        bound[r["at"]], docs[r["at"]] = r["most"], r["n"]
    order = np.argsort(-bound, kind="stable")
    seed = np.zeros(RANGES, dtype=np.int64)
    seed[order[: int(np.searchsorted(np.cumsum(docs[order]), 4 * k)) + 1]] = 1
    first = best(_scores(in_ranges(held, seed, shift), gains), k).collect()
    # a document of the seed may lie in blocks that weren't read, so its score is from below: what a floor must be
    floor = first[-1]["score"] - 1e-8 if len(first) == k else -1.0
    alive = ((bound >= floor) & (bound >= 0)).astype(np.int64)
    near = in_ranges(held, alive, shift)
    return Ranked(best(_scores(near, gains), k), held, near)


def rank(ix: Index, query: str, k: int = PAGE, adjacency: str = "last", synonyms: DataFrame | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """(docnum, docid, title, score): the k best by tf * ln(N / df), ties by docnum.

    Plain words are a soft query: a document needs any of them, and blocks that can't
    hold one of the best are skipped.  With operators or quotations the query
    decides and the scores order.  weights gives zones of a soft query their factors
    (default: the text alone); df is the text's.
    """
    form = postfix(lex(query, quotes=True), adjacency)
    leaves = [read_leaf(x, ZONES) for x in form if x not in BINDS]
    if len(leaves) < len(form) or any(len(leaf.words) != 1 for leaf in leaves):
        return best(find(ix, query, adjacency, synonyms, score=True), k)
    reading = read_query(ix, query, adjacency, synonyms, frequencies=True)
    total = ix.forward.count()
    weights = weights or {B.TEXT: 1.0}
    gains = {(zone, t): w * math.log(total / reading.df[B.TEXT, t]) for z, t in reading.keys() if z == B.TEXT and reading.df.get((B.TEXT, t)) for zone, w in weights.items()}
    if not gains:
        return ix.forward.select("docnum", "docid", "title").where(F.lit(False)).withColumn("score", F.lit(0.0))
    top = top_k(ix, gains, k).rows
    return best(top.join(ix.forward.select("docnum", "docid", "title"), "docnum").select("docnum", "docid", "title", "score"), k)


def tf_idf(ix: Index, words: list[str]) -> DataFrame:
    """(docnum, score) of every document with one of the words: sum of tf * ln(N / df)."""
    total = ix.forward.count()
    gains = {k: math.log(total / df) for k, df in document_frequencies(ix, {(B.TEXT, w) for w in words}).items()}
    return _scores(ix.blocks.where(_is_key(sorted(gains))), gains) if gains else ix.forward.select("docnum", F.lit(0.0).alias("score")).where(F.lit(False))


def zone_scores(ix: Index, words: list[str], weights: dict[str, float]) -> DataFrame:
    """(docnum, score): occurrences of the words in each zone by the zone's weight, from the blocks of these words alone."""
    return _scores(ix.blocks.where(_is_key([(z, w) for z in weights for w in words])), {(z, w): float(g) for z, g in weights.items() for w in words})


def search(query: str, postings: DataFrame, forward: DataFrame, adjacency: str = "last", limit: int = PAGE, vocab: DataFrame | None = None) -> DataFrame:
    """The first limit matches by docnum."""
    return matches(query, postings, forward, adjacency, vocab).orderBy("docnum").limit(limit)


@dataclass
class Page:
    total: int
    pages: int
    page: int
    first: int
    last: int
    rows: list


def page_count(found: DataFrame) -> DataFrame:
    """(total, pages): pages is 1 at least."""
    total = F.count(F.lit(1))
    return found.agg(total.alias("total"), F.greatest(F.lit(1), F.ceil(total / PAGE)).cast("long").alias("pages"))


def search_page(query: str, page: int, postings: DataFrame, forward: DataFrame, adjacency: str = "last", vocab: DataFrame | None = None) -> Page:
    """A page of matches; page numbers outside are moved to the nearest page."""
    return page_of(matches(query, postings, forward, adjacency, vocab), page)


def page_of(found: DataFrame, page: int, *order: Column | str) -> Page:
    """A page of found rows in an order (default: docnum)."""
    count = page_count(found).first()
    page = min(max(1, page), count["pages"])
    start = (page - 1) * PAGE
    rows = found.orderBy(*(order or ("docnum",))).offset(start).limit(PAGE).collect()
    return Page(count["total"], count["pages"], page, start + 1, min(start + PAGE, count["total"]), rows)


def document(docnum: int, forward: DataFrame, corpus: DataFrame, snippet: int = 1000) -> DataFrame:
    """(docnum, docid, title, snippet, text) of one document, or no row."""
    one = forward.where(F.col("docnum") == docnum).select("docnum", "docid", "title")
    return one.join(corpus.select("docid", "text"), "docid", "left").select("docnum", "docid", "title", F.substring("text", 1, snippet).alias("snippet"), "text")


def search_many(queries: list[tuple[int, str]], postings: DataFrame, forward: DataFrame, adjacency: str = "last", limit: int = PAGE, vocab: DataFrame | None = None) -> DataFrame:
    """(query_id, nth, docnum, docid, title): the first limit matches of every query, in one job.

    The postings of all words are read once and turned into one row of flags a
    document; each query is a condition over that row.  The query list is the
    caller's, on the driver already.
    """
    words = sorted({w for _, q in queries for w in compile_query(q, adjacency).terms})
    names = {w: f"w{i}" for i, w in enumerate(words)}
    rows = forward.select("docnum", "docid", "title")
    if words:
        rows = rows.join(_flags(names, vocab, postings), "docnum", "left")
    says = lambda q: compile_query(q, adjacency, lambda w: F.coalesce(F.col(names[w]), F.lit(False))).condition
    hits = F.filter(F.array(*[F.when(says(q), F.lit(n)) for n, q in queries]), lambda x: x.isNotNull())
    hit = rows.select("docnum", "docid", "title", F.explode(hits).alias("query_id"))
    order = Window.partitionBy("query_id").orderBy("docnum")
    return hit.withColumn("nth", F.row_number().over(order).cast("long")).where(F.col("nth") <= limit).select("query_id", "nth", "docnum", "docid", "title")


def suggest(word: str, vocab: DataFrame, distance: int = 2, limit: int = 10) -> DataFrame:
    """(term, distance, df): terms within so many edits of a word, the nearest first, then the most frequent - for spell-checking and soft matches."""
    word = word.lower()
    size = F.char_length("term")
    able = vocab.where((size >= len(word) - distance) & (size <= len(word) + distance))
    far = F.levenshtein(F.col("term"), F.lit(word), distance)
    return able.select("term", far.cast("long").alias("distance"), "df").where("distance >= 0").orderBy("distance", F.desc("df"), "term").limit(limit)


def biased_snippet(text: Column, words: list[str], sentences: int = 2) -> Column:
    """The run of so many sentences that has the most different words of a query, the first among equals; null for a null text."""
    parts = F.split(text, r"(?<=[.!?])\s+|\n+")
    asked = F.array(*[F.lit(w.lower()) for w in words])
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - sentences + 1)), lambda i: F.struct(
        F.size(F.array_intersect(asked, F.regexp_extract_all(F.lower(F.array_join(F.slice(parts, i, sentences), " ")), F.lit(X.TOKEN), 0))).alias("n"), (-i).alias("at"), F.array_join(F.slice(parts, i, sentences), " ").alias("run"),
    ))
    return F.array_max(runs)["run"]


def snippets(corpus: DataFrame, query: str, docids: list[str], sentences: int = 2) -> DataFrame:
    """(docid, snippet) of a page of documents: the sentences with the most different words of the query."""
    leaves = [read_leaf(x, ZONES) for x in lex(query, quotes=True) if x not in (*BINDS, "(", ")")]
    words = sorted({w for leaf in leaves for w in leaf.words})
    return corpus.where(F.col("docid").isin(*docids)).select("docid", biased_snippet(F.col("text"), words, sentences).alias("snippet"))


def by_set_operations(query: str, postings: DataFrame, forward: DataFrame, adjacency: str = "last", vocab: DataFrame | None = None) -> DataFrame:
    """(docnum) by INTERSECT, UNION and EXCEPT: the query's set algebra spelt out."""
    universe, empty = forward.select("docnum"), forward.select("docnum").where(F.lit(False))
    stack: list[DataFrame] = []
    take = lambda: stack.pop() if stack else empty
    for x in postfix(lex(query), adjacency):
        if x == "!":
            stack.append(universe.exceptAll(stack.pop()) if stack else universe)
        elif x in ("&&", "||"):
            b, a = take(), take()
            stack.append(a.intersect(b) if x == "&&" else a.union(b).distinct())
        else:
            stack.append(lookup([x], vocab, postings).select("docnum"))
    return stack[-1] if stack else empty


def phrase(words: list[str], positions: DataFrame, window: int | None = None) -> DataFrame:
    """(docnum) where the words stand in a row, or, with window, in order with the last at most so many places behind the first: positions (docnum, term, pos).

    Repeated words need a place each.
    """
    each = [F.array_sort(F.collect_list(F.when(F.col("term") == w, F.col("pos")))).alias(f"p{i}") for i, w in enumerate(words)]
    held = positions.where(F.col("term").isin(*words)).groupBy("docnum").agg(*each)
    places = [F.col(f"p{i}") for i in range(len(words))]
    return held.where(in_a_row(places) if window is None else in_order(places, window)).select("docnum")
