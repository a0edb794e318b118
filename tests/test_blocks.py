"""The blocked, positional index: layout, gaps over partitions, skips, quotations, ranking, zones; soft terms and synonyms; recovery."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from corploom import catalog
from corploom.functions import text as X
from corploom.operators import blocks, fuzzy, index, search, shared, synonyms


@pytest.fixture(scope="module")
def texts():
    """Some frequent words, some that come in few documents next to each other, and rare ones."""
    rng, out = random.Random(5), []
    for i in range(1500):
        words = ["hot"] * (i % 10 < 9) + rng.choices(["a", "b", "c", "d"], [8, 4, 2, 1], k=rng.randrange(1, 12))
        words += ["near"] * (400 <= i < 420) + ["rare"] * (i in (7, 410, 1200)) + ["burst"] * (30 if i in (50, 51) else i % 2)
        rng.shuffle(words)
        out.append((i + 1, f"d{i + 1:05}", "Odd Title" if i % 2 else "even a", " ".join(words)))
    return out


@pytest.fixture(scope="module")
def ix(spark, texts):
    docs = spark.createDataFrame(texts, "n int, docid string, title string, text string").repartition(5)
    return index.build(docs)


def words_of(texts):
    return {n: t.split() for n, _, _, t in texts}


def test_layout(spark, ix, texts):
    want = {(w, n): [i for i, x in enumerate(ws) if x == w] for n, ws in words_of(texts).items() for w in set(ws)}
    got = blocks.entries(ix.blocks.where("zone = 'text'"), "tfs", "places").collect()
    assert {(r["term"], r["docnum"]): r["places"] for r in got} == want
    assert len(got) == len(want) and all(r["tf"] == len(r["places"]) for r in got)
    assert {(r["term"], r["docnum"]) for r in blocks.entries(ix.blocks.where("zone = 'title'")).collect()} == {(w, n) for n, _, t, _ in texts for w in t.lower().split()}
    heads = ix.blocks.collect()
    assert all(r["n"] == len(r["docs"]) <= blocks.BLOCK and r["last"] == r["first"] + r["docs"][-1] and r["max_tf"] == max(r["tfs"]) for r in heads)
    assert {r["n"] for r in heads if r["term"] == "hot"} > {blocks.BLOCK}


def test_a_term_of_nine_documents_in_ten_is_spread(spark):
    """No partition holds a large part of a term that nearly all postings are of, and gaps go on across partitions."""
    rows = spark.range(4000).select(F.when(F.col("id") % 10 < 9, "the").otherwise(F.concat(F.lit("w"), F.col("id"))).alias("term"), (F.col("id") * 3 + 2).alias("docnum"))
    table = index.block_table(rows)
    shares = [r["n"] for r in table.groupBy("part").agg(F.sum("n").alias("n")).collect()]
    assert len(shares) == 4 and max(shares) < 0.4 * 4000
    assert table.where("term = 'the'").select("part").distinct().count() >= 3
    last, want = {}, {}
    for term, doc in sorted((r["term"], r["docnum"]) for r in rows.collect()):
        want[term, doc] = doc - last.get(term, 0)
        last[term] = doc
    assert {(r["term"], r["docnum"]): r["gap"] for r in blocks.gaps(table).collect()} == want
    size = lambda n: max(1, math.ceil(n.bit_length() / 7))
    for r in blocks.list_sizes(table).collect():
        own = [g for (t, _), g in want.items() if t == r["term"]]
        assert (r["df"], r["length"]) == (len(own), size(len(own)) + sum(map(size, own)))


def test_blocks_of_odd_postings(spark):
    """Repeated postings, a first document 0, no postings at all, and batches that end within a block."""
    rows = spark.createDataFrame([("a", 0), ("a", 5), ("a", 5), ("b", 2**40)], "term string, docnum long")
    assert sorted((r["term"], r["docnum"], r["gap"]) for r in index.gaps(rows).collect()) == [("a", 0, 0), ("a", 5, 0), ("a", 5, 5), ("b", 2**40, 2**40)]
    assert index.gaps(rows.limit(0)).count() == 0
    assert index.block_sizes(rows.limit(0)).count() == 0
    many = spark.range(1000).select(F.lit("x").alias("term"), F.col("id").alias("docnum")).coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        table = index.block_table(many)
        assert sorted(r["n"] for r in table.collect())[-1] == blocks.BLOCK
        assert sorted(r["docnum"] for r in blocks.entries(table).collect()) == list(range(1000))
        assert {r["gap"] for r in blocks.gaps(table).where("docnum > 0").collect()} == {1}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def in_order(words, asked, within):
    places = [[i for i, w in enumerate(words) if w == a] for a in asked]
    return any(all(x < y for x, y in itertools.pairwise(p)) and p[-1] - p[0] <= within for p in itertools.product(*places))


def quoted(words, asked):
    return any(words[i : i + len(asked)] == list(asked) for i in range(len(words)))


def test_quotations(ix, texts):
    own = words_of(texts)
    run = lambda q: {r["docnum"] for r in search.find(ix, q).collect()}
    for asked in (("a", "b"), ("a", "a"), ("c", "hot", "d"), ("a", "b", "a"), ("near", "rare"), ("a",)):
        text = " ".join(asked)
        assert run(f'"{text}"') == {n for n, ws in own.items() if quoted(ws, asked)}, asked
        for within in (1, 2, 4) if len(asked) > 1 else ():
            assert run(f'"{text}" / {within}') == {n for n, ws in own.items() if in_order(ws, asked, within)}, (asked, within)
    assert run('"a b" && !c || "d d"') == {n for n, ws in own.items() if quoted(ws, "ab") and "c" not in ws or quoted(ws, "dd")}
    assert run('title:"odd title" && "hot a"') == {n for n, ws in own.items() if n % 2 == 0 and quoted(ws, ["hot", "a"])}
    assert run('!"a b"') == {n for n, ws in own.items() if not quoted(ws, "ab")}
    assert run('""') == set() and run('!""') == set(own) and run('"zzz a"') == set()


def test_plans(ix):
    """No tokenizer and no Python in a search; term and zone reach the scan, which reads no positions where none are asked for."""
    plan = lambda df: df._jdf.queryExecution().toString()  # noqa: E731, SLF001
    one = plan(search.find(ix, "hot && rare"))
    assert "regexp_extract_all" not in one and "Arrow" not in one and "places" not in one.split("Physical Plan")[1]
    assert "In(term, [hot,rare])" in one
    assert "places" in plan(search.find(ix, '"hot rare"')).split("Physical Plan")[1]


def test_skips(ix, texts):
    own = words_of(texts)
    held, read = search.skipped(ix, search.read_query(ix, "hot && near", frequencies=True))
    assert read.count() < held.count()
    for q, has in (("hot && near", lambda w: {"hot", "near"} <= w), ("a && !near && rare", lambda w: {"a", "rare"} <= w and "near" not in w), ('rare && (a || "hot b")', None)):
        got = {r["docnum"] for r in search.find(ix, q).collect()}
        want = {n for n, ws in own.items() if has(set(ws))} if has else {n for n, ws in own.items() if "rare" in ws and ("a" in ws or quoted(ws, ["hot", "b"]))}
        assert got == want, q
    both, all_ = search.skipped(ix, search.read_query(ix, "hot || near", frequencies=True))
    assert both.count() == all_.count()  # either alone is a match: nothing may be skipped


@pytest.mark.parametrize("asked", [["burst"], ["burst", "near"], ["a", "d", "rare"], ["hot", "zzz"], ["b", "c"]])
def test_top_k_is_exact(ix, texts, asked):
    own = words_of(texts)
    df = {w: sum(w in ws for ws in own.values()) for w in asked}
    score = {n: sum(ws.count(w) * math.log(len(own) / df[w]) for w in asked if df[w]) for n, ws in own.items() if set(asked) & set(ws)}
    want = sorted(score, key=lambda n: (-round(score[n], 9), n))[:50]
    got = search.rank(ix, " ".join(asked)).collect()
    assert [r["docnum"] for r in got] == want
    assert all(abs(r["score"] - score[r["docnum"]]) < 1e-9 for r in got)


def test_top_k_reads_fewer_blocks(ix):
    df = search.document_frequencies(ix, {("text", "burst")})
    ranked = search.top_k(ix, {k: math.log(1500 / v) for k, v in df.items()}, 2)
    assert [r["docnum"] for r in ranked.rows.collect()] == [51, 52]
    assert 0 < ranked.read < ranked.held


def test_ranges_of_many_documents(ix, texts, monkeypatch):
    """The same with ranges of many documents each, as in a large corpus."""
    monkeypatch.setattr(search, "RANGES", 16)
    own = words_of(texts)
    assert {r["docnum"] for r in search.find(ix, "hot && near").collect()} == {n for n, ws in own.items() if {"hot", "near"} <= set(ws)}
    test_top_k_is_exact(ix, texts, ["a", "d", "rare"])
    test_top_k_reads_fewer_blocks(ix)


def test_strict_ranking_and_zones(ix, texts):
    own = words_of(texts)
    got = search.rank(ix, "near && a", k=5).collect()
    df = {w: sum(w in ws for ws in own.values()) for w in ("near", "a")}
    score = {n: sum(ws.count(w) * math.log(1500 / df[w]) for w in df) for n, ws in own.items() if {"near", "a"} <= set(ws)}
    assert [r["docnum"] for r in got] == sorted(score, key=lambda n: (-round(score[n], 9), n))[:5]
    zoned = {r["docnum"]: r["score"] for r in search.zone_scores(ix, ["a"], {"text": 1.0, "title": 10.0}).collect()}
    assert zoned == {n: ws.count("a") + 10 * (n % 2) for n, ws in own.items() if "a" in ws or n % 2}
    weighed = search.rank(ix, "a", k=3, weights={"text": 0.0, "title": 2.0}).collect()
    assert [r["docnum"] for r in weighed] == [1, 3, 5]


def test_synonyms(spark, ix, texts):
    own = words_of(texts)
    pairs = spark.createDataFrame([("near", "close"), ("close", "rare"), ("rare", "near"), ("x", "x"), (None, "a"), ("p1", "p2"), ("p2", "p3"), ("p3", "p4"), ("p4", "p5")], "a string, b string")
    classes = synonyms.close(pairs)
    assert {r["word"]: r["class"] for r in classes.collect()} == {"near": "close", "close": "close", "rare": "close", "x": "x", **{f"p{i}": "p1" for i in range(1, 6)}}
    run = lambda q: {r["docnum"] for r in search.find(ix, q, synonyms=classes).collect()}
    assert run("close") == {n for n, ws in own.items() if {"near", "rare"} & set(ws)}
    assert run("Close && a") == {n for n, ws in own.items() if {"near", "rare"} & set(ws) and "a" in ws}
    assert run('"close a"') == {n for n, ws in own.items() if quoted(ws, ["near", "a"]) or quoted(ws, ["rare", "a"])}
    assert {r["docnum"] for r in search.rank(ix, "close", synonyms=classes).collect()} == run("close")
    assert synonyms.close(pairs.limit(0)).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_soft_terms(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcé", k=rng.randrange(0, 16)))
    terms = sorted({word() for _ in range(250)})
    asked = sorted({word() for _ in range(40)} | {"".join(c for c in t if rng.random() > 0.1) for t in terms[:60]} | {""})
    vocab = spark.createDataFrame([(t, i % 7) for i, t in enumerate(terms)], "term string, df long")
    words = spark.createDataFrame([(w,) for w in [*asked, asked[0], None]], "word string")
    for distance, letters in ((2, 10), (2, 3), (1, 4)):
        got = fuzzy.suggest_many(words, fuzzy.deletion_index(vocab, distance, letters), distance, 0, letters).collect()
        want = {(w, t, edits(w, t)) for w in asked for t in terms if edits(w, t) <= distance}
        assert {(r["word"], r["term"], r["distance"]) for r in got} == want and len(got) == len(want)
    top = fuzzy.suggest_many(words, fuzzy.deletion_index(vocab), limit=1).collect()
    assert len(top) == len({r["word"] for r in top}) and all(r["nth"] == 1 for r in top)


def test_own_tokenizer(spark):
    docs = spark.createDataFrame([("1", "T", "x1;y2;x1"), ("2", None, None)], "docid string, title string, text string")
    built = index.build(docs, mode=lambda text: F.split(text, ";"))
    assert {(r["term"], r["df"]) for r in built.vocab.collect()} == {("x1", 1), ("y2", 1)}
    assert built.meta.first()["tokenizer"] == "own"
    speed = index.speed(built).first()
    assert speed["docs_count"] == 2 and speed["build_seconds"] > 0


def test_stemmed_places(spark):
    docs = spark.createDataFrame([("1", "t", "машины кино машиной"), ("2", "t", "кино")], "docid string, title string, text string")
    built = index.build(docs, stemmer=X.stem)
    got = {(r["term"], r["docnum"]): (r["tf"], r["places"]) for r in blocks.entries(built.blocks.where("zone = 'text'"), "tfs", "places").collect()}
    assert got == {("машин", 1): (2, [0, 2]), ("кин", 1): (1, [1]), ("кин", 2): (1, [0])}


def test_empty_corpus(spark):
    built = index.build(spark.createDataFrame([], "docid string, title string, text string"))
    assert built.vocab.count() == 0
    assert search.find(built, '"a b" || !c').count() == 0
    assert search.rank(built, "a b").count() == 0


def test_saved_elsewhere(spark, ix, tmp_path, texts):
    again = index.Index.open(spark, ix.save(str(tmp_path / "copy")).folder)
    gaps = lambda i: sorted(map(tuple, blocks.gaps(i.blocks).collect()))
    assert gaps(again) == gaps(ix)
    assert search.find(again, "near && rare").count() == sum({"near", "rare"} <= set(ws) for ws in words_of(texts).values())


def test_a_lost_index_is_built_again(spark):
    sf = "/root/testdata/sf0.001"
    run = lambda: catalog.QUERIES["bool_and"](spark, sf).count()
    first = run()
    lost = catalog._index(spark, sf).folder  # noqa: SLF001
    shared.release_folder(spark, lost)
    assert not shared.exists(spark, lost)
    assert run() == first
    assert catalog._index(spark, sf).folder != lost  # noqa: SLF001


def test_work_tables_go(spark):
    """A build leaves its index alone in the work folder."""
    held = len(shared._made)  # noqa: SLF001
    built = index.build(spark.createDataFrame([("1", "t", "x y")], "docid string, title string, text string"))
    left = [p for _, p in shared._made[held:] if shared.exists(spark, p)]  # noqa: SLF001
    assert built.folder in left and len(left) <= 3


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master, applicationId, _jsc = "spark://host:7077", "app", spark.sparkContext._jsc  # noqa: SLF001, N815

    class Session:
        sparkContext, conf = Context, type("Conf", (), {"get": staticmethod(lambda key, default: None)})  # noqa: N815

    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():  # noqa: SLF001
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared.work_folder(Session)
