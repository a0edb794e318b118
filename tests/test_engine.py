"""Sources, corpus preparation, index, statistics, verification, crawl, streaming, command line and pages."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corploom import cli, web
from corploom.functions import text as X
from corploom.operators import corpus, index, search, statistics, verify
from corploom.sources import crawl, files

DOCS = [("d1", "One", "Кино и машины"), ("d2", "Two", "кино, машиной!"), ("d3", "Three", "рок-н-ролл --"), ("d4", "Four", "")]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("ix")
    parts = root / "parts"
    parts.mkdir()
    (parts / "part_001.tsv").write_text("id\ttitle\ttext\n" + "\n".join("\t".join(d) for d in DOCS[:2]) + "\n\nshort\trow\n", encoding="utf-8")
    (parts / "part_002.tsv").write_text("docid\ttitle\ttext\n" + "\n".join("\t".join(d) for d in DOCS[2:]) + "\n", encoding="utf-8")
    rows = files.read_parts(spark, str(parts))
    return rows, index.build(rows).save(str(root / "index")), str(parts), str(root / "index")


def test_parts(built):
    rows, *_ = built
    assert sorted((r["docid"], r["text"]) for r in rows.collect()) == sorted((d[0], d[2]) for d in DOCS)


def test_index(built):
    _, ix, *_ = built
    assert [(r["docnum"], r["docid"], r["n_tokens"]) for r in ix.forward.orderBy("docnum").collect()] == [(1, "d1", 3), (2, "d2", 2), (3, "d3", 1), (4, "d4", 0)]
    vocab = ix.vocab.orderBy("term").collect()
    assert [r["term"] for r in vocab] == ["и", "кино", "машиной", "машины", "рок-н-ролл"]
    assert [r["offset"] for r in vocab] == list(np.cumsum([0] + [r["length"] for r in vocab])[:-1])
    meta = ix.meta.first()
    assert (meta["docs_count"], meta["total_tokens"], meta["unique_terms"], meta["stemmed"]) == (4, 6, 5, False)
    assert [r["docid"] for r in search.search("Кино", ix.postings, ix.forward).collect()] == ["d1", "d2"]
    assert [r["docid"] for r in search.search("!кино", ix.postings, ix.forward).collect()] == ["d3", "d4"]


def test_stemmed_counts(built, spark):
    rows, *_ = built
    both = rows.withColumn("text", F.concat("text", F.lit(" машинах машины")))
    stemmed = index.build(both, stemmer=X.stem)
    r = stemmed.vocab.where("term = 'машин'").first()
    assert (r["df"], r["df_postings"]) == (4, 9)  # two or three forms in a document are one document


def test_sample_and_whitespace(built):
    rows, *_ = built
    assert index.build(rows, sample=2).forward.count() == 2
    white = index.build(rows, mode="whitespace")
    assert {r["term"] for r in white.vocab.collect()} == {"Кино", "и", "машины", "кино,", "машиной!", "рок-н-ролл"}


def test_verify(built):
    rows, ix, *_ = built
    numbered = index.number(rows)
    assert all(r["mismatches"] == 0 for r in verify.verify(ix.vocab, ix.postings, numbered).collect())
    bad = ix.postings.union(ix.postings.sparkSession.createDataFrame([("кино", 3), ("кино", 99)], "term string, docnum long"))
    assert {r["term"]: r["mismatches"] for r in verify.verify(ix.vocab, bad, numbered).collect()}["кино"] == 2
    assert verify.verify_all(bad, index.document_terms(numbered)).first().asDict() == {"unsupported": 2, "missing": 0}


def test_prepare(spark):
    raw = spark.createDataFrame([(0, "a", "T", "кино это", 10), (1, "a", "T2", "x", 5), (2, None, "T3", "yy", 5), (3, "", "T4", "", 1), (4, "b", None, None, 2)], "input_no long, id string, title string, text string, line_bytes long")
    kept, rejects, stats = corpus.prepare(raw)
    assert sorted(tuple(r) for r in kept.collect()) == [(0, "a", "T", "киноэто"), (4, "b", "", "")]
    assert sorted((r["kind"], r["input_no"]) for r in rejects.collect()) == [("DUPLICATE", 1), ("MISSING_ID", 2), ("MISSING_ID", 3)]
    s = stats.first()
    assert (s["input_docs"], s["unique_docs"], s["raw_bytes"], s["text_bytes"], s["unique_bytes"], s["avg_compat"], s["avg_unique"]) == (5, 2, 23, 17, 14, 8.5, 7.0)
    assert "unique documents: 2" in corpus.info_text(stats).first()[0]
    assert corpus.prepare(raw.limit(0))[2].first()["avg_compat"] == 0.0


def test_numbering_many_partitions(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k")).repartition(13)
    got = corpus.number_rows(df, "k").orderBy("k").collect()
    assert [r["docnum"] for r in got] == list(range(1, 5001))
    assert corpus.number_rows(df.limit(0), "k").count() == 0


def test_raw_json(spark, tmp_path):
    good = tmp_path / "docs.jsonl"
    good.write_text('{"id":"1","title":"t","text":"x"}\n\n{"id":"2"}\n')
    assert [(r["id"], r["text"], r["line_bytes"]) for r in files.read_raw(spark, str(good)).orderBy("id").collect()] == [("1", "x", 34), ("2", None, 11)]
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"id":')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_raw(spark, str(bad)).collect()


def test_small_sources(spark, tmp_path):
    assert files.read_titles(spark, str(tmp_path / "none.txt")).count() == 0
    (tmp_path / "t.txt").write_text(" a \n\nb\n")
    assert sorted(r[0] for r in files.read_titles(spark, str(tmp_path / "t.txt")).collect()) == ["a", "b"]
    (tmp_path / "v.tsv").write_text("x\t3\t0\t4\ny\tbad\nz\n")
    assert [tuple(r) for r in files.read_vocab(spark, str(tmp_path / "v.tsv"), strict=False).collect()] == [("x", 3)]
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_vocab(spark, str(tmp_path / "v.tsv")).collect()
    (tmp_path / "q.txt").write_text("# c\n\n a && b \n")
    assert [r[0] for r in files.read_queries(spark, str(tmp_path / "q.txt")).collect()] == ["# c", "a && b"]


def test_write_parts(spark, tmp_path):
    df = spark.range(25).select(F.col("id").cast("string").alias("docid"), F.lit("t").alias("title"), F.lit("x").alias("text"))
    files.write_parts(df.coalesce(1), str(tmp_path / "out"), 10)
    assert sorted(sum(1 for _ in p.open()) for p in (tmp_path / "out").glob("part-*")) == [5, 10, 10]


def test_zipf(spark):
    vocab = spark.createDataFrame([(f"t{i}", max(0, 1000 // (i + 1)) if i < 30 else 0) for i in range(40)], "term string, df long")
    r = statistics.zipf_report(vocab).first()
    y = np.array([1000 // (i + 1) for i in range(30)], float)
    slope, intercept = np.polyfit(np.log(np.arange(1, 31)), np.log(y), 1)
    assert (r["total_terms"], r["n"]) == (40, 30)
    assert abs(r["slope"] - slope) < 1e-9
    assert abs(r["intercept"] - intercept) < 1e-9
    flat = statistics.zipf_fit(spark.createDataFrame([(1, 5), (2, 5)], "rank long, df long")).first()
    assert (flat["r2"], flat["slope"]) == (0.0, 0.0)
    assert statistics.zipf_fit(spark.createDataFrame([(1, 5)], "rank long, df long")).first()["slope"] is None


def test_statistics(spark):
    docs = spark.createDataFrame([(1, "b a a"), (2, "a c b"), (3, None)], "docnum long, text string")
    assert statistics.token_stats(docs).first().asDict() == {"docs_processed": 3, "total_tokens": 6, "unique_terms": 3}
    assert [(r["term"], r["cf"]) for r in statistics.top_terms(statistics.term_counts(docs)).collect()] == [("a", 3), ("b", 2), ("c", 1)]
    pair = statistics.collocations(spark.createDataFrame([(1, "x y x y x y z")], "docnum long, text string"), least=2).where("a = 'x'").first()
    assert (pair["b"], pair["n"]) == ("y", 3)
    judged = spark.createDataFrame([(1, 1, 3, 3), (1, 2, 0, 3), (1, 3, 2, 3)], "query_id int, rank int, grade int, max_grade int")
    q = statistics.ranking_quality(judged, 3).first()
    dcg = 7 + 3 / np.log2(4)
    assert abs(q["dcg"] - dcg) < 1e-9
    assert abs(q["ndcg"] - dcg / (7 + 3 / np.log2(3))) < 1e-9
    assert abs(q["err"] - (7 / 8 + (1 / 8) * (3 / 8) / 3)) < 1e-9
    assert {(r["level"], round(r["p"], 3)) for r in statistics.ranking_levels(judged).collect()} == {(1, 1.0), (3, 0.667), (5, 0.4)}
    far = spark.createDataFrame([(2**40, "b a"), (-5, "a c")], "docnum long, text string")
    assert [(r["term"], r["cf"], r["first_doc"], r["first_pos"]) for r in statistics.top_terms(statistics.term_counts(far)).collect()] == [("a", 2, -5, 0), ("c", 1, -5, 1), ("b", 1, 2**40, 0)]


def test_phrase(spark):
    pos = statistics.occurrences(spark.createDataFrame([(1, "a b c"), (2, "b a c"), (3, "a x b")], "docnum long, text string"))
    assert {r[0] for r in search.phrase(["a", "b"], pos).collect()} == {1}
    assert {r[0] for r in search.phrase(["a", "b"], pos, window=2).collect()} == {1, 3}
    assert {r[0] for r in search.phrase(["a", "b"], pos, window=1).collect()} == {1}
    twice = statistics.occurrences(spark.createDataFrame([(1, "the cat"), (2, "the the"), (3, "the x the")], "docnum long, text string"))
    assert {r[0] for r in search.phrase(["the", "the"], twice, window=5).collect()} == {2, 3}
    assert {r[0] for r in search.phrase(["the", "the"], twice).collect()} == {2}


def test_crawl(spark):
    edges = spark.createDataFrame([("r", "a", "CATEGORY"), ("a", "r", "CATEGORY"), ("r", "p", "MAIN"), ("a", "p", "MAIN")], "parent string, child string, ns string")
    assert sorted(tuple(r) for r in crawl.walk_categories(edges, "r", 2).collect()) == [("p", 0), ("p", 1), ("p", 2)]

    def client():
        calls = {"n": 0}

        def get(title):
            calls["n"] += 1
            if title == "bad":
                raise OSError
            return f"text of {title}"

        return get

    titles = spark.createDataFrame([("x",), ("bad",)], "title string")
    got = crawl.fetch(titles, client, attempts=2, backoff=0.0)
    assert {r["title"]: r["text"] for r in got.collect()} == {"x": "text of x", "bad": ""}
    raw = crawl.raw_documents(got, "s").collect()
    assert [(r["title"], r["bytes"], len(r["id"]), r["retrieved_at"][-1]) for r in raw] == [("x", 9, 40, "Z")]
    left = crawl.not_yet(titles, spark.createDataFrame([("x",)], "title string"))
    assert [r[0] for r in left.collect()] == ["bad"]


def test_stream(spark, tmp_path):
    from corploom.streaming import ingest

    src = tmp_path / "src"
    src.mkdir()
    row = lambda i, t: json.dumps({"id": i, "title": "t", "text": t, "retrieved_at": "2024-01-01T00:00:00Z"}) + "\n"
    (src / "1.json").write_text(row("a", "кино один") + row("a", "again") + row("", "no id"))
    run = lambda: ingest.ingest(ingest.raw_stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    (src / "2.json").write_text(row("b", "два") + row("a", "late copy"))
    run()
    docs = spark.read.parquet(str(tmp_path / "out/documents"))
    assert sorted(r["docid"] for r in docs.collect()) == ["a", "b"]
    assert {r["term"] for r in spark.read.parquet(str(tmp_path / "out/terms")).where("docid = 'a'").collect()} == {"кино", "один"}


def test_stream_keeps_old_documents(spark, tmp_path):
    from corploom.streaming import ingest

    src, out, cp = tmp_path / "src", tmp_path / "out", tmp_path / "cp"
    src.mkdir()

    def put(n, *rows):  # files arrive in order of n
        (src / f"{n}.json").write_text("".join(json.dumps({"id": i, "title": "t", "text": t, "retrieved_at": at}) + "\n" for i, t, at in rows))
        os.utime(src / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))

    def run(max_files):
        ingest.ingest(ingest.raw_stream(spark, str(src), max_files), str(out), str(cp)).awaitTermination()
        return sorted((r["docid"], r["text"]) for r in spark.read.parquet(str(out / "documents")).collect())

    put(1, ("new", "new", "2024-06-01T00:00:00Z"), ("bad", "bad", "no date"), ("none", "none", None))
    put(2, ("old", "old", "2020-01-01T00:00:00Z"), ("old", "repeat", "2020-01-01T00:00:00Z"))
    put(3, ("old", "later", "2019-01-01T00:00:00Z"), ("older", "older", "2010-01-01T00:00:00Z"))
    first = [("bad", "bad"), ("new", "new"), ("none", "none"), ("old", "old"), ("older", "older")]
    assert run(1) == first  # a backlog of several batches
    put(4, ("oldest", "oldest", "2001-01-01T00:00:00Z"), ("bad", "late", "2001-01-01T00:00:00Z"))
    put(-1_000_000, ("aged", "aged", "2001-01-01T00:00:00Z"))  # a file from before last week
    want = sorted([*first, ("oldest", "oldest"), ("aged", "aged")])
    assert run(100) == want  # a second run on the checkpoint
    last = max(int(f.name) for f in (cp / "commits").iterdir() if f.name.isdigit())
    for f in (cp / "commits").glob(f"*{last}*"):
        f.unlink()
    assert run(100) == want  # a batch that runs again


def test_pages(built, spark):
    rows, ix, *_ = built
    assert "<form" in web.home()
    page = web.results(ix, "кино")
    assert "1-2 of 2" in page
    assert "/doc/1" in page
    assert "Empty" in web.results(ix, " ")
    with pytest.raises(ValueError, match="invalid literal"):
        web.results(ix, "x", "two")
    texts = files.last_texts(rows)
    assert "<p>Кино и машины</p>" in web.results(ix, '"кино и"', "1", texts)
    assert "Кино и машины" in web.document(ix, texts, 1)
    assert web.document(ix, texts, 99) is None


def test_command_line(built, capsys, tmp_path):
    *_, parts, folder = built
    assert cli.main(["search", folder, "--query", "рок-н-ролл"]) == 0
    assert capsys.readouterr().out.strip() == "d3\tThree"
    cli.main(["search", folder, "--query", "кино машины", "--rank"])
    assert [line.split("\t")[0] for line in capsys.readouterr().out.splitlines()] == ["d1", "d2"]
    (tmp_path / "syn.tsv").write_text("рок-н-ролл\tжанр\n", encoding="utf-8")
    cli.main(["search", folder, "--query", "жанр", "--synonyms", str(tmp_path / "syn.tsv")])
    assert capsys.readouterr().out.strip() == "d3\tThree"
    cli.main(["suggest", folder, "машинй"])
    assert capsys.readouterr().out.splitlines()[0] == "машинй\tмашиной\t1\t1"
    cli.main(["measure", folder])
    assert "'band': 'rare'" in capsys.readouterr().out
    (tmp_path / "grades.tsv").write_text("q\t1\t3\t3\nq\t2\t0\t3\n")
    cli.main(["quality", str(tmp_path / "grades.tsv")])
    assert "'level': 1, 'p': 1.0" in capsys.readouterr().out
    cli.main(["stats", parts])
    assert "кино\t2" in capsys.readouterr().out
    cli.main(["verify", folder, parts])
    assert "'mismatches': 0" in capsys.readouterr().out
    cli.main(["zipf", folder, str(tmp_path / "z")])
    assert json.loads(next((tmp_path / "z").glob("part-*")).read_text())["total_terms"] == 5


def test_prepare_to_search(spark, tmp_path, capsys):
    """Raw lines to a searched index by the commands alone."""
    raw = tmp_path / "raw"
    raw.mkdir()
    row = lambda i, t, x: json.dumps({"id": i, "title": t, "text": x}, ensure_ascii=False) + "\n"
    (raw / "b.jsonl").write_text(row("2", "Two", "Кино\tи маши-\nны") + "\n" + row("1", "again", "repeat"), encoding="utf-8")
    (raw / "a.jsonl").write_text(row("1", "One", "кино") + row(None, "none", "lost") + row("", "empty", "lost"), encoding="utf-8")
    assert cli.main(["prepare", str(raw), str(tmp_path / "out")]) == 0
    assert "unique documents: 2" in capsys.readouterr().out
    rejects = [r["value"] for r in spark.read.text(str(tmp_path / "out/rejects")).collect()]
    assert rejects == ["MISSING_ID\t\tnone", "MISSING_ID\t\tempty", "DUPLICATE\t1\tagain"]
    cli.main(["build", str(tmp_path / "out/corpus"), str(tmp_path / "ix"), "--stem"])
    meta = index.Index.open(spark, str(tmp_path / "ix")).meta.first()
    assert (meta["stemmer"], len(meta["build_sha1"]), len(meta["tokenizer_sha1"])) == ("stem", 40, 40)
    capsys.readouterr()
    cli.main(["search", str(tmp_path / "ix"), "--query", "машин || кин"])
    assert capsys.readouterr().out == "1\tOne\n2\tTwo\n"
    cli.main(["stats", str(tmp_path / "out/corpus"), "--out", str(tmp_path / "st")])
    told = json.loads(next((tmp_path / "st/tokens_stats").glob("part-*")).read_text())
    assert told["docs_processed"] == 2
    assert {t["term"]: t["cf"] for t in told["top_terms"]}["кино"] == 1
    assert sum(len(p.read_text().splitlines()) for p in (tmp_path / "st/sample_tokenized").glob("part-*")) == 2


def test_lemmatizer(spark):
    def lemma():
        def find(word):
            if word == "bad":
                raise ValueError(word)
            return word.rstrip("s")

        return find

    docs = spark.createDataFrame([(1, "1", "t", "cats cat bad"), (2, "2", "t", "cats")], "n int, docid string, title string, text string")
    built = index.build(docs, stemmer=X.lemmatizer(lemma))
    assert {(r["term"], r["df"], r["df_postings"]) for r in built.vocab.collect()} == {("cat", 2, 3), ("bad", 1, 1)}
    assert built.meta.first()["stemmer"] == "lemmatize"


def test_numbering_keeps_ties_and_nulls(spark):
    docs = spark.createDataFrame([("b", "x"), ("a", "y"), ("a", "z"), (None, "n")], "docid string, text string")
    got = sorted((r["docnum"], r["docid"], r["text"]) for r in index.number(docs, "docid").collect())
    assert [(n, i) for n, i, _ in got] == [(1, None), (2, "a"), (3, "a"), (4, "b")]
    assert {t for *_, t in got} == {"x", "y", "z", "n"}


def test_crawl_counters(spark):
    df, seen = crawl.counted(spark.createDataFrame([("a", "text"), ("b", ""), ("c", None)], "title string, text string"))
    assert df.count() == 3
    assert seen.get == {"pages": 3, "empty": 2, "bytes": 4}
    assert crawl.progress(seen, 2.0) == {"pages": 3, "empty": 2, "bytes": 4, "pages_per_second": 1.5}


def test_snippets_and_suggestions(spark):
    df = spark.createDataFrame([(1, "Nothing here. A cat sat. The dog ran off.\nCat and dog."), (2, "one"), (3, None)], "i int, text string")
    got = [r[0] for r in df.orderBy("i").select(search.biased_snippet(F.col("text"), ["cat", "dog"])).collect()]
    assert got == ["A cat sat. The dog ran off.", "one", None]
    vocab = spark.createDataFrame([("cat", 5), ("cart", 9), ("dog", 1), ("bat", 5)], "term string, df long")
    assert [(r["term"], r["distance"]) for r in search.suggest("Cat", vocab, 1).collect()] == [("cat", 0), ("cart", 1), ("bat", 1)]
