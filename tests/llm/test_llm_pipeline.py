"""The pipeline's stages, each against a brute-force version on its own input; SQL queries against DuckDB."""

import collections
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from corploom.llm import queries
from tests.llm.test_llm_operators import LOWER, WORD

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    root, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for n, (_, stage) in enumerate(P.STAGES):
        result = stage(spark, docs, SF)
        result.write.parquet(str(root / str(n)))
        out.append((docs, spark.read.parquet(str(root / str(n)))))
        docs = out[-1][1]
    return out


def test_columns_and_rows(steps):
    for before, after in steps[:-1]:
        assert after.columns == P.COLUMNS
        assert {r[0] for r in after.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()}


def test_toxicity(steps, spark):
    before, after = steps[0]
    gone = {r[0] for r in before.select("doc_id").subtract(after.select("doc_id")).collect()}
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(toxic.get(i) == 0 for i in gone) <= 1
    insult = {r["doc_id"] for r in before.collect() if " idiot " in r["text"] or " moron " in r["text"]}
    assert insult <= gone


def test_lines(steps):
    before, after = steps[1]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    rows, holders = before.collect(), collections.defaultdict(set)
    for r in rows:
        for x in r["text"].split("\n"):
            holders[key(x)].add(r["doc_id"])
    got = {r["doc_id"]: r for r in after.collect()}
    for r in rows:
        kept = "\n".join(x for x in r["text"].split("\n") if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == r["doc_id"])
        assert (got[r["doc_id"]]["text"], got[r["doc_id"]]["n_chars"]) == (kept, len(kept))


def test_near_duplicates(steps):
    before, after = steps[2]
    sets = {}
    for r in before.collect():
        w = WORD.findall(r["text"].translate(LOWER))
        sets[r["doc_id"]] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}
    find = lambda i: i if up[i] == i else find(up[i])
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    assert {r["doc_id"] for r in after.collect()} == {i for i in ids if find(i) == i}


def test_near_duplicates_without_unique_ids(spark):
    text = lambda w: " ".join(f"{w}{i}" for i in range(60))
    near = lambda w: text(w) + " end"
    rows = [
        (None, text("a")), (None, text("b")), (None, text("b")), (None, near("b")), (9, text("c")), (None, near("c")),
        (1, text("d")), (1, text("d")), (1, text("e")), (2, near("e")), (3, text("f")), (3, near("d")), (None, ""), (None, None),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for n in (1, 5):
        after = P.drop_near_duplicates(spark, docs.repartition(n), SF)
        assert after.columns == P.COLUMNS
        got = sorted(((r["doc_id"], (r["text"] or "-")[0]) for r in after.collect()), key=repr)
        assert got == sorted([(None, "a"), (None, "b"), (9, "c"), (1, "d"), (1, "e"), (3, "f"), (None, "-"), (None, "-")], key=repr)


def nasty(spark):
    """Null and repeated ids, null and empty and long texts, ties, and columns that stages use for themselves."""
    line = "a line that stands in several of the documents"
    rows = [
        (None, f"{line}\nno id"), (None, None), (1, None), (2, ""), (3, f"{line}\nthree"), (3, f"{line}\nthree"), (4, line), (5, f"you idiot moron scum {line}"), (6, "w " * 40_000), (7, "x" * 50_000), (8, "é 日本 \u0000 |"), (9, f"{line}\nnine words of its own make it unlike the others here"),
    ]
    docs = spark.createDataFrame([(i, t, None if i == 2 else "en", None if i == 4 else "src1", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit("mine") for c in ("score", "predicted", "row", "copies", "ids", "decoded", "domain", "component_id", "kept_text", "bitmap")}).repartition(3)


def test_stages_on_nasty_rows(spark):
    docs = nasty(spark)
    want = collections.Counter(r["doc_id"] for r in docs.collect())
    out = {name: stage(spark, docs, SF) for name, stage in P.STAGES}
    ids = {name: collections.Counter(r["doc_id"] for r in df.collect()) for name, df in out.items()}
    for name in list(out)[:-1]:
        assert out[name].columns == P.COLUMNS, name
    assert want - ids["toxicity"] == {5: 1}  # rows without an id or a text stay
    assert ids["line dedup"] == want
    texts = {(r["doc_id"], r["text"]) for r in out["line dedup"].collect()}
    assert {(None, "a line that stands in several of the documents\nno id"), (3, "three"), (1, ""), (None, "")} <= texts
    assert want - ids["n-gram Jaccard join"] == {3: 1, 4: 1}  # the repeated row, and what has five of its six shingles; texts without words stay
    assert not ids["mixing sources to target weights"] - want
    assert ids["BPE encoding and decoding"] == want
    assert {r["n_tokens"] for r in out["BPE encoding and decoding"].where("doc_id IN (1, 2)").collect()} == {0}


def test_stages_on_empty_tables(spark):
    docs = nasty(spark).limit(0)
    for name, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_mix(steps):
    before, after = steps[3]
    n = lambda df: sum(len(WORD.findall(r["text"])) for r in df.collect())
    assert 0.8 * n(before) < n(after) <= P.MIX_SHARE * n(before)
    con = duckdb.connect()
    con.register("documents", before.toArrow())
    want = con.execute(f"SELECT doc_id FROM ({queries.op9_sql(P.MIX_SHARE, 1)}) WHERE copies > 0").fetchall()
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(i for (i,) in want)


def test_bpe(steps):
    tokenizers = pytest.importorskip("tokenizers")
    before, after = steps[4]
    library = tokenizers.Tokenizer.from_file(queries.vocabulary_path())
    got = {r["doc_id"]: r["ids"] for r in after.collect()}
    for r in before.collect():
        assert got[r["doc_id"]] == library.encode(r["text"], add_special_tokens=False).ids


def test_run_is_the_stages(steps, spark):
    assert sorted(tuple(r) for r in P.run(spark, SF).select("doc_id", "n_tokens").collect()) == sorted(tuple(r) for r in steps[-1][1].select("doc_id", "n_tokens").collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, want))
