"""Functions and search through spark.sql."""

import pytest
from pyspark.sql import functions as F

from corploom import catalog, sql
from corploom.functions import text as X
from corploom.operators import index
from tests.test_boolean import GOLDEN

DOCS = [(1, "a"), (2, "a b"), (3, "a b c"), (4, "nothing else")]


def test_text_functions(spark):
    texts = ["It's рок-н-ролл STRAẞE ﬁn é x² d’art ’q 'z' foo_bar", None, "", "машины играющий a--b", "e" + chr(0x301) + " ΟΔΟΣ K" + chr(0xAD) + "ino"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    df.createOrReplaceTempView("texts")
    sql.register_functions(spark)
    got = spark.sql("SELECT i, tokenize(text) AS t FROM texts").collect()
    assert got == df.select("i", X.tokens(F.col("text")).alias("t")).collect()
    rows = spark.sql("SELECT t.pos, t.term, stem(t.term) AS s FROM texts, LATERAL tokens(texts.text) t WHERE i = 3 ORDER BY t.pos").collect()
    assert [tuple(r) for r in rows] == [(0, "машины", "машин"), (1, "играющий", "играющ"), (2, "a", "a"), (3, "b", "b")]


def test_tokens_of_a_table_are_not_joined_to_their_texts(spark):
    plan = catalog.QUERIES["sql_tokens"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert plan.count("Exchange") == plan.count("Exchange hashpartitioning(term") == 1
    assert plan.count("ArrowEvalPython") == 1  # texts are folded once


@pytest.fixture(scope="module")
def searchable(spark):
    ix = index.build(spark.createDataFrame([(f"d{n}", "t", t) for n, t in DOCS], "docid string, title string, text string"))
    sql.register_index(spark, ix, "tried")
    return spark


@pytest.mark.parametrize(("query", "form", "result"), GOLDEN[::3])
def test_golden(searchable, query, form, result):
    assert {r["docnum"] for r in searchable.sql("SELECT docnum FROM tried(:q)", {"q": query}).collect()} == result


def test_search_beside_other_sql(searchable):
    assert [r["docid"] for r in sql.search(searchable, "a c", "and", "tried").collect()] == ["d3"]
    both = searchable.sql("SELECT x.docid FROM tried('a') x LEFT ANTI JOIN tried('b') y ON x.docnum = y.docnum")
    assert [r["docid"] for r in both.collect()] == ["d1"]
    assert {r["term"]: r["df"] for r in searchable.sql("SELECT term, df FROM tried_vocab").collect()}["a"] == 3
