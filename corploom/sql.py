"""The engine in SQL: text functions for any session, and search over a stored index as a table function.

    register_functions(spark)
    register_index(spark, ix)
    spark.sql("SELECT t.pos, t.term FROM docs, LATERAL tokens(docs.text) t WHERE docs.id = 7")
    spark.sql("SELECT t.term, count(*) FROM (SELECT tokenize(text) AS found FROM docs) LATERAL VIEW explode(found) t AS term GROUP BY t.term")
    spark.sql("SELECT * FROM search('(the && !ach) || der') ORDER BY docnum LIMIT 50")

All bodies are SQL that Catalyst puts into the caller's plan.  Python reads a query's
text, once a query, and texts that aren't plain are folded as the Column functions fold them.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corploom.functions import text as X
from corploom.operators.index import Index
from corploom.plans.boolean import BINDS, lex, postfix
from corploom.shipping import ship


def _quote(text: str) -> str:
    """A raw SQL literal; one that holds both kinds of quotation marks is put together."""
    return " || ".join(f'r"{part}"' if "'" in part else f"r'{part}'" for part in _pieces(text))


def _pieces(text: str) -> list[str]:
    out = [""]
    for c in text:
        if (c == '"' and "'" in out[-1]) or (c == "'" and '"' in out[-1]):
            out.append("")
        out[-1] += c
    return out


def _stem_sql() -> str:
    """The built-in stemmer, longest suffixes first."""
    cases = []
    for n in sorted({len(s) for s in X.SUFFIXES}, reverse=True):
        some = ", ".join(f"'{s}'" for s in X.SUFFIXES if len(s) == n)
        cases.append(f"WHEN char_length(lower(word)) >= {n + 3} AND right(lower(word), {n}) IN ({some}) THEN left(lower(word), char_length(lower(word)) - {n})")
    return f"CASE {' '.join(cases)} ELSE lower(word) END"


def _tokens_sql() -> str:
    plain = f"coalesce(octet_length(text) = char_length(text) OR text RLIKE {_quote(rf'\A[{X.PLAIN}]*+\z')}, true)"
    folded = f"CASE WHEN {plain} THEN replace(lower(text), 'ß', 'ss') ELSE corploom_fold(CASE WHEN {plain} THEN NULL ELSE text END) END"
    signs, to = X.DASHES + X.SPACES + X.VANISHING, "-" * len(X.DASHES) + " " * len(X.SPACES)
    return f"coalesce(regexp_extract_all(translate({folded}, '{signs}', '{to}'), {_quote(X.TOKEN)}, 0), CAST(array() AS ARRAY<STRING>))"


def register_functions(spark: SparkSession) -> None:
    """tokenize(text), stem(word), and the table function tokens(text) of (pos, term), for this session.

    Spark runs LATERAL tokens(t.text) as a join of t with the tokens of its different
    texts, each of which carries its text: for a few texts.  A whole table is read by
    SELECT p.* FROM (SELECT tokenize(text) AS found FROM t) LATERAL VIEW posexplode(found) p AS pos, term.
    """
    ship(spark)

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: unicodedata.normalize("NFC", x).casefold(), na_action="ignore")

    spark.udf.register("corploom_fold", fold)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION tokenize(text STRING) RETURNS ARRAY<STRING> RETURN {_tokens_sql()}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION stem(word STRING) RETURNS STRING RETURN {_stem_sql()}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tokens(text STRING) RETURNS TABLE (pos INT, term STRING) RETURN SELECT p.pos, p.term FROM (SELECT tokenize(tokens.text) AS found) LATERAL VIEW posexplode(found) p AS pos, term")


_STACK = """aggregate(q.form, CAST(array() AS ARRAY<BOOLEAN>), (s, x) -> CASE
  WHEN x = '!' THEN CASE WHEN size(s) = 0 THEN array(true) ELSE concat(slice(s, 1, size(s) - 1), array(NOT element_at(s, size(s)))) END
  WHEN x = '&&' THEN concat(slice(s, 1, greatest(size(s) - 2, 0)), array(size(s) > 1 AND forall(slice(s, greatest(size(s) - 1, 1), 2), v -> v)))
  WHEN x = '||' THEN concat(slice(s, 1, greatest(size(s) - 2, 0)), array(exists(slice(s, greatest(size(s) - 1, 1), 2), v -> v)))
  ELSE concat(s, array(array_contains(coalesce(h.words, CAST(array() AS ARRAY<STRING>)), x))) END,
  s -> size(s) > 0 AND coalesce(try_element_at(s, -1), false))"""


def register_index(spark: SparkSession, ix: Index, name: str = "search") -> None:
    """A table function name(query, adjacency) of (docnum, docid, title), and views name_forward, name_postings and name_vocab.

    The query is any of the plain dialect; adjacency is 'last' (default) or 'and'.  The
    postfix form runs on a stack within an expression, for documents that hold
    any of its words or, as it may be a NOT, none.
    """
    ship(spark)
    spark.udf.register("corploom_form", lambda query, adjacency: postfix(lex(query or ""), adjacency or "last"), "array<string>")
    ix.forward.select("docnum", "docid", "title").createOrReplaceTempView(f"{name}_forward")
    ix.postings.createOrReplaceTempView(f"{name}_postings")
    ix.vocab.createOrReplaceTempView(f"{name}_vocab")
    ix.blocks.where("zone = 'text'").select("term", "first", "docs").createOrReplaceTempView(f"{name}_blocks")
    signs = ", ".join(f"'{x}'" for x in BINDS)
    spark.sql(f"""
CREATE OR REPLACE TEMPORARY FUNCTION {name}(query STRING, adjacency STRING DEFAULT 'last') RETURNS TABLE (docnum BIGINT, docid STRING, title STRING) RETURN
WITH q AS (SELECT corploom_form({name}.query, {name}.adjacency) AS form),
w AS (SELECT DISTINCT word FROM (SELECT e.word FROM q LATERAL VIEW explode(form) e AS word) WHERE word NOT IN ({signs})),
r AS (SELECT w.word, coalesce(v.term, lower(w.word)) AS term FROM w LEFT JOIN {name}_vocab v ON v.term = w.word),
p AS (SELECT r.word, explode(transform(b.docs, d -> b.first + d)) AS docnum FROM {name}_blocks b JOIN r ON b.term = r.term),
h AS (SELECT docnum, collect_set(word) AS words FROM p GROUP BY docnum)
SELECT f.docnum, f.docid, f.title FROM {name}_forward f LEFT JOIN h ON f.docnum = h.docnum CROSS JOIN q WHERE {_STACK}""")


def search(spark: SparkSession, query: str, adjacency: str = "last", name: str = "search") -> DataFrame:
    """The table function from Python, with its arguments as parameters."""
    return spark.sql(f"SELECT * FROM {name}(:query, :adjacency)", {"query": query, "adjacency": adjacency})
