"""The engine's registered queries and the SQL that each must agree with.

The corpus is the documents table: docid is doc_id, docnum its dense number in
order of doc_id, title ``source/lang``.  Queries about searching, ranks and
verification read one stored index, as a user of an index does; it is built by the
first of them and again when the table's files change.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corploom.functions import text as X
from corploom.functions import varint
from corploom.operators import blocks as B
from corploom.operators import corpus as C
from corploom.operators import fuzzy
from corploom.operators import index as I
from corploom.operators import search as S
from corploom.operators import statistics as T
from corploom.operators import synonyms as N
from corploom.operators import verify as V
from corploom.operators.shared import exists, materialize, new_folder, release_folder
from corploom import sql
from corploom.sources import crawl, pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_TOKEN = "([\\p{L}\\p{Nd}]+(?:[-''’][\\p{L}\\p{Nd}]+)*)"
_TOK = f"regexp_extract_all(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '{_TOKEN}', 1)"
_DOCS = "d AS (SELECT row_number() OVER (ORDER BY doc_id) AS docnum, doc_id, CAST(doc_id AS VARCHAR) AS docid, concat(source, '/', lang) AS title, text FROM documents)"
_POST = f"p AS (SELECT docnum, unnest(list_distinct({_TOK})) AS term FROM d)"
_FLAGS = f"w AS (SELECT docnum, docid, title, {_TOK} AS t FROM d)"


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _title(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"docid": F.col("doc_id").cast("string"), "title": F.concat("source", F.lit("/"), "lang")})


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    """docnum, doc_id, docid, title, text."""
    docs = _title(C.number_rows(_documents(spark, sf).select("doc_id", "source", "lang", "text"), "doc_id"))
    return docs.select("docnum", "doc_id", "docid", "title", "text")


def _forward(spark: SparkSession, sf: str) -> DataFrame:
    return _title(C.number_rows(_documents(spark, sf).select("doc_id", "source", "lang"), "doc_id")).select("docnum", "docid", "title")


_stored: dict[str, tuple[tuple, I.Index]] = {}


def _index(spark: SparkSession, sf: str) -> I.Index:
    """The stored index of the documents table as its files are now.

    It is built where this application has none, where the table's files have
    changed - the old one goes - and where its folder has been lost.
    """
    docs = _documents(spark, sf)
    status = lambda p: p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p)  # noqa: E731, SLF001
    files = [(f, status(spark._jvm.org.apache.hadoop.fs.Path(f))) for f in sorted(docs.inputFiles())]  # noqa: SLF001
    state = (spark.sparkContext.applicationId, *((f, s.getLen(), s.getModificationTime()) for f, s in files))
    held = _stored.get(sf)
    if held is None or held[0] != state or not exists(spark, f"{held[1].folder}/meta/_SUCCESS"):
        if held is not None:
            release_folder(spark, held[1].folder)
        corpus = _title(docs.select("doc_id", "source", "lang", "text"))
        _stored[sf] = (state, I.build(corpus, order=("doc_id",), folder=new_folder(spark, "index")))
    return _stored[sf][1]


def _postings(spark: SparkSession, sf: str) -> DataFrame:
    return I.document_terms(_numbered(spark, sf))


# corpus

query("corpus_scan", f"WITH {_DOCS} SELECT docnum, docid, title, CAST(strlen(text) AS BIGINT) AS n_bytes FROM d")(
    lambda spark, sf: _numbered(spark, sf).select("docnum", "docid", "title", F.octet_length("text").cast("long").alias("n_bytes"))
)


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    return C.first_wins(_documents(spark, sf).select("doc_id", F.sha1(F.col("text").cast("binary")).alias("sha1")), "sha1", "doc_id")


query("corpus_dedup", "SELECT doc_id, sha1(text) AS sha1 FROM documents QUALIFY row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id) = 1")(lambda spark, sf: _ranked(spark, sf).where("nth = 1").drop("nth"))
query("corpus_rejects", "SELECT 'DUPLICATE' AS kind, doc_id, row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id) AS nth FROM documents QUALIFY nth > 1")(
    lambda spark, sf: _ranked(spark, sf).where("nth > 1").select(F.lit("DUPLICATE").alias("kind"), "doc_id", "nth")
)


@query(
    "corpus_stats",
    """WITH r AS (SELECT strlen(text) AS n, row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id) AS nth FROM documents)
SELECT CAST(count(*) AS BIGINT) AS input_docs, CAST(count(*) FILTER (WHERE nth = 1) AS BIGINT) AS unique_docs, CAST(sum(n) AS BIGINT) AS text_bytes,
round(sum(n)::DOUBLE / count(*) FILTER (WHERE nth = 1), 6) AS avg_compat, round(sum(n) FILTER (WHERE nth = 1)::DOUBLE / count(*) FILTER (WHERE nth = 1), 6) AS avg_unique FROM r""",
)
def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.first_wins(_documents(spark, sf).select("doc_id", F.sha1(F.col("text").cast("binary")).alias("sha1"), F.octet_length("text").cast("long").alias("n")), "sha1", "doc_id")
    unique, own = F.count_if(F.col("nth") == 1), F.sum(F.when(F.col("nth") == 1, F.col("n")))
    return rows.agg(F.count(F.lit(1)).alias("input_docs"), unique.alias("unique_docs"), F.sum("n").alias("text_bytes"), F.round(F.sum("n") / unique, 6).alias("avg_compat"), F.round(own / unique, 6).alias("avg_unique"))


query("corpus_parts", f"WITH {_DOCS} SELECT CAST((docnum - 1) // 1000 + 1 AS BIGINT) AS part, CAST(count(*) AS BIGINT) AS n_docs FROM d GROUP BY 1")(lambda spark, sf: C.parts(_forward(spark, sf)))
query("doc_sha1", "SELECT doc_id, sha1(text) AS sha1 FROM documents")(lambda spark, sf: _documents(spark, sf).select("doc_id", F.sha1(F.col("text").cast("binary")).alias("sha1")))

_CLEAN = "regexp_replace(nfc_normalize(text), '([A-Za-zА-Яа-яЁё0-9])[\\s]*-[\\s]*[\\r\\n]+[\\s]*([A-Za-zА-Яа-яЁё0-9])', '\\1\\2', 'g')"
query("clean_text", f"SELECT doc_id, sha1(trim(regexp_replace({_CLEAN}, '[\\s]+', ' ', 'g'))) AS sha1 FROM documents")(
    lambda spark, sf: _documents(spark, sf).select("doc_id", F.sha1(X.clean(F.col("text"), glue=False).cast("binary")).alias("sha1"))
)
query("clean_text_glue")(lambda spark, sf: _documents(spark, sf).select("doc_id", F.sha1(X.clean(F.col("text")).cast("binary")).alias("sha1")))

# documents as raw rows: ids that repeat, ids that are null or empty
_RAW = "r AS (SELECT doc_id AS input_no, CASE doc_id % 10 WHEN 3 THEN NULL WHEN 4 THEN '' ELSE CAST(doc_id - doc_id % 3 AS VARCHAR) END AS id, concat(source, ' -', chr(10), lang, '  ') AS title, text FROM documents)"
_CLEANED = rf"c AS (SELECT input_no, coalesce(id, '') AS docid, trim(regexp_replace({_CLEAN.replace('text', 'title')}, '[\s]+', ' ', 'g')) AS title, trim(regexp_replace({_CLEAN}, '[\s]+', ' ', 'g')) AS text, strlen(text) + 1 AS line_bytes FROM r), k AS (SELECT *, CASE WHEN docid = '' THEN 0 ELSE row_number() OVER (PARTITION BY docid ORDER BY input_no) END AS nth FROM c)"


def _prepared(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    n = F.col("doc_id")
    ident = F.when(n % 10 == 3, None).when(n % 10 == 4, "").otherwise((n - n % 3).cast("string"))
    raw = _documents(spark, sf).select(n.alias("input_no"), ident.alias("id"), F.concat("source", F.lit(" -\n"), "lang", F.lit("  ")).alias("title"), "text", (F.octet_length("text") + 1).cast("long").alias("line_bytes"))
    return C.prepare(raw, glue=False)


query("corpus_prepare", f"WITH {_RAW}, {_CLEANED} SELECT input_no, docid, title, sha1(text) AS sha1 FROM k WHERE nth = 1")(
    lambda spark, sf: _prepared(spark, sf)[0].select("input_no", "docid", "title", F.sha1(F.col("text").cast("binary")).alias("sha1"))
)
query("corpus_prepare_rejects", f"WITH {_RAW}, {_CLEANED} SELECT CASE WHEN nth = 0 THEN 'MISSING_ID' ELSE 'DUPLICATE' END AS kind, input_no, docid, title FROM k WHERE nth <> 1")(lambda spark, sf: _prepared(spark, sf)[1])
query("corpus_prepare_stats", f"WITH {_RAW}, {_CLEANED} SELECT CAST(count(*) AS BIGINT) AS input_docs, CAST(count(*) FILTER (WHERE nth = 1) AS BIGINT) AS unique_docs, CAST(sum(line_bytes) AS BIGINT) AS raw_bytes, CAST(sum(strlen(text)) AS BIGINT) AS text_bytes, round(sum(strlen(text))::DOUBLE / count(*) FILTER (WHERE nth = 1), 6) AS avg_compat FROM k")(
    lambda spark, sf: _prepared(spark, sf)[2].select("input_docs", "unique_docs", "raw_bytes", "text_bytes", F.round("avg_compat", 6).alias("avg_compat"))
)

# tokens

query("tokenize_unicode", f"SELECT doc_id, array_to_string({_TOK}, ' ') AS tokens FROM documents")(lambda spark, sf: _documents(spark, sf).select("doc_id", F.array_join(X.tokens(F.col("text")), " ").alias("tokens")))
_SPLIT = "CASE WHEN doc_id % 2 = 0 THEN replace(replace(replace(text, 'é', 'e\u0301'), 'ü', 'u\u0308'), 'n', 'n\u0303') ELSE text END"  # half of the texts decomposed
query("tokenize_nfc", f"SELECT doc_id, array_to_string({_TOK}, ' ') AS tokens FROM (SELECT doc_id, {_SPLIT} AS text FROM documents)")(
    lambda spark, sf: _documents(spark, sf).select("doc_id", F.expr(_SPLIT).alias("text")).select("doc_id", F.array_join(X.tokens(F.col("text")), " ").alias("tokens"))
)
query("tokenize_whitespace", "SELECT doc_id, array_to_string(list_filter(string_split_regex(text, '[\\s]+'), lambda t: t <> ''), ' ') AS tokens FROM documents")(
    lambda spark, sf: _documents(spark, sf).select("doc_id", F.array_join(X.tokens(F.col("text"), "whitespace"), " ").alias("tokens"))
)
query("doc_lengths", f"WITH {_DOCS} SELECT docnum, CAST(len({_TOK}) AS BIGINT) AS n_tokens FROM d")(lambda spark, sf: _numbered(spark, sf).select("docnum", F.size(X.tokens(F.col("text"))).cast("long").alias("n_tokens")))
query("token_stats", f"WITH t AS (SELECT unnest({_TOK}) AS term FROM documents) SELECT (SELECT CAST(count(*) AS BIGINT) FROM documents) AS docs_processed, CAST(count(*) AS BIGINT) AS total_tokens, CAST(count(DISTINCT term) AS BIGINT) AS unique_terms FROM t")(
    lambda spark, sf: T.token_stats(_documents(spark, sf).select(F.col("doc_id").alias("docnum"), "text"))
)
_COUNTS = f"o AS (SELECT docnum, unnest({_TOK}) AS term, generate_subscripts({_TOK}, 1) - 1 AS pos FROM d), c AS (SELECT term, CAST(count(*) AS BIGINT) AS cf, min(docnum * 10000000 + pos) AS at FROM o GROUP BY term)".replace(" AS at ", " AS spot ")
query("term_cf", f"SELECT term, CAST(count(*) AS BIGINT) AS cf FROM (SELECT unnest({_TOK}) AS term FROM documents) GROUP BY term")(
    lambda spark, sf: T.term_frequencies(_documents(spark, sf))
)
query("top_terms_100", f"WITH {_DOCS}, {_COUNTS} SELECT term, cf FROM c ORDER BY cf DESC, spot LIMIT 100")(
    lambda spark, sf: T.top_terms(T.term_counts(_documents(spark, sf).select(F.col("doc_id").alias("docnum"), "text"))).select("term", "cf")
)
query("length_stats", f"WITH c AS (SELECT term, count(*) AS cf FROM (SELECT unnest({_TOK}) AS term FROM documents) GROUP BY term) SELECT round(sum(length(term) * cf)::DOUBLE / sum(cf), 6) AS avg_token_length, round(avg(length(term)), 6) AS avg_term_length FROM c")(
    lambda spark, sf: T.length_stats(T.term_frequencies(_documents(spark, sf))).select(F.round("avg_token_length", 6).alias("avg_token_length"), F.round("avg_term_length", 6).alias("avg_term_length"))
)

query("tokenized_sample", f"WITH {_DOCS} SELECT docnum, docid, title, array_to_string({_TOK}, ' ') AS tokens FROM d WHERE docnum <= 200")(lambda spark, sf: T.tokenized(_numbered(spark, sf), 200))
_PAIRS = f"t AS (SELECT {_TOK} AS t FROM documents), g AS (SELECT unnest(list_transform(range(1, len(t)), lambda i: {{'a': t[i], 'b': t[i + 1]}})) AS p FROM t), n AS (SELECT p.a AS a, p.b AS b, count(*) AS n FROM g GROUP BY ALL)"
query("collocations", f"WITH {_PAIRS}, e AS (SELECT a, b, n, sum(n) OVER (PARTITION BY a)::DOUBLE * sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS e FROM n) SELECT a, b, n, round(log2(n / e), 6) AS pmi, round((n - e) / sqrt(n), 6) AS t_score FROM e WHERE n >= 20")(
    lambda spark, sf: T.collocations(_documents(spark, sf).select(F.col("doc_id").alias("docnum"), "text"), 20).select("a", "b", "n", F.round("pmi", 6).alias("pmi"), F.round("t_score", 6).alias("t_score"))
)
query("zone_scores", f"WITH {_DOCS}, z AS (SELECT docnum, {_TOK.replace('text', 'title')} AS a, {_TOK} AS b FROM d), s AS (SELECT docnum, 3.5 * len(list_filter(a, lambda x: x IN ('en', 'with'))) + 0.5 * len(list_filter(b, lambda x: x IN ('en', 'with'))) AS score FROM z) SELECT docnum, CAST(score AS DOUBLE) AS score FROM s WHERE score > 0")(
    lambda spark, sf: S.zone_scores(_index(spark, sf), ["en", "with"], {"title": 3.5, "text": 0.5})
)

# the index

query("vocab_df", f"WITH {_DOCS}, {_POST} SELECT term, CAST(count(*) AS BIGINT) AS df FROM p GROUP BY term")(
    # df needs no numbering: distinct tokens of a document are one posting each
    lambda spark, sf: _documents(spark, sf).select(F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
)
_SIZE = lambda x: "CASE " + " ".join(f"WHEN {x} < {1 << 7 * k} THEN {k}" for k in range(1, 9)) + " ELSE 9 END"
_GAPS = "g AS (SELECT term, docnum, docnum - lag(docnum, 1, 0) OVER (PARTITION BY term ORDER BY docnum) AS gap FROM p)"
_BLOCKS = f"b AS (SELECT term, count(*) AS df, sum({_SIZE('gap')}) + {_SIZE('count(*)')} AS length FROM g GROUP BY term)"
query("postings_gaps", f"WITH {_DOCS}, {_POST}, {_GAPS} SELECT term, docnum, CAST(gap AS BIGINT) AS gap FROM g")(lambda spark, sf: I.gaps(_postings(spark, sf).select("term", "docnum")))
query("vocab_blocks", f"WITH {_DOCS}, {_POST}, {_GAPS}, {_BLOCKS} SELECT term, CAST(df AS BIGINT) AS df, CAST(coalesce(sum(length) OVER (ORDER BY term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", CAST(length AS BIGINT) AS length FROM b")(
    lambda spark, sf: I.with_offsets(I.block_sizes(_postings(spark, sf).select("term", "docnum"))).select("term", "df", "offset", "length")
)
# lists in pieces of 1,024 document numbers each, so that no row grows with the corpus
query("postings_list", f"WITH {_DOCS}, {_POST} SELECT term, docnum // 1024 AS piece, string_agg(CAST(docnum AS VARCHAR), ',' ORDER BY docnum) AS docs FROM p GROUP BY term, docnum // 1024")(
    lambda spark, sf: _postings(spark, sf).groupBy("term", F.shiftright("docnum", 10).alias("piece")).agg(F.array_join(F.sort_array(F.collect_list("docnum")), ",").alias("docs"))
)
query("varint_roundtrip", f"WITH {_DOCS}, {_POST} SELECT term, docnum FROM p")(lambda spark, sf: I.packed(_postings(spark, sf)).select("term", F.explode(varint.decode_block(F.col("block"))).alias("docnum")))
_BAND = "CASE WHEN df <= 128 THEN 'rare' WHEN df <= 16384 THEN 'middling' ELSE 'frequent' END"
query("block_density", f"WITH {_DOCS}, {_POST}, {_GAPS}, {_BLOCKS} SELECT {_BAND} AS band, CAST(count(*) AS BIGINT) AS terms, CAST(sum(df) AS BIGINT) AS postings, CAST(sum(length) AS BIGINT) AS bytes, round(sum(length)::DOUBLE / sum(df), 6) AS bytes_per_posting FROM b GROUP BY 1")(
    lambda spark, sf: B.density(_index(spark, sf).blocks).withColumn("bytes_per_posting", F.round("bytes_per_posting", 6))
)
query("postings_positions", f"WITH {_DOCS}, o AS (SELECT docnum, unnest({_TOK}) AS term, generate_subscripts({_TOK}, 1) - 1 AS pos FROM d) SELECT term, docnum, CAST(count(*) AS INTEGER) AS tf, array_to_string(list(pos ORDER BY pos), ' ') AS places FROM o GROUP BY term, docnum")(
    lambda spark, sf: B.entries(_index(spark, sf).blocks.where("zone = 'text'"), "tfs", "places").select("term", "docnum", "tf", F.array_join("places", " ").alias("places"))
)
_STEPS = (1, 130, 20_000, 3_000_000, 5_000_000_000, 2**49, 2**56)  # gaps of one byte to nine
query("varint_direct", "SELECT doc_id, unnest([" + ", ".join(f"doc_id + CAST({n} AS BIGINT)" for n in _STEPS) + "]) AS docnum FROM documents")(
    lambda spark, sf: _documents(spark, sf).select("doc_id", F.explode(varint.decode_block(varint.encode_block(F.array(*[F.col("doc_id") + n for n in _STEPS])))).alias("docnum"))
)

_RUSSIAN = ["машины", "машиной", "машинам", "играющий", "играют", "играл", "кино", "режиссёра", "ами", "красивая", "строительство", "новости", "ах", "советского", "фильмами"]
_VALUES = ", ".join(f"('{w}')" for w in _RUSSIAN)
_STEM = "regexp_replace(lower({}), '^(.{{3,}}?)(?:" + "|".join(X.SUFFIXES) + ")$', '\\1')"
query("stem_terms", f"SELECT DISTINCT term, {_STEM.format('term')} AS stem FROM (SELECT unnest({_TOK}) AS term FROM documents UNION ALL SELECT * FROM (VALUES {_VALUES}) v(term))")(
    lambda spark, sf: _documents(spark, sf).select(F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term")).union(spark.createDataFrame([(w,) for w in _RUSSIAN], "term string")).distinct().withColumn("stem", X.stem(F.col("term")))
)
_RU_DOCS = f"d AS (SELECT doc_id, list_concat(list_distinct({_TOK}), [" + ", ".join(f"'{w}'" for w in _RUSSIAN) + f"]) AS t FROM documents), s AS (SELECT doc_id, {_STEM.format('term')} AS term FROM (SELECT doc_id, unnest(t) AS term FROM d))"


def _words(spark: SparkSession, sf: str) -> DataFrame:
    words = F.concat(F.array_distinct(X.tokens(F.col("text"))), F.array(*map(F.lit, _RUSSIAN)))
    return _documents(spark, sf).select(F.col("doc_id").alias("docnum"), F.explode(words).alias("term"))


# stems are taken of distinct words, whose counts they add up
query("stemmed_df_compat", f"WITH {_RU_DOCS} SELECT term, CAST(count(*) AS BIGINT) AS df_postings FROM s GROUP BY term")(
    lambda spark, sf: _words(spark, sf).groupBy("term").agg(F.count(F.lit(1)).alias("n")).withColumn("term", X.stem(F.col("term"))).groupBy("term").agg(F.sum("n").alias("df_postings"))
)
query("stemmed_df", f"WITH {_RU_DOCS} SELECT term, CAST(count(DISTINCT doc_id) AS BIGINT) AS df FROM s GROUP BY term")(
    lambda spark, sf: I.vocabulary(_words(spark, sf).withColumn("term", X.stem(F.col("term")))).select("term", "df")
)
query("stemmed_df_once", f"WITH {_RU_DOCS} SELECT term, CAST(count(DISTINCT doc_id) AS BIGINT) AS df FROM s GROUP BY term")(
    lambda spark, sf: I.vocabulary(I.stem_once(materialize(_words(spark, sf), "words"), X.stem)).select("term", "df")
)


@query("index_meta", f"WITH {_DOCS}, {_POST} SELECT (SELECT CAST(count(*) AS BIGINT) FROM d) AS docs_count, (SELECT CAST(sum(len({_TOK})) AS BIGINT) FROM d) AS total_tokens, CAST(count(DISTINCT term) AS BIGINT) AS unique_terms, CAST(count(*) AS BIGINT) AS total_postings FROM p")
def index_meta(spark: SparkSession, sf: str) -> DataFrame:
    """Builds and stores a whole index, whether one is stored already or not."""
    corpus = _title(_documents(spark, sf).select("doc_id", "source", "lang", "text"))
    return I.build(corpus, order=("doc_id",)).meta.select("docs_count", "total_tokens", "unique_terms", "total_postings")


# Boolean search


def _boolean(name: str, text: str, where: str, adjacency: str = "last") -> None:
    query(name, f"WITH {_DOCS}, {_FLAGS} SELECT docnum, docid, title FROM w WHERE {where}")(lambda spark, sf: _match(spark, sf, text, adjacency))


def _match(spark: SparkSession, sf: str, text: str, adjacency: str = "last") -> DataFrame:
    return S.find(_index(spark, sf), text, adjacency)


_has = lambda w: f"list_contains(t, '{w}')"
_boolean("bool_term", "the", _has("the"))
_boolean("bool_and", "the && and", f"{_has('the')} AND {_has('and')}")
_boolean("bool_or", "der || que", f"{_has('der')} OR {_has('que')}")
_boolean("bool_not", "!the", f"NOT {_has('the')}")
_boolean("bool_nested", "(the && !ach) || (der && ach)", f"({_has('the')} AND NOT {_has('ach')}) OR ({_has('der')} AND {_has('ach')})")
_boolean("bool_3and", "the && and && of", f"{_has('the')} AND {_has('and')} AND {_has('of')}")
_boolean("bool_adjacent_last", "the der", _has("der"))
_boolean("bool_adjacent_and", "der die", f"{_has('der')} AND {_has('die')}", "and")
_boolean("bool_unclosed_paren", "(the && der", "false")
_boolean("bool_stray_paren", "the && and) || der", f"({_has('the')} AND {_has('and')}) OR {_has('der')}")
_boolean("bool_double_not", "!!the", _has("the"))
_boolean("bool_bare_not", "!", "true")
_boolean("bool_dangling_or", "|| the", _has("the"))
_boolean("bool_dangling_and", "the &&", "false")
_boolean("bool_case_fallback", "THE && And", f"{_has('the')} AND {_has('and')}")
_boolean("bool_single_ampersand", "the & der", _has("der"))
_boolean("bool_unknown", "zzzz || !zzzz", "true")

# the wider dialect: quotations, distances, zones, synonyms
_SAYS = lambda words: f"contains(' ' || array_to_string(t, ' ') || ' ', ' {words} ')"
_PLACES = "list_filter(range(1, len(t) + 1), lambda i: t[i] = '{}')"
_within = lambda a, b, n: f"len(list_filter({_PLACES.format(a)}, lambda x: len(list_filter({_PLACES.format(b)}, lambda y: y > x AND y <= x + {n})) > 0)) > 0"
_boolean("bool_phrase_not", '"of the" && !ach', f"{_SAYS('of the')} AND NOT {_has('ach')}")
_boolean("bool_phrase_or", '"of the" || «und der»', f"{_SAYS('of the')} OR {_SAYS('und der')}")
_boolean("bool_phrase_and_phrase", '"of the" && !"to the"', f"{_SAYS('of the')} AND NOT {_SAYS('to the')}")
_boolean("bool_phrase_within", '"of the" / 5', _within("of", "the", 5))
_boolean("bool_phrase_repeated", '"the the" / 6', _within("the", "the", 6))
_boolean("bool_phrase_case", '"Of THE"', _SAYS("of the"))
_boolean("bool_title_zone", "title:en && with", "list_contains(regexp_extract_all(lower(title), '" + _TOKEN + "', 1), 'en') AND " + _has("with"))
_boolean("bool_title_phrase", 'title:"src0 en" || title:de', "contains(title, 'src0/en') OR list_contains(regexp_extract_all(lower(title), '" + _TOKEN + "', 1), 'de')")

_PAIRED = [("of", "von"), ("von", "the"), ("the", "of"), ("que", "that"), ("lonely", "lonely")]  # with a cycle


@query("bool_synonyms", f"WITH {_DOCS}, {_FLAGS} SELECT docnum, docid, title FROM w WHERE len(list_intersect(t, ['of', 'von', 'the'])) > 0 AND NOT len(list_intersect(t, ['que', 'that'])) > 0")
def bool_synonyms(spark: SparkSession, sf: str) -> DataFrame:
    classes = N.close(spark.createDataFrame(_PAIRED, "a string, b string"))
    return S.find(_index(spark, sf), "von && !that", synonyms=classes)


_tfs = lambda *words: f"o AS (SELECT docnum, unnest({_TOK}) AS term FROM d), tf AS (SELECT term, docnum, count(*) AS tf FROM o WHERE list_contains({list(words)}, term) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), s AS (SELECT docnum, sum(tf * ln((SELECT count(*) FROM d)::DOUBLE / df)) AS score FROM tf JOIN df USING (term) GROUP BY docnum)"
query("rank_top50", f"WITH {_DOCS}, {_tfs('with', 'from', 'que')} SELECT docnum, docid, title, round(score, 6) AS score FROM s JOIN d USING (docnum) ORDER BY round(s.score, 9) DESC, docnum LIMIT 50")(
    lambda spark, sf: S.rank(_index(spark, sf), "with from que").withColumn("score", F.round("score", 6))
)
query("rank_strict", f"WITH {_DOCS}, {_tfs('with', 'from')}, b AS (SELECT docnum FROM tf WHERE term = 'with' INTERSECT SELECT docnum FROM tf WHERE term = 'from') SELECT docnum, docid, title, round(score, 6) AS score FROM s JOIN d USING (docnum) WHERE docnum IN (FROM b) ORDER BY round(s.score, 9) DESC, docnum LIMIT 50")(
    lambda spark, sf: S.rank(_index(spark, sf), "with && from").withColumn("score", F.round("score", 6))
)


def _misspelt(spark: SparkSession, sf: str) -> DataFrame:
    """A batch of 100 words: terms of small letters, chosen by digest, each without its third letter."""
    plain = _index(spark, sf).vocab.where(F.col("term").rlike("^[a-z]{6,}$"))
    return plain.orderBy(F.md5(F.col("term").cast("binary"))).limit(100).select(F.concat(F.left("term", F.lit(2)), F.substr("term", F.lit(4))).alias("word"))


query(
    "suggest_batch",
    f"WITH v AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_TOK})) AS term FROM documents) GROUP BY term HAVING regexp_full_match(term, '[a-z]+')), q AS (SELECT DISTINCT substr(term, 1, 2) || substr(term, 4) AS word FROM (SELECT term FROM v WHERE length(term) >= 6 ORDER BY md5(term) LIMIT 100))"
    " SELECT word, row_number() OVER (PARTITION BY word ORDER BY levenshtein(word, term), df DESC, term) AS nth, term, CAST(levenshtein(word, term) AS BIGINT) AS distance, CAST(df AS BIGINT) AS df FROM q, v WHERE levenshtein(word, term) <= 2 QUALIFY nth <= 10",
)(lambda spark, sf: fuzzy.suggest_many(_misspelt(spark, sf), _index(spark, sf).soft_terms().where(F.col("term").rlike("^[a-z]+$"))))


# the same through SQL alone


@query("sql_search", f"WITH {_DOCS}, {_FLAGS} SELECT docnum, docid, title FROM w WHERE ({_has('the')} AND NOT {_has('ach')}) OR NOT {_has('der')}")
def sql_search(spark: SparkSession, sf: str) -> DataFrame:
    sql.register_index(spark, _index(spark, sf))
    return spark.sql("SELECT docnum, docid, title FROM search('(The && !ach) || !der')")


@query("sql_tokens", f"SELECT term, {_STEM.format('term')} AS stem, CAST(count(*) AS BIGINT) AS cf FROM (SELECT unnest({_TOK}) AS term FROM (SELECT {_SPLIT} AS text FROM documents)) GROUP BY term")
def sql_tokens(spark: SparkSession, sf: str) -> DataFrame:
    sql.register_functions(spark)
    # not LATERAL tokens(text): Spark would join each token to its text
    found = f"SELECT tokenize(text) AS found FROM (SELECT {_SPLIT} AS text FROM parquet.`{sf}/documents.parquet`)"
    return spark.sql(f"SELECT t.term, stem(t.term) AS stem, count(*) AS cf FROM ({found}) LATERAL VIEW OUTER explode(found) t AS term WHERE t.term IS NOT NULL GROUP BY t.term")


@query("raw_pages", "SELECT sha1(url) AS id, url AS title, CAST(strlen(html) AS BIGINT) AS bytes, md5(html) AS md5 FROM pages WHERE url IS NOT NULL AND html <> ''")
def raw_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages.register(spark)
    rows = spark.read.format("raw_pages").options(titles=f"{sf}/pages.parquet", title="url", text="html").load()
    return rows.select("id", "title", "bytes", F.md5(F.col("text").cast("binary")).alias("md5"))


query("query_snippets")(lambda spark, sf: _documents(spark, sf).select("doc_id", S.biased_snippet(F.col("text"), ["the", "of", "que"]).alias("snippet")))

@query("bool_setops", f"WITH {_DOCS}, {_FLAGS} SELECT docnum FROM w WHERE {_has('the')} INTERSECT SELECT docnum FROM w WHERE {_has('of')} UNION (SELECT docnum FROM w EXCEPT SELECT docnum FROM w WHERE {_has('der')})")
def bool_setops(spark: SparkSession, sf: str) -> DataFrame:
    ix = _index(spark, sf)
    return S.by_set_operations("the && of || !der", ix.postings, ix.forward, vocab=ix.vocab)


@query("bool_postings", f"WITH {_DOCS}, {_FLAGS} SELECT docnum, docid, title FROM w WHERE {_has('the')} AND NOT {_has('ach')} OR {_has('der')}")
def bool_postings(spark: SparkSession, sf: str) -> DataFrame:
    """Postings made on the fly, without a stored index."""
    rows = materialize(_numbered(spark, sf), "rows")
    return S.matches("the && !ach || der", I.document_terms(rows), rows)


_BATCH = [(1, "the && of", f"{_has('the')} AND {_has('of')}"), (2, "!the", f"NOT {_has('the')}"), (3, "der || que", f"{_has('der')} OR {_has('que')}"), (4, "the der", _has("der"))]
query("query_batch", f"WITH {_DOCS}, {_FLAGS}, h AS (" + " UNION ALL ".join(f"SELECT {n} AS query_id, docnum, docid, title FROM w WHERE {c}" for n, _, c in _BATCH) + ") SELECT CAST(query_id AS INTEGER) AS query_id, row_number() OVER (PARTITION BY query_id ORDER BY docnum) AS nth, docnum, docid, title FROM h QUALIFY nth <= 50")(
    lambda spark, sf: (lambda ix: S.search_many([(n, q) for n, q, _ in _BATCH], ix.postings, ix.forward, vocab=ix.vocab))(_index(spark, sf))
)
query("search_top50", f"WITH {_DOCS}, {_FLAGS} SELECT docnum, docid, title FROM w WHERE {_has('the')} ORDER BY docnum LIMIT 50")(lambda spark, sf: _match(spark, sf, "the").orderBy("docnum").limit(50))
query("search_page2", f"WITH {_DOCS}, {_FLAGS} SELECT docnum, docid, title FROM w WHERE {_has('the')} ORDER BY docnum LIMIT 50 OFFSET 50")(lambda spark, sf: _match(spark, sf, "the").orderBy("docnum").offset(50).limit(50))
query("result_page_count", f"WITH {_DOCS}, {_FLAGS} SELECT CAST(count(*) AS BIGINT) AS total, CAST(greatest(1, ceil(count(*) / 50.0)) AS BIGINT) AS pages FROM w WHERE {_has('the')}")(lambda spark, sf: S.page_count(_match(spark, sf, "the")))
query("doc_view", f"WITH {_DOCS} SELECT docnum, docid, title, substr(text, 1, 1000) AS snippet, text FROM d WHERE docnum = 7")(lambda spark, sf: S.document(7, _index(spark, sf).forward, _documents(spark, sf).select(F.col("doc_id").cast("string").alias("docid"), "text")))
query("doc_snippets", "SELECT doc_id, substr(text, 1, 1000) AS snippet FROM documents")(lambda spark, sf: _documents(spark, sf).select("doc_id", X.snippet(F.col("text")).alias("snippet")))
query("phrase_search", f"WITH {_DOCS} SELECT docnum FROM d WHERE contains(' ' || array_to_string({_TOK}, ' ') || ' ', ' of the ')")(lambda spark, sf: S.find(_index(spark, sf), '"of the"').select("docnum"))
query("tf_idf_top", f"WITH {_DOCS}, o AS (SELECT docnum, unnest({_TOK}) AS term FROM d), tf AS (SELECT term, docnum, count(*) AS tf FROM o WHERE term IN ('with', 'from') GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term) SELECT docnum, round(sum(tf * ln((SELECT count(*) FROM d)::DOUBLE / df)), 6) AS score FROM tf JOIN df USING (term) GROUP BY docnum")(
    lambda spark, sf: S.tf_idf(_index(spark, sf), ["with", "from"]).select("docnum", F.round("score", 6).alias("score"))
)

# statistics, verification, crawl

_RANKS = f"v AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_TOK})) AS term FROM documents) GROUP BY term), r AS (SELECT row_number() OVER (ORDER BY df DESC, term) AS rank, df FROM v)"
_vocab = lambda spark, sf: _index(spark, sf).vocab
query("zipf_rank", f"WITH {_RANKS} SELECT rank, CAST(df AS BIGINT) AS df FROM r WHERE rank <= 100000")(lambda spark, sf: T.rank_frequency(_vocab(spark, sf)))
query("zipf_fit", f"WITH {_RANKS} SELECT (SELECT CAST(count(*) AS BIGINT) FROM v) AS total_terms, (SELECT CAST(sum(df) AS BIGINT) FROM v) AS total_tokens, CAST(count(*) AS BIGINT) AS n, round(regr_slope(ln(df), ln(rank)), 6) AS slope, round(regr_intercept(ln(df), ln(rank)), 6) AS intercept, round(regr_r2(ln(df), ln(rank)), 6) AS r2 FROM r WHERE rank <= 100000")(
    lambda spark, sf: T.zipf_report(_vocab(spark, sf)).select("total_terms", "total_tokens", "n", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2")])
)
query("mandelbrot_fit", f"WITH {_RANKS}, s AS (SELECT unnest(range(41)) / 2.0 AS shift), f AS (SELECT CAST(shift AS DOUBLE) AS shift, regr_slope(ln(df), ln(rank + shift)) AS slope, regr_intercept(ln(df), ln(rank + shift)) AS intercept, regr_r2(ln(df), ln(rank + shift)) AS r2, count(*) AS n FROM r, s WHERE rank <= 100000 GROUP BY shift) SELECT shift, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2, CAST(n AS BIGINT) AS n FROM f ORDER BY f.r2 DESC, shift LIMIT 1")(
    lambda spark, sf: T.mandelbrot_fit(T.rank_frequency(_vocab(spark, sf))).select("shift", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2")], "n")
)
query("suggest_terms", f"WITH {_RANKS.split(', r AS')[0]} SELECT term, CAST(levenshtein(term, 'wihtt') AS BIGINT) AS distance, CAST(df AS BIGINT) AS df FROM v WHERE levenshtein(term, 'wihtt') <= 2 ORDER BY distance, df DESC, term LIMIT 10")(lambda spark, sf: S.suggest("wihtt", _vocab(spark, sf)))
query("verify_topk", f"WITH {_DOCS}, {_POST}, v AS (SELECT term, count(*) AS df FROM p GROUP BY term ORDER BY df DESC, term LIMIT 10) SELECT term, CAST(df AS BIGINT) AS df, CAST(df AS BIGINT) AS n_postings, CAST(least(df, 100) AS BIGINT) AS checked, CAST(0 AS BIGINT) AS mismatches FROM v")(
    lambda spark, sf: V.verify(_vocab(spark, sf), _index(spark, sf).postings, _numbered(spark, sf))
)
query("verify_both_ways", "SELECT CAST(0 AS BIGINT) AS unsupported, CAST(0 AS BIGINT) AS missing")(lambda spark, sf: V.verify_all(_index(spark, sf).postings, T.occurrences(_numbered(spark, sf)).select("term", "docnum")))


# an index that was damaged: every seventh posting is lost, and every fifth document has a word that it never said
_DAMAGED = f"{_DOCS}, {_POST}, x AS (SELECT term, docnum FROM p WHERE (docnum + length(term)) % 7 <> 0 UNION ALL SELECT 'the', docnum FROM d WHERE docnum % 5 = 0 AND docnum NOT IN (SELECT docnum FROM p WHERE term = 'the'))"


def _damaged(spark: SparkSession, sf: str) -> DataFrame:
    ix = _index(spark, sf)
    told = ix.postings.where("term = 'the'").select("docnum")
    strays = ix.forward.where("docnum % 5 = 0").select("docnum").join(told, "docnum", "left_anti").select(F.lit("the").alias("term"), "docnum")
    return ix.postings.where((F.col("docnum") + F.char_length("term")) % 7 != 0).unionByName(strays)


query("verify_damaged", f"WITH {_DAMAGED} SELECT (SELECT CAST(count(*) AS BIGINT) FROM x ANTI JOIN p USING (term, docnum)) AS unsupported, (SELECT CAST(count(*) AS BIGINT) FROM p ANTI JOIN x USING (term, docnum)) AS missing")(
    lambda spark, sf: V.verify_all(_damaged(spark, sf), I.document_terms(_numbered(spark, sf)))
)
query("verify_damaged_topk", f"WITH {_DAMAGED}, v AS (SELECT term, count(*) AS df FROM p GROUP BY term ORDER BY df DESC, term LIMIT 10), h AS (SELECT term, docnum, row_number() OVER (PARTITION BY term ORDER BY docnum) AS nth FROM x WHERE term IN (SELECT term FROM v)), m AS (SELECT h.*, p.term IS NULL AS bad FROM h LEFT JOIN p ON p.term = h.term AND p.docnum = h.docnum) SELECT term, CAST(any_value(df) AS BIGINT) AS df, CAST(count(*) AS BIGINT) AS n_postings, CAST(count(*) FILTER (WHERE nth <= 100) AS BIGINT) AS checked, CAST(count(*) FILTER (WHERE nth <= 100 AND bad) AS BIGINT) AS mismatches FROM m JOIN v USING (term) GROUP BY term")(
    lambda spark, sf: V.verify(_vocab(spark, sf), _damaged(spark, sf), _numbered(spark, sf))
)

# labels as judgements: each source's documents in the order of a digest are its results
_JUDGED = "j AS (SELECT source AS query_id, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR))) AS rank, 2 * quality + 1 - toxic AS grade, 3 AS max_grade FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL AND source IS NOT NULL)"
_QUALITY = """, i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, rank) AS ideal_rank, (pow(2, grade) - 1) / pow(2, max_grade) AS stop FROM j),
g AS (SELECT *, coalesce(exp(sum(ln(greatest(1 - stop, 1e-300))) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS go_on FROM i),
k AS (SELECT unnest([1, 3, 5]) AS level),
s AS (SELECT query_id, level, sum(CASE WHEN rank <= level AND grade > 0 THEN 1 ELSE 0 END) / level AS p, sum(CASE WHEN rank <= level THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) AS dcg,
  sum(CASE WHEN ideal_rank <= level THEN (pow(2, grade) - 1) / log2(ideal_rank + 1) ELSE 0 END) AS best, sum(CASE WHEN rank <= level THEN go_on * stop / rank ELSE 0 END) AS err FROM g, k GROUP BY query_id, level)
SELECT query_id, CAST(level AS INTEGER) AS level, round(CAST(p AS DOUBLE), 6) AS p, round(dcg, 6) AS dcg, round(CASE WHEN best > 0 THEN dcg / best ELSE 0 END, 6) AS ndcg, round(err, 6) AS err FROM s"""


@query("search_quality", f"WITH {_JUDGED}{_QUALITY}")
def search_quality(spark: SparkSession, sf: str) -> DataFrame:
    known = spark.read.parquet(f"{sf}/labels.parquet").where("quality IS NOT NULL AND toxic IS NOT NULL")
    rows = _documents(spark, sf).select("doc_id", "source").where("source IS NOT NULL").join(known, "doc_id")
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    judged = C.first_wins(rows, "source", order).select(F.col("source").alias("query_id"), F.col("nth").alias("rank"), (2 * F.col("quality") + 1 - F.col("toxic")).alias("grade"), F.lit(3).alias("max_grade"))
    return T.ranking_levels(judged).select("query_id", "level", *[F.round(c, 6).alias(c) for c in ("p", "dcg", "ndcg", "err")])


query("resume_anti", "SELECT url AS title FROM pages p WHERE NOT EXISTS (SELECT 1 FROM pages q WHERE q.url = p.url AND q.page_id % 3 = 0)")(
    lambda spark, sf: crawl.not_yet(spark.read.parquet(f"{sf}/pages.parquet").select(F.col("url").alias("title")), spark.read.parquet(f"{sf}/pages.parquet").where("page_id % 3 = 0").select(F.col("url").alias("title")))
)
# languages hold sources, sources hold documents, and each source leads back to its languages: a graph with cycles
_EDGES = "e AS (SELECT DISTINCT 'root' AS parent, lang AS child, 'CATEGORY' AS ns FROM documents UNION ALL SELECT DISTINCT lang, source, 'CATEGORY' FROM documents UNION ALL SELECT DISTINCT source, lang, 'CATEGORY' FROM documents UNION ALL SELECT source, CAST(doc_id AS VARCHAR), 'MAIN' FROM documents)"


@query(
    "category_walk",
    f"WITH RECURSIVE {_EDGES}, w(category, level) AS (SELECT 'root', 0 UNION ALL SELECT e.child, w.level + 1 FROM w JOIN e ON e.parent = w.category WHERE e.ns = 'CATEGORY' AND w.level < 2) SELECT e.child AS title, CAST(w.level AS INTEGER) AS level FROM w JOIN e ON e.parent = w.category WHERE e.ns = 'MAIN'",
)
def category_walk(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf)
    edge = lambda a, b, ns: docs.select(a.alias("parent"), b.alias("child"), F.lit(ns).alias("ns"))
    root, lang, source = F.lit("root"), F.col("lang"), F.col("source")
    edges = edge(root, lang, "CATEGORY").union(edge(lang, source, "CATEGORY")).union(edge(source, lang, "CATEGORY")).distinct().union(edge(source, F.col("doc_id").cast("string"), "MAIN"))
    return crawl.walk_categories(materialize(edges, "edges"), "root", 2)
