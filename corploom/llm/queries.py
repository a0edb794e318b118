"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corploom.operators.shared import new_folder

from . import anomaly, boosting, bpe, covertree, infill, langid, linededup, merkle, mixing, ngram_join, tokenfile, toolcalls, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    return anomaly.apply_rules(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "anomaly", "kept")


#: Tools that plain turns stand for, and their parameters.
TURN_TOOLS = {"instruct": {"prompt": ("string", True), "turn": ("integer", True)}, "reply": {"prompt": ("string", True), "turn": ("integer", True)}}


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = toolcalls.from_turns(_table(spark, sf_dir, "conversations"))
    return toolcalls.link(calls, results, TURN_TOOLS).select("conv_id", "call_id", "rank", "turn", "status", F.size("errors").cast("long").alias("n_errors"), "line")


_OP2_SQL = """
WITH RECURSIVE asked AS (
  SELECT conv_id, turn, role, text, 'c' || conv_id || '-' || turn AS call_id FROM conversations WHERE role IN ('system', 'user')
), said AS (
  SELECT conv_id, turn, text, 'c' || conv_id || '-' || (turn - 1) AS call_id FROM conversations WHERE role = 'assistant'
), needs AS (
  SELECT conv_id, turn, 0 AS other FROM asked WHERE turn > 0 UNION SELECT conv_id, turn, turn - 2 FROM asked WHERE turn > 2
), known AS (
  SELECT n.* FROM needs n WHERE EXISTS (SELECT 1 FROM asked o WHERE o.conv_id = n.conv_id AND o.turn = n.other)
), depth(conv_id, turn, d) AS (
  SELECT conv_id, turn, 0 FROM asked a WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.conv_id = a.conv_id AND k.turn = a.turn)
  UNION SELECT k.conv_id, k.turn, d + 1 FROM depth JOIN known k ON k.conv_id = depth.conv_id AND k.other = depth.turn
), ranks AS (
  SELECT conv_id, turn, max(d) AS rank FROM depth GROUP BY ALL
), lost AS (
  SELECT conv_id, turn, count(*) AS n FROM needs n WHERE NOT EXISTS (SELECT 1 FROM asked o WHERE o.conv_id = n.conv_id AND o.turn = n.other) GROUP BY ALL
), linked AS (
  SELECT a.conv_id, a.call_id, a.turn, a.role, a.text, s.text AS content, s.call_id IS NOT NULL AS answered, r.rank, coalesce(l.n, 0) + (a.text IS NULL)::INT AS n_errors
  FROM asked a JOIN ranks r ON r.conv_id = a.conv_id AND r.turn = a.turn LEFT JOIN lost l ON l.conv_id = a.conv_id AND l.turn = a.turn
  LEFT JOIN said s ON s.conv_id = a.conv_id AND s.call_id = a.call_id
)
SELECT conv_id, call_id, CAST(rank AS BIGINT) AS rank, turn,
       CASE WHEN n_errors > 0 THEN 'invalid' WHEN NOT answered THEN 'unanswered' ELSE 'linked' END AS status,
       CAST(n_errors AS BIGINT) AS n_errors,
       '{"arguments":{' || coalesce('"prompt":' || CAST(to_json(text) AS VARCHAR) || ',', '') || '"turn":' || turn || '},"id":' || CAST(to_json(call_id) AS VARCHAR) || ',"name":"'
         || CASE WHEN role = 'system' THEN 'instruct' ELSE 'reply' END || '"' || CASE WHEN answered THEN ',"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') ELSE '' END || '}' AS line
FROM linked
UNION ALL
SELECT s.conv_id, s.call_id, CAST(NULL AS BIGINT), s.turn, 'orphan', CAST(0 AS BIGINT),
       '{"id":' || CAST(to_json(s.call_id) AS VARCHAR) || ',"result":' || coalesce(CAST(to_json(s.text) AS VARCHAR), 'null') || '}'
FROM said s WHERE NOT EXISTS (SELECT 1 FROM asked a WHERE a.conv_id = s.conv_id AND a.call_id = s.call_id)
"""


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, percent=90)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    return boosting.classify(docs, labels).select("doc_id", "held_out", "score", "predicted")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    return toxicity.score(docs, labels).select("doc_id", "held_out", "score", "predicted", "worst_clause", "clause_weight")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.93)


MIX_LEVELS = ["domain", "lang", "source"]
MIX_WEIGHTS = {"domain": {"web": 3, "books": 2, "forum": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.75, 2, 20


def with_domain(docs: DataFrame) -> DataFrame:
    """docs with the domain that a source belongs to: by the number in its name."""
    n = F.try_to_number(F.regexp_extract("source", "([0-9]+)$", 1), F.lit("999999999")).cast("long")
    return docs.withColumn("domain", F.when(n <= 6, "web").when(n <= 13, "books").otherwise("forum"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_domain(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return mixing.choose(docs, MIX_LEVELS, MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED).select("doc_id", "domain", "lang", "source", "copies")


_OP9_LEVEL = """
{name}_n AS (
  SELECT {path}, sum(capacity)::BIGINT AS capacity, {weight} AS weight FROM leaves GROUP BY {path}
), {name}_s AS (
  SELECT n.*, p.budget AS parent_budget,
         coalesce(sum(capacity) OVER (PARTITION BY {parent} ORDER BY capacity / weight, n.{level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
         sum(weight) OVER (PARTITION BY {parent}) - coalesce(sum(weight) OVER (PARTITION BY {parent} ORDER BY capacity / weight, n.{level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_weight,
         row_number() OVER (PARTITION BY {parent} ORDER BY capacity / weight, n.{level}) AS nth
  FROM {name}_n n JOIN {above} p ON {on}
), {name}_l AS (
  SELECT *, (parent_budget - spent)::DOUBLE / open_weight::DOUBLE AS lift FROM {name}_s
), {name}_a AS (
  SELECT *, min(CASE WHEN lift <= capacity::DOUBLE / weight::DOUBLE THEN nth END) OVER (PARTITION BY {parent0}) AS spot FROM {name}_l
), {name}_f AS (
  SELECT *, max(CASE WHEN nth = spot THEN lift END) OVER (PARTITION BY {parent0}) AS level_lift FROM {name}_a
), {name} AS (
  SELECT {path}, greatest(0, CASE WHEN spot IS NULL OR nth < spot THEN capacity ELSE least(capacity, floor(level_lift * weight::DOUBLE)::BIGINT) END)::BIGINT AS budget FROM {name}_f
)"""


def op9_sql(share: float = MIX_SHARE, epochs: int = MIX_EPOCHS) -> str:
    """Copies of each row of documents, at MIX_WEIGHTS and MIX_SEED."""
    weight = lambda level: "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in MIX_WEIGHTS.get(level, {"": 1}).items()) + " ELSE 1 END"
    steps = []
    for n, level in enumerate(MIX_LEVELS):
        up = MIX_LEVELS[:n]
        steps.append(_OP9_LEVEL.format(
            name=f"b{n}", path=", ".join(MIX_LEVELS[: n + 1]), weight=weight(level), level=level, above=f"b{n - 1}" if n else "total",
            parent=", ".join(f"n.{c}" for c in up) or "1", parent0=", ".join(up) or "1", on=" AND ".join(f"n.{c} = p.{c}" for c in up) or "true",
        ))
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source, lang AS lang0, source AS source0,
         CASE WHEN try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) <= 6 THEN 'web' WHEN try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) <= 13 THEN 'books' ELSE 'forum' END AS domain,
         CASE WHEN trim(coalesce(text, ''), {space}) = '' THEN 0 ELSE len(string_split_regex(trim(text, {space}), '[ \t-\r]+')) END::BIGINT AS n_tokens
  FROM documents
), leaves AS (
  SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * {epochs})::BIGINT AS capacity FROM d GROUP BY ALL
), total AS (SELECT floor(sum(tokens)::DOUBLE * {share})::BIGINT AS budget FROM leaves),
{",".join(steps)},
e AS (
  SELECT l.*, b.budget, CASE WHEN tokens > 0 THEN b.budget // tokens ELSE 0 END AS epochs, b.budget - CASE WHEN tokens > 0 THEN b.budget // tokens ELSE 0 END * tokens AS rest
  FROM leaves l JOIN b2 b ON l.domain = b.domain AND l.lang = b.lang AND l.source = b.source
), r AS (
  SELECT d.*, e.epochs, e.rest, md5('{MIX_SEED}:' || e.epochs || ':' || d.doc_id) AS draw
  FROM d JOIN e ON d.domain = e.domain AND d.lang = e.lang AND d.source = e.source
), c AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY draw RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM r
)
SELECT doc_id, domain, lang0 AS lang, source0 AS source, (epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM c
"""


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """A vocabulary among the installed public tokenizers, the byte-level BPE by default."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path()
    coded = bpe.encode_decode(_table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


_OP10_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), r AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.doc_id, k.pos, k.line, (r.keeper IS NOT NULL AND r.keeper <> k.doc_id) AS dropped FROM k LEFT JOIN r ON k.key = r.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

END_ID = 2


def op11_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the whole table's ids and reads the files back."""
    folder = new_folder(spark, "token-file")
    tokenfile.write(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path("word_bpe_49k.json"), folder, END_ID)
    return tokenfile.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.restore(infill.transform(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


_OP12_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), r AS (
  SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d
), f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM r
), o AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
                      ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END AS output
  FROM f
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
       sha256(output) AS output_sha256, sha256(t) AS restored_sha256
FROM o
"""


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(_table(spark, sf_dir, "documents"))


def _op13_sql(depth: int = 5, top_depth: int = 3) -> str:
    """Trees of a fixed depth, more than enough: a group of 16 ** depth rows, 16 ** top_depth groups."""
    told = lambda x: f"coalesce(strlen({x}) || ':' || {x}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(told(x) for x in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"

    def levels(name: str, n: int) -> str:
        out = ""
        for k in range(1, n + 1):
            alone = "count(*) = 1 AND min(pos) = 0"
            run = "string_agg(digest, '' ORDER BY pos)"
            out += f", {name}{k} AS (SELECT grp, up AS pos, CASE WHEN {alone} THEN NULL ELSE {run} END AS pre, CASE WHEN {alone} THEN min(digest) ELSE sha256({run}) END AS digest FROM (SELECT *, pos // 16 AS up FROM {name}{k - 1}) GROUP BY grp, up)"
        return out

    steps = [(f"g{k}", "l.grp", "l.pos", k) for k in range(1, depth + 1)] + [(f"t{k}", "''", "t0.pos", k) for k in range(1, top_depth + 1)]
    joins = "".join(f" JOIN {t} ON {t}.grp = {grp} AND {t}.pos = {pos} // {16**k}" for t, grp, pos, k in steps)
    picked = ", ".join(f"{t}.pre AS p{i}, ({pos} // {16 ** (k - 1)}) % 16 * 64 AS s{i}" for i, (t, _, pos, k) in enumerate(steps))
    cut = " || ".join(f"coalesce(substr(p{i}, 1, s{i}) || substr(p{i}, s{i} + 65), '')" for i in range(len(steps)))
    folds = "".join(f", f{i + 1} AS (SELECT *, CASE WHEN p{i} IS NULL THEN v{i} ELSE sha256(substr(p{i}, 1, s{i}) || v{i} || substr(p{i}, s{i} + 65)) END AS v{i + 1} FROM f{i})" for i in range(len(steps)))
    return f"""
WITH c AS (
  SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
), d AS (
  SELECT *, coalesce('=' || source, '') AS grp,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295) AS crc
  FROM documents, c
), h AS (
  SELECT doc_id, grp, {leaf("text")} AS digest, coalesce(crc % 5 = 0, false) AS touched, {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS other FROM d
), l AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos FROM h
), g0 AS (SELECT grp, pos, digest FROM l){levels("g", depth)}
, t0 AS (SELECT '' AS grp, grp AS name, digest, row_number() OVER (ORDER BY grp) - 1 AS pos FROM g{depth}){levels("t", top_depth)}
, f0 AS (
  SELECT l.doc_id, l.digest AS leaf, t0.digest AS subroot, t{top_depth}.digest AS root, CASE WHEN touched THEN other ELSE l.digest END AS v0, {picked}
  FROM l JOIN t0 ON t0.name = l.grp{joins}
){folds}
SELECT doc_id, leaf, subroot, root, sha256({cut}) AS proof_sha256, v{len(steps)} AS folded_root, v{len(steps)} = root AS verified FROM f{len(steps)}
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_tool_calls": op2_tool_calls,
    "op3_ngram_join": op3_ngram_join,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_language_id": op5_language_id,
    "op6_bpe": op6_bpe,
    "op7_toxicity": op7_toxicity,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_source_mixing": op9_source_mixing,
    "op10_line_dedup": op10_line_dedup,
    "op11_token_file": op11_token_file,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLE_SQL: dict[str, str] = {
    "op2_tool_calls": _OP2_SQL,
    "op9_source_mixing": op9_sql(),
    "op10_line_dedup": _OP10_SQL,
    "op12_fill_in_middle": _OP12_SQL,
    "op13_merkle_manifest": _op13_sql(),
}
