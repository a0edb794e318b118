"""Token files, fill-in-middle and manifests against plain versions on nasty tables."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corploom.llm import infill, merkle, queries, tokenfile
from corploom.operators.shared import new_folder

WORDS = queries.vocabulary_path("word_bpe_49k.json")
TEXTS = [
    (5, "It's a TEST, isn't it? we'LL see 12 34 &&& x"), (1, None), (2, ""), (3, "  \n\t "), (4, "a<S>b"), (6, "ΑΣ ΟΔΟΣ İstanbul ǅ ﬁn é H̱ x̖́"), (7, "line one\nline two\n\nlast"),
    (8, "日本語 ½ é <|endoftext|> <|ENDOFTEXT|> y<|startoftext|>z # * | ! <b>"), (9, "ab " * 30_000), (10, "a" * 70_000), (11, "\x1c control\x85x y\x0bz\x0c q r"), (12, "É'S l'été DON'T ÷× ÿŸ ß ª"),
    (12, "É'S l'été DON'T ÷× ÿŸ ß ª"), (12, "another row of twelve"), (None, "no id"), (None, None), (-7, "negative"), (2**40, "large id 😀 😀a"), (13, "<P"), (14, "x<M>"), (15, "😀"), *((100 + i, f"Word{i} text {i}") for i in range(60)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if n % 9 == 4 else "en", None if n % 11 == 3 else "big" if n % 3 else f"src{n % 5}", None if t is None else len(t), "x", 7, 0) for n, (i, t) in enumerate(TEXTS)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, form string, pos int, start int"
    return spark.createDataFrame(rows, schema).repartition(3).cache()


def library(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    return t.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library():
    rng, encode = random.Random(3), tokenfile.Encoder(WORDS)
    assert encode.by_words
    signs = "aB'sStT12 .,!-\n\té́É̱ßŸ\x1c\x85<|>ǅΣ日½_ ‍"
    texts = [t or "" for _, t in TEXTS] + ["".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(400)]
    for t in texts:
        assert np.frombuffer(encode(t.encode()), "<u4").tolist() == library(t), t
    whole = tokenfile.Encoder(queries.vocabulary_path())
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(queries.vocabulary_path())
    assert not whole.by_words
    assert np.frombuffer(whole(b"two  words<|endoftext|>"), "<u4").tolist() == other.encode("two  words<|endoftext|>", add_special_tokens=False).ids


def test_cache_begins_anew(monkeypatch):
    monkeypatch.setattr(tokenfile, "CACHE_WORDS", 3)
    encode = tokenfile.Encoder(WORDS)
    for t in ("one two three four five", "two six", "one two"):
        assert np.frombuffer(encode(t.encode()), "<u4").tolist() == library(t)
    assert len(encode.words) <= 3


def test_token_file(spark, docs, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_BYTES", 300)
    monkeypatch.setattr(tokenfile, "BLOCK_DOCS", 7)
    folder = new_folder(spark, "token-file")
    tokenfile.write(docs, WORDS, folder, 2)
    got = sorted(tokenfile.read(spark, folder).collect(), key=lambda r: r["start"])
    want = sorted(((i, (library(t) + [2])) for i, t in TEXTS), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r["doc_id"] for r in got] == [i for i, _ in want]
    at = 0
    for r in got:  # whole files: starts have no gaps
        assert r["start"] == at and r["n_tokens"] * 4 == len(r["ids"])
        at += r["n_tokens"]
    key = lambda i, ids: (i is not None, i or 0, ids)
    assert sorted(key(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got) == sorted(key(i, ids) for i, ids in want)
    blocks = spark.read.parquet(f"{folder}/blocks")
    assert blocks.count() > 5 and blocks.select("dict_hash").distinct().count() == 1 and max(len(r["doc_ids"]) for r in blocks.collect()) <= 7
    few = {r["doc_id"]: (r["start"], bytes(r["ids"])) for r in tokenfile.lookup(spark, folder, [9, -7, 2**40, 999, 130]).collect()}
    assert few == {r["doc_id"]: (r["start"], bytes(r["ids"])) for r in got if r["doc_id"] in (9, -7, 2**40, 130)}
    assert tokenfile.lookup(spark, folder, []).count() == 0


def test_token_file_with_a_dictionary(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    folder = new_folder(spark, "token-file")
    tokenfile.write(docs, WORDS, folder)
    row = spark.read.parquet(f"{folder}/dictionary").first()
    assert row["dict_hash"] == hashlib.sha256(row["dictionary"]).hexdigest()
    got, at = {r["doc_id"]: r for r in queries.op11_token_file(spark, "/root/testdata/sf0.001").collect()}, 0
    for r in docs.orderBy("doc_id").collect():
        ids = library(r["text"]) + [2]
        assert (got[r["doc_id"]]["start"], got[r["doc_id"]]["n_tokens"]) == (at, len(ids))
        assert got[r["doc_id"]]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    spark.createDataFrame([("other", b"")], "dict_hash string, dictionary binary").write.mode("overwrite").parquet(f"{folder}/dictionary")
    with pytest.raises(Exception, match="another dictionary"):
        tokenfile.read(spark, folder).count()


def test_empty_token_file(spark, docs):
    folder = new_folder(spark, "token-file")
    tokenfile.write(docs.limit(0), WORDS, folder)
    assert tokenfile.read(spark, folder).count() == 0
    assert tokenfile.lookup(spark, folder, [1]).count() == 0


# fill-in-middle


def units(text, rule):
    """The rule spelt out character by character."""
    out, run = [], ""
    for c in text:
        if c in rule.breaks:
            out += [run] * bool(run) + [c]
            run = ""
        else:
            run += c
            if rule.width and len(run) == rule.width:
                out.append(run)
                run = ""
    return out + [run] * bool(run)


@pytest.mark.parametrize("rule", [infill.CODE_POINTS, infill.WORDS, infill.LINES, infill.UnitRule(" ", 3), infill.UnitRule("", 4)])
def test_ranks(rule):
    rng = random.Random(1)
    for t in ["", " ", "\n\n", *("".join(rng.choices("ab \n😀é", k=rng.randrange(30))) for _ in range(200))]:
        own, ranks = units(t, rule), infill.Ranks(len(t), infill.EventScan(rule, ("<S>",)).breaks(t) if rule.breaks else [], rule.width)
        assert ranks.total == len(own)
        assert [ranks.offset(k) for k in range(len(own) + 1)] == list(itertools.accumulate(map(len, own), initial=0))


def brute_fim(doc_id, text, rule=infill.CODE_POINTS):
    t, own = text or "", units(text or "", rule)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(own) + 1), h[1] % (len(own) + 1)))
    p, m, s = "".join(own[:a]), "".join(own[a:b]), "".join(own[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(own), "plain", None, None, t, t
    if h[3] % 100 < 20:
        return len(own), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", t
    return len(own), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", t


@pytest.mark.parametrize("rule", [infill.CODE_POINTS, infill.WORDS])
def test_fill_in_middle(docs, rule):
    made = infill.restore(infill.transform(docs, rule))
    assert set(docs.columns) - {"text"} <= set(made.columns)
    got = sorted(map(str, (tuple(r) for r in made.select("doc_id", *infill.RESULTS, "restored").collect())))
    assert got == sorted(str((i, *brute_fim(i, t, rule))) for i, t in TEXTS)
    assert {"plain", "psm", "spm"} == {brute_fim(i, t)[1] for i, t in TEXTS}
    assert infill.restore(infill.transform(docs.limit(0), rule)).count() == 0


def test_sentinels_are_checked(docs):
    for bad in (("<P>", "<P>", "<M>"), ("", "b", "c"), ("ab", "a", "c"), ("ab", "bc", "d"), ("aa", "b", "c")):
        with pytest.raises(ValueError, match="sentinels"):
            infill.transform(docs, sentinels=bad)
    made = infill.restore(infill.transform(docs, sentinels=("[.", "]+", "(*")), ("[.", "]+", "(*"))
    assert sorted(r["restored"] for r in made.collect()) == sorted(t or "" for _, t in TEXTS)
    with pytest.raises(ValueError, match="ASCII"):
        infill.UnitRule("é", 1)


# manifests


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_tree(digests):
    """The root, and each leaf's siblings as (left, right) level by level."""
    level, paths, of = digests, [[] for _ in digests], list(range(len(digests)))
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for leaf, at in enumerate(of):
            run = runs[at // 16]
            paths[leaf].append((run[: at % 16], run[at % 16 + 1 :]))
        of = [at // 16 for at in of]
        level = [sha("".join(r)) for r in runs]
    return level[0], paths


def brute_audit(rows):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, text: sha("".join(map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text))))
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    names, trees = sorted(groups, key=lambda s: (s is not None, (s or "").encode())), {}
    for s in names:
        groups[s].sort(key=lambda x: x[:3])
        trees[s] = brute_tree([x[2] for x in groups[s]])
    root, above = brute_tree([trees[s][0] for s in names])
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for s, up in zip(names, above, strict=True):
        for (_, _, own, r), path in zip(groups[s], trees[s][1], strict=True):
            v = own
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None:
                v = leaf(r, r["text"].translate(low))
            for left, right in path + up:
                v = sha("".join([*left, v, *right]))
            yield r["doc_id"], own, trees[s][0], root, sha("".join("".join(a + b) for a, b in path + up)), v, v == root


def test_manifest(spark, docs):
    many = spark.range(700).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text "), F.col("id")).alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") < 300, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 40)).alias("source"), F.lit(3).cast("long").alias("n_chars"))
    for table in (docs, many.repartition(5), many.where("doc_id between 283 and 315 OR doc_id = 690")):
        got, want = merkle.audit(table).collect(), list(brute_audit(table.collect()))
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert merkle.audit(docs.limit(0)).count() == 0
    assert merkle.build(docs.limit(0)).root() is None
    with pytest.raises(ValueError, match="power of two"):
        merkle.build(docs, fan_out=10)


def test_manifest_is_stored(spark, docs):
    folder, built = new_folder(spark, "manifest"), merkle.build(docs, fan_out=4)
    built.save(folder)
    again = merkle.Manifest.open(spark, folder)
    assert again.root() == built.root() == merkle.build(docs.repartition(7), fan_out=4).root()
    rows = merkle.proofs(again).select("digest", "root", merkle.fold(F.col("digest"), F.col("steps")).alias("folded"), merkle.fold(F.lit("0" * 64), F.col("steps")).alias("bad")).collect()
    assert len(rows) == len(TEXTS) and all(r["folded"] == r["root"] != r["bad"] for r in rows)


def test_a_hot_group_is_spread(spark):
    """All rows but a few in one group, many with one key: positions come from ranges, and no partition holds a large part."""
    nodes = spark.range(4000).select(F.when(F.col("id") % 50 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id"))).alias("grp"), F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    placed = merkle.place(nodes, "key", "digest")
    bounds = placed.groupBy("grp").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.count_distinct("pos").alias("n"), F.count(F.lit(1)).alias("m"))
    assert all((r["a"], r["b"]) == (0, r["m"] - 1) and r["n"] == r["m"] for r in bounds.collect())
