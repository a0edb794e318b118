"""The operators against brute force on small nasty tables: nulls, empty and long texts, repeats, ties, clashing columns, empty tables."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corploom.llm import anomaly, boosting, bpe, components, covertree, docstats, langid, linededup, mixing, ngram_join, queries, toolcalls, toxicity
from corploom.llm.components import connected_components
from corploom.llm.work import materialize

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
LINE = "This line stands in many of the documents"
TEXTS = [
    (1, BASE), (2, BASE.upper()), (3, BASE + " more"), (4, BASE.replace("twenty", "XX")), (5, None), (6, ""), (7, "  \n\t "), (8, "word"), (9, "two words"),
    (10, f"{LINE}\nown line of ten\n\t{LINE.upper()} \nÄÖ É"), (11, f"{LINE}\nshort"), (12, f"{LINE}\n{LINE}\n"), (13, f"x\n{LINE}"), (14, "a" * 70_000), (15, "ab " * 30_000),
    (16, "日本語 ½ é <|endoftext|> # * | ! <b>"), (17, "\n".join(["same line with words"] * 40)), (18, "two words"), (18, "two words"), (None, BASE), (19, " ".join(f"w{i}" for i in range(400))),
    (20, " ".join(f"w{i}" for i in range(395))), (21, " ".join(f"w{i}" for i in range(30, 400))), (22, "\x1c control\x85x y"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i == 4 else "en", None if i == 3 else f"src{(i or 0) % 3}", 1.5, "other", 7) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, kept string, copies int").repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(1, 23)] + [(None, 1, 1), (3, None, None), (99, 1, 0)], "doc_id long, quality int, toxic int")


def found(df, key="doc_id"):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r[key]].append(r)
    return out


# statistics and rules


def brute_counts(text):
    w = WORD.findall(text or "")
    windows = list(zip(w, w[1:], w[2:], strict=False))
    seen, n = set(), collections.Counter(windows)
    for i, x in enumerate(windows):
        if n[x] > 1:
            seen |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(seen)


def test_rules(docs, labels):
    out = anomaly.apply_rules(docs, labels, trees=10)
    assert out.count() == len(TEXTS)
    for r in out.join(docs.select("doc_id", "text"), "doc_id").distinct().collect():
        counts = brute_counts(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts, r["doc_id"]
        assert r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r["base_failed"] and r["kept"])
    assert anomaly.apply_rules(docs.limit(0), labels).count() == 0
    assert {r["kept"] == (not r["base_failed"]) for r in anomaly.apply_rules(docs, labels.limit(0)).collect()} == {True}


def test_path_lengths_against_a_walk():
    """The forest's scores are what walking every tree node by node gives, and the mean path is that of the random splits themselves."""
    rng = np.random.default_rng(15)
    x = rng.normal(size=(200, 3))
    f = anomaly.IsolationForest.grow(x, trees=30, subsample=32)
    euler = 0.5772156649015329
    usual = lambda n: 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + euler) - 2 * (n - 1) / n
    for row, got in zip(x[:40], f.score(x[:40]), strict=True):
        total = 0.0
        for t in range(30):
            node, steps = 0, 0
            while f.feature[t, node] >= 0:
                node, steps = 2 * node + 1 + int(row[f.feature[t, node]] > f.split[t, node]), steps + 1
            assert steps <= 5
            assert f.length[t, node] >= steps
            total += f.length[t, node]
        assert got == pytest.approx(2.0 ** -(total / 30 / usual(32)))
    assert [float(anomaly.mean_path(n)) for n in (1, 2, 3, 10)] == pytest.approx([usual(n) for n in (1, 2, 3, 10)])


def brute_ratios(text):
    """The sixteen ratios, from words, lines and characters."""
    w, raw = WORD.findall(text), text.encode()
    n, chars = max(1, len(w)), max(1, len(text))
    size = [len(x) for x in w]
    mean = sum(size) / n
    _, _, symbols, dup_lines, repeats = brute_counts(text)
    share = lambda keep: sum(map(keep, text)) / chars
    return [
        mean, np.sqrt(max(0, sum(s * s for s in size) / n - mean**2)), symbols / n, dup_lines / (text.count("\n") + 1), repeats / n, len(set(w)) / n, sum(a == b for a, b in zip(w, w[1:], strict=False)) / n,
        sum(s <= 3 for s in size) / n, sum(s >= 12 for s in size) / n, share(lambda c: "A" <= c <= "Z"), share(lambda c: "0" <= c <= "9"), share(lambda c: c in ".,;:?\"'()-"),
        text.count("|") / n, text.count("!") / n, sum(b < 128 for b in raw) / max(1, len(raw)), sum("A" <= x[0] <= "Z" for x in w) / n,
    ]


def test_ratios_against_a_slow_version():
    import pyarrow as pa

    texts = [t or "" for _, t in TEXTS]
    _, ratios = docstats.statistics(pa.array(texts))
    for text, got in zip(texts, ratios, strict=True):
        assert np.allclose(got, brute_ratios(text)), text[:60]


def test_convolution_against_loops():
    """Pooled filter responses and probabilities, spelt out: one window, one filter, one offset at a time."""
    rng = np.random.default_rng(16)
    y = rng.integers(0, 2, 80)
    x = rng.integers(97, 123, (80, langid.WINDOW)).astype(np.uint8)
    x[y == 1, ::5] = 32
    net = langid.ByteConvNet.fit(x, y, ["a", "b"], filters=3, epochs=60)
    got = net.probabilities(x[:6])
    for row, p in zip(x[:6], got, strict=True):
        hidden = []
        for table in net.tables:
            for f in range(table.shape[2]):
                responses = [sum(float(table[k][row[at + k], f]) for k in range(len(table))) for at in range(langid.WINDOW - len(table) + 1)]
                hidden.append(max(0.0, max(responses) + float(net.bias[len(hidden)])))
        z = np.array(hidden) @ net.dense + net.dense_bias
        e = np.exp(z - z.max())
        assert np.allclose(p, e / e.sum(), atol=1e-4)
    assert (net.probabilities(x).argmax(axis=1) == y).mean() > 0.95


def test_rules_on_labels_not_seen(spark):
    """Threshold and forest come from half of the labels, the figures from the other half."""
    d, lab = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    seen = F.xxhash64("doc_id", F.lit(3)) % 2 == 0
    out = anomaly.apply_rules(d.join(lab.select("doc_id"), "doc_id", "left_semi"), lab.where(seen)).join(lab.where(~seen), "doc_id").where("not base_failed")
    kept = {r["quality"]: r["k"] for r in out.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("k")).collect()}
    print("held-out share kept", kept)
    assert kept[1] > 0.97
    assert kept[0] < 0.5


def test_isolation_forest():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(500, 4)), rng.normal(6, 1, size=(10, 4))])
    s = anomaly.IsolationForest.grow(x, trees=80, subsample=128).score(x)
    assert s[500:].min() > np.quantile(s[:500], 0.97)
    assert np.isclose(anomaly.IsolationForest.grow(np.zeros((5, 2))).score(np.zeros((1, 2)))[0], anomaly.IsolationForest.grow(np.zeros((5, 2))).score(np.ones((1, 2)))[0])
    assert anomaly.threshold_from_labels(np.array([0.1, 0.9]), np.array([True, True])) == float("inf")
    assert 0.2 < anomaly.threshold_from_labels(np.array([0.1, 0.2, 0.9]), np.array([True, True, False])) < 0.9


def test_rules_learn_from_all_labelled_rows(spark):
    """Order statistics of all rows, and a forest whose path lengths are those of all rows."""
    rng = np.random.default_rng(5)
    x = np.round(rng.gamma(1.0, 0.2, (15_000, len(docstats.RATIOS))), 3)
    bad = np.arange(len(x)) % 100 == 7
    x[bad] += 3
    rows = spark.createDataFrame([(i, 300, 0, 0, 0, 0, r) for i, r in enumerate(x.tolist())], f"doc_id long, {', '.join(f'{c} long' for c in docstats.COUNTS)}, ratios array<double>").repartition(5)
    labels = spark.createDataFrame([(i, int(not b)) for i, b in enumerate(bad.tolist())], "doc_id long, quality int")
    got = anomaly.calibrate(rows, labels, trees=20)
    at = lambda v, share: np.sort(v, axis=0)[int(share * (len(v) - 1))]
    assert np.array_equal(got.centre, at(x, 0.5))
    assert np.array_equal(got.scale, np.maximum(at(np.abs(x - got.centre), 0.75), 1e-3))
    scaled = got.scaled(x, np.full(len(x), 300))
    for length, node in zip(got.forest.length, got.forest.leaves(scaled), strict=True):
        k = np.bincount(node, minlength=len(length))
        assert np.allclose(length[k > 0], (np.floor(np.log2(np.arange(len(k)) + 1)) + anomaly.mean_path(k / len(x) * 64))[k > 0])
    score = got.score(x, np.full(len(x), 300))
    assert abs(got.threshold - anomaly.threshold_from_labels(score, ~bad)) < 1e-4
    assert (score[bad] > got.threshold).all()


def test_rules_keep_good_and_reject_bad(spark):
    d, lab = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    m = anomaly.apply_rules(d, lab).join(lab, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("k")).collect()
    kept = {r["quality"]: r["k"] for r in m}
    assert kept[1] > 0.98
    assert kept[0] < 0.5


# classifiers


def test_boosting_learns():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = boosting.BoostedTrees.fit(x[:1500], y[:1500])
    assert ((m.probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    slow = m.bias + np.zeros(20)
    for t in range(len(m.leaf)):  # the same trees, node by node
        for i in range(20):
            node = 0
            while node < m.feature.shape[1]:
                node = 2 * node + 1 + int(x[i, m.feature[t, node]] > m.split[t, node])
            slow[i] += m.leaf[t, node - m.feature.shape[1]]
    assert np.allclose(slow, m.margin(x[:20]))


@pytest.mark.parametrize("run", [lambda d, lab: boosting.classify(d, lab), lambda d, lab: toxicity.score(d, lab), lambda d, lab: langid.identify(d)])
def test_classifiers_on_nasty_rows(docs, labels, run):
    out = run(docs, labels)
    rows = out.collect()
    assert len(rows) == len(TEXTS)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert run(docs.limit(0), labels).count() == 0
    assert run(docs, labels.limit(0)).count() == len(TEXTS)


def test_held_out_accuracy(spark):
    d, lab = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    q = boosting.classify(d, lab).join(lab, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in q]) > 0.95
    t = toxicity.score(d, lab).join(lab, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] for r in t if r["toxic"]) >= 0.5 * sum(r["toxic"] for r in t)
    assert sum(r["predicted"] for r in t if not r["toxic"]) <= 2
    g = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in g]) > 0.97


def test_languages_without_letters(docs):
    out = found(langid.identify(docs))
    assert {i for i in (5, 6, 7) if out[i][0]["lang_pred"] == "und"} == {5, 6, 7}
    assert out[1][0]["lang_pred"] == "en"
    assert langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0


def test_windows_cover_texts():
    text = bytes(range(97, 123)) * 20
    x, doc, used = langid.windows(np.frombuffer(text + b"xy", np.uint8), np.array([0, len(text), len(text), len(text) + 2]))
    assert b"".join(bytes(r[:n]) for r, n in zip(x[doc == 0], used[doc == 0], strict=True)) == text
    assert (doc == 1).sum() == 0
    assert used[doc == 2].tolist() == [2]


def test_grammar():
    g = toxicity.Grammar({})
    plain, aimed, negated, reported = (g.clause(c) for c in ("that idiot", "you idiot", "you are not an idiot", "he said you idiot"))
    assert aimed > plain > 0
    assert negated < aimed
    assert reported < aimed
    assert g.clause("i will kill you") > g.clause("kill the process") == 0
    assert g.clause("the sky is blue") == 0
    one, two = toxicity._held(1, {2: (2.0, 1.0)}), toxicity._held(3, {2: (3.0, 0.5)})  # noqa: SLF001
    both = one.compose(two)
    for word in itertools.product(range(4), repeat=4):  # the composition does what both do side by side
        s, a, b = 0, 0, 0
        for x in word:
            (s, f, p), (a, fa, pa), (b, fb, pb) = both.at(s, x), one.at(a, x), two.at(b, x)
            assert (f, p) == (fa * fb, pa + pb)


def test_grammar_negated_threat():
    g = toxicity.Grammar({})
    score = lambda c: float(g.score(np.array([[g.clause(c), np.log1p(g.clause(c)), np.log1p(1)]]))[0])
    for plain, negated in (("i will kill you", "i will not kill you"), ("he will hurt and beat them", "he will never hurt or beat them")):
        assert 0 < g.clause(negated) == 0.5 * g.clause(plain)
        assert score(negated) < 0.3 < score(plain)
    assert g.clause("kill not hurt you") == g.clause("do not hurt but go and kill all of you") == g.clause("kill you") == 3.0
    assert g.clause("kill you not") == 3.0  # only a negation before the verb counts
    assert g.clause("he said i will not kill you") == pytest.approx(0.6 * 1.5)


def test_grammar_reads_sentences():
    g = toxicity.Grammar({})
    weight = {c: g.clause(c) for c in (
        "that idiot", "you idiot", "you are not an idiot", "no, you idiot", "he said: you are an idiot", "he said, you are an idiot", "you are an idiot. he said so", "idiot, you", "the book \"the idiot\" is long",
        "she quoted: \"i will kill you\"", "they kill. you", "kill the process", "you are kind; an idiot",
    )}
    assert weight["that idiot"] == toxicity.BARE * 2 == weight["you are kind; an idiot"]
    assert weight["you idiot"] == weight["no, you idiot"] == weight["you are an idiot. he said so"] == 2.0
    assert weight["you are not an idiot"] == 1.0
    assert weight["he said: you are an idiot"] == weight["he said, you are an idiot"] == pytest.approx(1.2)
    assert weight["idiot, you"] == pytest.approx(2.4)
    assert weight["the book \"the idiot\" is long"] == pytest.approx(0.24)
    assert weight["she quoted: \"i will kill you\""] == pytest.approx(3 * 0.36)
    assert weight["they kill. you"] == weight["kill the process"] == 0


def slow_sentences(g, text):
    """What the grammar's rules say of each sentence, by distances between words and without any states."""
    word = re.compile(r"[^\W\d_]+|[\"“”«»]|[,:\n]|[.!?;]+")
    out, sentence, open_for = [], [], 0
    for w in [*word.findall(text), None]:
        if w is not None and w[0] not in ".!?;":
            symbol, weight = g.symbol(w)
            if symbol == toxicity.QUOTE:
                open_for = 0 if open_for else 3
            sentence.append((symbol, weight, open_for > 0))
            continue
        total, at = 0.0, lambda kind, i, reach: [j for j in range(max(0, i - reach), i) if sentence[j][0] == kind]  # noqa: B023
        negated = lambda i: any(all(sentence[k][0] != toxicity.BREAK for k in range(j, i)) for j in at(toxicity.NEGATION, i, 3))  # noqa: B023
        for i, (symbol, weight, quoted) in enumerate(sentence):
            scale = (0.6 if at(toxicity.REPORT, i, i) else 1) * (0.6 if quoted else 1)
            if symbol == toxicity.INSULT:
                total += weight * scale * (0.5 if negated(i) else 1) * (1 if at(toxicity.TARGET, i, 4) else toxicity.BARE)
            if symbol == toxicity.TARGET:
                verbs, insults = at(toxicity.THREAT, i, 3), at(toxicity.INSULT, i, 2)
                if verbs:
                    total += scale * (1.5 if all(negated(j) for j in verbs) else 3.0)
                if insults and not at(toxicity.TARGET, insults[-1], 4) and not at(toxicity.TARGET, i, i - insults[-1]):
                    total += scale * 2.0
        out.append(total)
        sentence, open_for = [], max(0, open_for - 1)
    return out


def test_features_against_a_slow_version():
    import pyarrow as pa

    rng, g = np.random.default_rng(8), toxicity.Grammar({"grob": 3.5, "vile": 1.25})
    vocabulary = "you idiot grobian vilest kill not said , : \" . ! the sky er « \n ein moron hurt them never wrote ; x7 é".split(" ")
    texts = [" ".join(rng.choice(vocabulary, int(n))) for n in rng.integers(0, 60, 400)] + ["", "(idiot)you", "IDIOT YOU", "l’idiot", "\nidiot\nyou\n"]
    x, worst = g.features(pa.array([*texts, None]))
    for i, text in enumerate([*texts, ""]):
        want = slow_sentences(g, text.lower())
        assert np.allclose(x[i], [max(want), np.log1p(sum(want)), np.log1p(sum(w > 1e-12 for w in want))]), text
        assert (worst[i][0] is None) == (max(want) == 0)
        if worst[i][0] is not None:
            assert worst[i][0] in text.lower()


def test_matched_clauses_decide_not_words(monkeypatch):
    """Documents that differ by the clause around a word, not by the word: only the machine tells them apart."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    filler = lambda: " ".join(rng.choice(["sky", "blue", "river", "stone", "walk", "green"], 12))
    aimed = ["you are a {}", "they are {} people", "{}, you", "today you {} must go"]
    other = ["the {} is a word", "you are not a {}", "he said: you are a {}", "the title “you {}” is old", "she wrote that they are {}"]
    make = lambda toxic: f"{filler()}. {rng.choice(aimed if toxic else other).format(rng.choice(['idiot', 'moron', 'scum', 'clown']))}. {filler()}"
    y = rng.integers(0, 2, 600)
    texts = pa.array([make(t) for t in y])

    def accuracy():
        g = toxicity.Grammar({})
        x, _ = g.features(texts)
        g.curve = toxicity.fit_curve(x[:400], y[:400].astype(float))
        return ((g.score(x[400:]) >= 0.5) == y[400:]).mean()

    assert accuracy() > 0.95
    cells = 9
    monkeypatch.setattr(toxicity, "_tables", lambda: ([0] * cells, [1.0] * cells, [0.0] * cells))  # the machine does nothing
    assert accuracy() < 0.7


def test_scores_rank_where_no_word_is_sure(spark):
    """Each word of the toxic documents stands in too few labelled ones to enter the lexicon; held-out toxic documents still come before the others."""
    rng = np.random.default_rng(4)
    common, marks = ["".join(rng.choice(list("bdfgklm"), 6)) for _ in range(300)], ["zurquat", "zelbino", "zamprek", "zoltier", "zickorn", "zuvelle"]
    rows = [(i, " ".join([*rng.choice(common, 40), *([marks[i // 10 % 6]] * 3 if i % 10 == 0 else [])]), int(i % 10 == 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = toxicity.score(docs.select("doc_id", "text"), docs.select("doc_id", "toxic")).where("held_out").join(docs.select("doc_id", "toxic"), "doc_id").collect()
    one, zero = ([r["score"] for r in out if r["toxic"] == y] for y in (1, 0))
    assert len(one) > 5
    assert np.mean([(a > b) + (a == b) / 2 for a in one for b in zero]) > 0.8


def test_hints_against_a_slow_version():
    import pyarrow as pa

    g = toxicity.Grammar({"grob": 3.5}, {"zurq": 8.0, "zurquat": 6.5, "über": 2.0})
    texts = ["zurquat is here. you zurquat", "he said you zurqa: x", "not a zurquat « you über überall »", "grobian zur", "", "zurquat idiot, you"]
    want = [8 * 0.2 + 8, 0.6 * 8, 0.5 * 0.2 * 8 + 0.6 * 2 + 0.6 * 2, 0, 0, 8 * 0.2]
    words = [5, 5, 8, 2, 0, 3]  # by bytes: a sign outside ASCII is one too
    x, _ = g.read(pa.array(texts))
    assert np.allclose(x[:5, 3], [10 * w / (30 + n) for w, n in zip(want, words, strict=True)][:5])
    assert np.allclose(x[:, :3], toxicity.Grammar({"grob": 3.5}).features(pa.array(texts))[0])  # hints leave the rest as it is


def test_learned_stems_are_not_capped(spark):
    rows = [(i, " ".join(f"{chr(97 + n % 26)}{chr(97 + n // 26)}qx word" for n in range(60 if i % 2 else 0)) + " plain", i % 2) for i in range(60)]
    stems = toxicity.learn_stems(spark.createDataFrame(rows, "doc_id long, text string, label int"))[0]
    assert len(stems) == 61  # sixty words, and the one that stands between them
    assert all(len(s) == 4 for s in stems)


def test_stems_of_the_other_folds(spark):
    """A fold's stems are what is learned from the documents outside it."""
    rows = [(i, f"plain {'nasty' if i % 4 == 1 else 'nice'}{chr(97 + i % 3)} {'vile' if i % 4 == 1 and i % 5 == 2 else ''}", int(i % 4 == 1)) for i in range(400)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, label int")
    whole, *folds = toxicity.learn_stems(sample, fold=(F.col("doc_id") % toxicity.FOLDS).cast("int"))
    assert whole == toxicity.learn_stems(sample)[0]
    for f, got in enumerate(folds):
        assert got == toxicity.learn_stems(sample.where(F.col("doc_id") % toxicity.FOLDS != f))[0]
    assert "vile" in whole and "vile" not in folds[2]


def test_work_tables_are_released(spark, docs):
    """What is left after an operator is what its lazy result reads."""
    from corploom.operators import shared

    for run, most in ((lambda: ngram_join.jaccard_components(docs), 3), (lambda: covertree.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1)], "vec_id long, embedding array<double>, label int")), 2), (lambda: mixing.choose(docs.withColumn("domain", F.lit("d")), ["domain", "lang", "source"], {}, 0.5), 2)):
        before = {p for _, p in shared._made}  # noqa: SLF001
        out = run()
        left = [p for _, p in shared._made if p not in before]  # noqa: SLF001
        assert len(left) <= most
        assert out.count() > 0


def test_rows_without_ids_are_drawn_by_their_texts(spark):
    rows = [(None if i % 2 else i, f"text number {i} of many", "a") for i in range(40)] + [(None, "twice the same text", "a")] * 2
    got = mixing.choose(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["source"], {}, 0.5, 1, 3).collect()
    for own in ([r["copies"] for r in got if r["doc_id"] is None], [r["copies"] for r in got if r["doc_id"] is not None]):
        assert set(own) == {0, 1}
    assert len({r["copies"] for r in got if r["text"].startswith("twice")}) == 1
    assert sum(r["copies"] * len(r["text"].split()) for r in got) <= 0.5 * sum(len(t.split()) for _, t, _ in rows)


def test_small_buckets(spark, docs, monkeypatch):
    """More digits where buckets are large: the same choice, since draws alone decide."""
    table = docs.withColumn("domain", F.lit("d"))
    run = lambda: sorted(str((r["doc_id"], r["text"], r["copies"])) for r in mixing.choose(table, ["domain", "source"], {}, 0.6, 2, 4).collect())
    before = run()
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 1)
    monkeypatch.setattr(mixing, "BUCKET_DIGITS", 1)
    assert run() == before


@pytest.mark.parametrize("tile", [2, 2000])
def test_hot_shingles_meet_in_tiles(spark, monkeypatch, tile):
    """Many sets of one template and a few strangers among them, every shingle dealt by bands and tiles."""
    monkeypatch.setattr(ngram_join, "TILE", tile)
    rng = np.random.default_rng(4)
    base = [f"t{i}" for i in range(40)]
    texts = [" ".join(base[: 20 + int(rng.integers(0, 21))] + [f"own{i}x{j}" for j in range(int(rng.integers(0, 12)))]) for i in range(60)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(table, 1, 80, heavy=5, many=3).collect()}
    sets, up = [set(t.split()) for t in texts], list(range(60))
    for i, j in itertools.combinations(range(60), 2):
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = up[i], up[j]
            up = [min(a, b) if c in (a, b) else c for c in up]
    assert got == {i: (len(sets[i]), up[i]) for i in range(60)}
    assert len({c for _, c in got.values()}) > 3


def test_runs_of_dropped_lines(spark):
    """Bitmaps of any pattern, spelt out again, and of very many single lines."""
    rng = np.random.default_rng(9)
    kept = [sorted(rng.choice(40, size=k, replace=False).tolist()) for k in (1, 2, 20, 39, 40)] + [[0], [5, 6, 7], list(range(0, 60_000, 2))]
    df = spark.createDataFrame(list(enumerate(kept)), "doc_id long, dropped array<int>")
    for r in linededup._with_runs(df).select("dropped", "bitmap", linededup._flags(F.col("bitmap")).alias("flags")).collect():  # noqa: SLF001
        assert [i for i, dropped in enumerate(r["flags"]) if dropped] == r["dropped"]
        assert all(n > 0 for n in r["bitmap"][1:])


# BPE


def test_bpe(docs):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.vocabulary_path()
    library = tokenizers.Tokenizer.from_file(path)
    clash = docs.withColumn("ids", F.lit("x")).withColumn("decoded", F.lit(1))
    rows = bpe.decode(bpe.encode(clash, path), path).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        want = library.encode(r["text"] or "", add_special_tokens=False)
        assert r["ids"] == want.ids
        assert r["decoded"] == library.decode(want.ids, skip_special_tokens=False) == (r["text"] or "")
    assert bpe.decode(bpe.encode(docs.limit(0), path), path).count() == 0
    assert sorted(bpe.encode_decode(clash, path).collect(), key=str) == sorted(rows, key=str)
    assert bpe.decode_ids(bpe.Vocabulary(path), np.array([94]), np.array([1])) == [library.decode([94])]


def test_bpe_cache_is_bounded():
    v = bpe.Vocabulary(queries.vocabulary_path())
    small, large = bpe.Encoder(v, cache_words=3), bpe.Encoder(v)
    for text in ("a b c d e f g", "hello world", "a b hello", ""):
        assert [x.tolist() for x in small.encode([text])] == [x.tolist() for x in large.encode([text])]


@pytest.mark.parametrize("few", [0, bpe.FEW, 10**9])
def test_bpe_on_long_words(monkeypatch, few):
    """Side by side, one after another, and both in turn give the library's ids, however long a pre-token is."""
    tokenizers = pytest.importorskip("tokenizers")
    monkeypatch.setattr(bpe, "FEW", few)
    path = queries.vocabulary_path()
    library, rng = tokenizers.Tokenizer.from_file(path), np.random.default_rng(6)
    letters = np.array(list("etaoinshrdlué"))
    texts = ["".join(rng.choice(letters, n)) for n in (1, 2, 3, 700, 3000)] + ["a" * 1500 + "é" * 800, "=" * 2047, "", "漢字" * 300]
    texts += [" ".join("".join(rng.choice(letters, n)) for n in rng.integers(1, 12, 60))]
    ids, count = bpe.Encoder(bpe.Vocabulary(path)).encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


# near duplicates


def shingle_set(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute_components(rows, k, percent):
    sets = {i: shingle_set(t, k) for i, t in rows}
    up = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(sets, 2):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and up[a] != up[b]:
                low = min(up[a], up[b])
                for i in [i for i in up if up[i] in (up[a], up[b])]:
                    up[i] = low
                changed = True
    return {i: (len(sets[i]), up[i]) for i in sets}


def test_pairs_are_verified_whole():
    """Texts that repeat within a batch, nulls and empty texts, against sets."""
    rng = np.random.default_rng(9)
    texts = [" ".join(f"v{x}" for x in rng.integers(0, 6, n)) for n in rng.integers(0, 30, 40)] + [None, "", "a b", "a b c", "A b C"]
    one, other = (rng.integers(0, len(texts), 900) for _ in range(2))
    for k, percent in ((1, 50), (3, 10), (3, 90)):
        sets = [shingle_set(t, k) for t in texts]
        want = [bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) for a, b in zip(one, other, strict=True)]
        got = ngram_join.linked(pa.array([texts[a] for a in one], pa.string()), pa.array([texts[b] for b in other], pa.string()), k, percent)
        assert got.tolist() == want
        assert any(want)
    none = pa.array([], pa.string())
    assert not len(ngram_join.linked(none, none, 3, 90))


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (3, 100)])
def test_jaccard(docs, k, percent):
    want = brute_components([(i, t) for i, t in TEXTS if i is not None], k, percent)
    got = found(ngram_join.jaccard_components(docs, k, percent))
    assert {i: {(r["n_shingles"], r["component_id"]) for r in rs} for i, rs in got.items() if i is not None} == {i: {x} for i, x in want.items()}
    assert len(got[18]) == 2
    assert got[None][0]["component_id"] == 1
    assert ngram_join.jaccard_components(docs.limit(0), k, percent).count() == 0


def test_jaccard_on_edited_copies(spark):
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for _ in range(6):
        base = [f"v{x}" for x in rng.integers(0, 60, 60)]
        for _ in range(12):
            text = list(base)
            for at in rng.integers(0, 60, rng.integers(0, 4)):
                text[at] = f"e{rng.integers(0, 9)}"
            rows.append((n, " ".join(text)))
            n += 1
    got = found(ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90))
    assert {i: (r[0]["n_shingles"], r[0]["component_id"]) for i, r in got.items()} == brute_components(rows, 3, 90)


def test_jaccard_with_passages_that_the_sketch_takes_for_rare(spark, monkeypatch):
    """A passage that most documents share, and a sketch that knows nothing: the order changes, the result doesn't."""
    rng, passage, rows = np.random.default_rng(17), [f"p{i}" for i in range(25)], []
    for n in range(60):
        own = [f"o{n % 20}w{x}" for x in range(40 + 10 * (n % 3))]
        if n >= 20:
            own[int(rng.integers(0, 40))] = f"e{n}"
        rows.append((n, " ".join(passage + own if n % 5 else own)))
    rows += [(60, " ".join(passage)), (61, " ".join([*passage, "end"]))]
    df, want = spark.createDataFrame(rows, "doc_id long, text string"), brute_components(rows, 3, 90)
    cut = []
    real = ngram_join.signatures
    monkeypatch.setattr(ngram_join, "signatures", lambda *a: cut.append(len(a)) or real(*a))
    monkeypatch.setattr(ngram_join, "frequency_sketch", lambda docs, k: np.ones(1 << 4, np.int64))
    for heavy, many, rounds in ((5, 1000, True), (10_000, 2, False)):
        cut.clear()
        got = found(ngram_join.jaccard_components(df, 3, 90, heavy=heavy, many=many))
        assert {i: (r[0]["n_shingles"], r[0]["component_id"]) for i, r in got.items()} == want
        assert (len(cut) > 1) == rounds
    assert len({c for _, c in want.values()}) < len(rows)


@pytest.mark.parametrize("percent", [50, 80, 90, 99])
def test_bands_of_sizes(spark, percent):
    rows = spark.range(1, 3000).select(F.col("id").alias("n")).withColumn("band", ngram_join._bands(F.col("n"), percent)).collect()  # noqa: SLF001
    band = {r["n"]: r["band"] for r in rows}
    assert all(band[min(2999, 100 * n // percent)] - band[n] in (0, 1) for n in band)


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(40)] + [(100 + int(a), 100 + int(b)) for a, b in rng.integers(0, 50, (40, 2))]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e}
    for _ in range(len(up)):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert got == {i: c for i, c in up.items() if any(i in e and e[0] != e[1] for e in edges)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_below_half(spark):
    word = lambda n: " ".join(f"w{i}" for i in range(n))
    rows = [(1, word(302)), (2, word(902)), (3, " ".join(f"x{i}" for i in range(302)))]  # summaries of 16 and 64 classes
    got = found(ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 30))
    assert {i: (r[0]["n_shingles"], r[0]["component_id"]) for i, r in got.items()} == brute_components(rows, 3, 30)
    assert got[2][0]["component_id"] == 1


def test_components_beyond_any_number_of_rounds(spark, monkeypatch):
    monkeypatch.setattr(components, "range", lambda n: range(min(n, 1)), raising=False)  # a bound of one round, if there is one
    monkeypatch.setattr(components, "local_forests", lambda edges: edges)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r["component"] for r in connected_components(edges).collect()} == {0}


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8))
    rows = [(i, base[i % 40] + (0.12 * rng.normal(size=8) if i >= 40 else 0), int(i % 2)) for i in range(160)]
    rows = [(i, [float(np.float32(c)) for c in v], lab) for i, v, lab in rows]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (202, None, 0), (203, [], 0), (204, [0.0] * 8, 0), (205, [float("nan")] * 8, 0), (206, [None, *[1.0] * 7], 0), (207, rows[0][1], None), (208, [1.0, 2.0], 0), (209, [2.0, 4.0], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("kept", F.lit("x"))
    got = found(covertree.near_duplicates(df, 0.93, block_rows=16), "vec_id")
    ok = {i: (np.array(v) / np.linalg.norm(v), lab) for i, v, lab in rows if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links = {i: {j for j in ok if j != i and ok[i][1] == ok[j][1] and len(ok[i][0]) == len(ok[j][0]) and ok[i][0] @ ok[j][0] >= 0.93} for i in [r[0] for r in rows if r[0] is not None] if i in ok}
    for i in [r[0] for r in rows if r[0] is not None]:
        seen, todo = {i}, [i]
        while todo:
            new = links.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        (r,) = got[i]
        assert (r["n_links"], r["component_id"], r["kept"]) == (len(links.get(i, ())), min(seen), min(seen) == i), i
    assert got[None][0]["n_links"] == 0
    assert covertree.near_duplicates(df.limit(0)).count() == 0


def brute_links(rows, cosine=0.93):
    """{vec_id: (n_links, component_id)} of (vec_id, vector, label), ids unique and vectors sound."""
    x, labels, ids = np.array([v for _, v, _ in rows], float), np.array([lab for *_, lab in rows]), np.array([i for i, *_ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = (x @ x.T >= cosine) & (labels[:, None] == labels)
    np.fill_diagonal(linked, False)
    root = ids.copy()
    while True:
        new = np.array([min(root[i], root[linked[i]].min(initial=root[i])) for i in range(len(ids))])
        if (new == root).all():
            return {int(i): (int(n), int(r)) for i, n, r in zip(ids, linked.sum(axis=1), root, strict=True)}
        root = new


def test_embeddings_in_blocks(spark):
    """A group of near copies beyond any block, a group that codes can't decide, and noise: every kind of pair occurs and all agree with brute force."""
    rng = np.random.default_rng(11)
    noise, hot, edge = rng.normal(size=(300, 12)), rng.normal(size=12), np.eye(12)[0]
    side = np.linalg.qr(np.column_stack([edge, rng.normal(size=(12, 11))]))[0][:, 1:].T
    angle = np.arccos(0.93)
    tilted = [np.cos(angle + e) * edge + np.sin(angle + e) * side[n % 11] for n, e in enumerate(rng.choice([-1e-6, 1e-6, -1e-3, 1e-3], 60))]
    vectors = [*noise, *(hot + 1e-3 * rng.normal(size=(150, 12))), edge, *tilted]
    rows = [(i, [float(c) for c in v], int(i >= 100)) for i, v in enumerate(vectors)]
    df, report = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), {}
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in covertree.near_duplicates(df, 0.93, block_rows=16, report=report).collect()}
    assert got == brute_links(rows)
    verdicts = collections.Counter()
    for level in report["region_pairs"]:
        verdicts.update(level)
    assert verdicts["whole"] > 0
    assert verdicts["far"] > 0
    assert report["block_pairs_compared"] > 0
    assert 0 < report["vectors_fetched"] < 5 * len(tilted)


def test_embeddings_send_codes_not_vectors(spark):
    """On vectors without any structure no vector is fetched, however many there are, and codes go to so many blocks as hold a label."""
    rng = np.random.default_rng(12)
    for n in (500, 2500):
        df = spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(rng.normal(size=(n, 32)))], "vec_id long, embedding array<double>, label int")
        report = {}
        assert covertree.near_duplicates(df, 0.93, report=report).where("n_links > 0").count() == 0
        assert report["vectors_fetched"] == 0
        assert report["codes_sent"] == n * report["blocks"]
        assert report["node_pairs_pruned"] > 0.9 * report["node_pairs"] > 0


def test_repeated_vector_ids(spark):
    one, near, far = [1.0, 0.0], [1.0, 0.1], [0.0, 1.0]
    rows = [(1, one, 0), (1, one, 0), (2, near, 0), (3, one, 0), (4, far, 0), (4, far, 1), (4, None, 0), (5, far, 2), (5, [0.0, 0.0], 2)]
    got = found(covertree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")), "vec_id")
    assert {i: {(r["n_links"], r["component_id"], r["kept"]) for r in rs} for i, rs in got.items()} == {1: {(2, 1, True)}, 2: {(2, 1, False)}, 3: {(2, 1, False)}, 4: {(0, 4, True)}, 5: {(0, 5, True)}}
    assert [len(got[i]) for i in range(1, 6)] == [2, 1, 1, 3, 2]


def test_codes_against_all_pairs():
    rng = np.random.default_rng(13)
    x = np.concatenate([rng.normal(size=(200, 6)), np.tile(rng.normal(size=(3, 6)), (50, 1)) + 0.3 * rng.normal(size=(150, 6))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w = rng.integers(1, 4, len(x))
    code, err = covertree.encode(x)
    points = (code / np.float32(covertree.CODE)).astype(np.float32)
    tree = lambda at: covertree.CoverTree.build(points[at], err[at])
    for cosine in (0.5, 0.93, 0.999):
        linked = x @ x.T >= cosine
        np.fill_diagonal(linked, False)
        whole = tree(slice(None))
        r = covertree.coded_links(whole, whole, w, w, cosine)
        assert (r.count_x == (linked & ~(r.open_x[:, None] & r.open_x)) @ w).all()
        r = covertree.coded_links(tree(slice(0, 150)), tree(slice(150, None)), w[:150], w[150:], cosine)
        across = linked[:150, 150:] & ~(r.open_x[:, None] & r.open_y)
        assert (r.count_x == across @ w[150:]).all()
        assert (r.count_y == w[:150] @ across).all()


def test_dual_traversal_against_all_pairs():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(300, 6)), np.tile(rng.normal(size=(3, 6)), (60, 1)) + 0.02 * rng.normal(size=(180, 6))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w = rng.integers(1, 4, len(x))
    for cosine in (0.5, 0.93, 0.999):
        linked = x @ x.T >= cosine
        np.fill_diagonal(linked, False)
        count, _, root = covertree.dual_links(x, x, w, w, cosine, True)
        assert (count == linked @ w).all()
        assert all(root[i] == root[j] for i, j in zip(*np.nonzero(linked), strict=True))
        a, b, _ = covertree.dual_links(x[:200], x[200:], w[:200], w[200:], cosine, False)
        across = x[:200] @ x[200:].T >= cosine
        assert (a == across @ w[200:]).all()
        assert (b == w[:200] @ across).all()


# lines


def test_lines(docs):
    rows = [(i, t) for i, t in TEXTS if i is not None]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(i)
    drop = lambda i, x: len(holders.get(key(x), ())) >= 3 and max(holders[key(x)]) != i
    got = found(linededup.dedup_lines(docs.withColumn("n_lines", F.lit("x"))))
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not drop(i, x)]
        for r in got[i]:
            assert (r["n_lines"], r["n_dropped"], r["kept_text"]) == (len(lines), len(lines) - len(kept), "\n".join(kept)), i
            assert r["copies"] == 7
    assert got[None][0]["kept_text"] == BASE
    assert linededup.dedup_lines(docs.limit(0)).count() == 0
    runs = linededup.keep_bitmaps(docs).where("doc_id = 12").first()
    assert (runs["n_dropped"], runs["bitmap"]) == (2, [0, 2])


# mixing


def test_mixing(spark, docs):
    weights = {"domain": {"a": 3, "b": 1}, "lang": {"en": 2}}
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(["t"] * int(rng.integers(0, 40))), ["a", "b"][int(rng.integers(0, 2))], ["en", "de"][int(rng.integers(0, 2))], f"s{int(rng.integers(0, 4))}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, domain string, lang string, source string")
    levels = ["domain", "lang", "source"]
    out = mixing.choose(df, levels, weights, 0.6, 1, 5).collect()
    tokens = {r[0]: len(r[1].split()) for r in rows}
    total, taken = sum(tokens.values()), sum(tokens[r["doc_id"]] * r["copies"] for r in out)
    assert len(out) == 600
    assert 0.6 * total - 16 * 40 <= taken <= 0.6 * total
    assert {r["copies"] for r in out} == {0, 1}

    def share(budget, kids):
        """{name: budget} of kids {name: (weight, capacity)}, by filling what is short first."""
        done = {}
        while kids:
            level = budget / sum(w for w, _ in kids.values())
            short = {k: c for k, (w, c) in kids.items() if c < level * w}
            if not short:
                return done | {k: min(c, int(level * w)) for k, (w, c) in kids.items()}
            done |= short
            budget -= sum(short.values())
            kids = {k: v for k, v in kids.items() if k not in short}
        return done

    cap = lambda *path: sum(tokens[r[0]] for r in rows if r[2 : 2 + len(path)] == path)
    plan, _ = mixing.plan(df, levels, weights, 0.6, 1, 5)
    got = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in plan.collect()}
    for d, db in share(int(total * 0.6), {d: ({"a": 3, "b": 1}[d], cap(d)) for d in "ab"}).items():
        for lang, lb in share(db, {x: ({"en": 2}.get(x, 1), cap(d, x)) for x in ("en", "de")}).items():
            for s, sb in share(lb, {f"s{n}": (1, cap(d, lang, f"s{n}")) for n in range(4) if cap(d, lang, f"s{n}")}).items():
                assert got[d, lang, s] == sb
    twice = mixing.choose(df, levels, weights, 1.5, 2, 5).collect()
    assert max(r["copies"] for r in twice) == 2
    assert 1.5 * total - 16 * 40 <= sum(tokens[r["doc_id"]] * r["copies"] for r in twice) <= 1.5 * total
    all_ = mixing.choose(docs, ["source", "lang"], {}, 1.0, 1, 0).collect()
    assert len(all_) == len(TEXTS)
    assert mixing.choose(docs.limit(0), ["source", "lang"], {}, 1.0).count() == 0


# tool calls


def test_tool_calls(spark):
    c = lambda i, name="f", args='{"x": 1}', needs="": f'{{"id": "{i}", "name": "{name}", "arguments": {args}, "depends_on": [{needs}]}}'
    m = [
        (1, 0, "user", "hello {"), (1, 1, "assistant", f'{{"tool_calls": [{c("b", needs=chr(34) + "a" + chr(34))}, {c("a", args="{" + chr(34) + "y" + chr(34) + ": {" + chr(34) + "q" + chr(34) + ": 2, " + chr(34) + "b" + chr(34) + ": null}, " + chr(34) + "x" + chr(34) + ": 1}")}]}}'),
        (1, 2, "tool", '{"tool_call_id": "a", "content": "A é \\"q\\""}'), (1, 3, "tool", '{"tool_call_id": "a", "content": "later"}'), (1, 4, "tool", '{"tool_call_id": "zz", "content": "?"}'),
        (1, 5, "assistant", f'{{"tool_calls": [{c("a")}, {c("c", needs=chr(34) + "d" + chr(34))}, {c("d", needs=chr(34) + "c" + chr(34))}, {c("e", "g")}, {c("f", args=chr(34) + "text" + chr(34))}, {c("h", args="{" + chr(34) + "x" + chr(34) + ": 1.5, " + chr(34) + "w" + chr(34) + ": 0}", needs=chr(34) + "b" + chr(34) + ", " + chr(34) + "nope" + chr(34))}]}}'),
        (2, 0, "assistant", None), (2, 1, "assistant", "not json"), (None, 0, "assistant", f'{{"tool_calls": [{c("a")}]}}'), (3, 0, "tool", "[]"),
    ]
    df = spark.createDataFrame(m, "conv_id long, turn long, role string, text string")
    calls, results = toolcalls.from_messages(df)
    schemas = {"f": {"x": ("integer", True), "y": ("object", False)}}
    rows = toolcalls.link(calls, results, schemas).collect()
    by = {(r["conv_id"], r["call_id"], r["turn"]): r for r in rows}
    assert len(rows) == 10
    a = by[1, "a", 1]
    assert (a["status"], a["rank"]) == ("linked", 0)
    assert a["line"] == '{"arguments":{"x":1,"y":{"b":null,"q":2}},"id":"a","name":"f","result":"A é \\"q\\""}'
    assert (by[1, "b", 1]["status"], by[1, "b", 1]["rank"]) == ("unanswered", 1)
    assert by[1, "a", 5]["status"] == "duplicate"
    assert {by[1, x, 5]["status"] for x in "cd"} == {"cycle"}
    assert (by[1, "e", 5]["status"], by[1, "e", 5]["errors"]) == ("invalid", ["unknown tool"])
    assert by[1, "f", 5]["errors"] == ["arguments: not an object"]
    assert (by[1, "h", 5]["rank"], by[1, "h", 5]["errors"]) == (2, ["w: unknown", "x: not integer", "nope: no such call"])
    assert by[1, "zz", 4]["status"] == "orphan"
    assert by[None, "a", 0]["errors"] == ["id: missing"]
    assert toolcalls.link(calls.limit(0), results.limit(0), schemas).count() == 0


def test_deep_chain(spark):
    edges = spark.createDataFrame([(1, f"n{i}", f"n{i - 1}") for i in range(1, 7)] + [(1, "n6", "n2")], "conv_id long, call_id string, needs string")
    assert {r["call_id"]: r["rank"] for r in toolcalls.topological_ranks(edges).collect()} == {f"n{i}": i for i in range(1, 7)}


def test_chain_deeper_than_any_number_of_rounds(spark, monkeypatch):
    monkeypatch.setattr(toolcalls, "range", lambda n: range(min(n, 2)), raising=False)  # a bound of two rounds, if there is one
    monkeypatch.setattr(toolcalls, "RANK_TABLES", 3, raising=False)
    edges = spark.createDataFrame([(1, f"n{i}", f"n{i - 1}") for i in range(1, 9)] + [(1, "x", "y"), (1, "y", "x")], "conv_id long, call_id string, needs string")
    assert {r["call_id"]: r["rank"] for r in toolcalls.topological_ranks(edges).collect()} == {f"n{i}": i for i in range(1, 9)}


def test_ranks_of_long_chains_take_few_rounds(spark, monkeypatch):
    """Five thousand calls, each after the one before and after the first: rounds grow with the logarithm."""
    written = []
    monkeypatch.setattr(toolcalls, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    n = 5000
    edges = spark.range(1, n).select(F.lit(1).alias("conv_id"), F.concat(F.lit("n"), "id").alias("call_id"), F.explode(F.array(F.concat(F.lit("n"), F.col("id") - 1), F.lit("n0"))).alias("needs"))
    ranks = {r["call_id"]: r["rank"] for r in toolcalls.topological_ranks(edges).collect()}
    assert ranks == {f"n{i}": i for i in range(1, n)}
    assert len(written) < 40


def test_ranks_against_longest_paths(spark):
    rng, edges = np.random.default_rng(14), set()
    for conv in range(12):  # acyclic but for one conversation, with shared needs and joins
        for i in range(1, 30):
            edges |= {(conv, f"n{i}", f"n{j}") for j in rng.integers(0, i, rng.integers(0, 4)).tolist()}
    edges |= {(3, "n2", "n29"), (3, "n29", "n2")}
    want = {}
    for conv in range(12):
        needs = collections.defaultdict(set)
        for c, a, b in edges:
            if c == conv:
                needs[a].add(b)
        rank = {x: 0 for x in {b for c, _, b in edges if c == conv} - needs.keys()}
        while fresh := [x for x in needs if x not in rank and needs[x] <= rank.keys()]:
            rank |= {x: 1 + max(rank[y] for y in needs[x]) for x in fresh}
        want |= {(conv, x): r for x, r in rank.items() if r}
    got = toolcalls.topological_ranks(spark.createDataFrame(sorted(edges), "conv_id long, call_id string, needs string")).collect()
    assert {(r["conv_id"], r["call_id"]): r["rank"] for r in got} == want
    assert toolcalls.topological_ranks(spark.createDataFrame([], "conv_id long, call_id string, needs string")).count() == 0


def test_turns_with_nulls_and_long_texts(spark, tmp_path):
    import duckdb

    rows = [(1, 0, "system", "s"), (1, 1, "user", None), (1, 2, "assistant", None), (1, 3, "user", "x" * 300_000), (1, 4, "assistant", "é \"q\" \\ \n"), (1, 5, "user", ""), (2, 3, "user", "no opening"), (2, 5, "user", "on"), (2, 9, "assistant", None), (None, 0, "user", "?"), (3, None, "user", "?"), (4, 0, None, "?"), (5, 0, "user", "a")]
    df = spark.createDataFrame([(*r, "z", 1, 2.0) for r in rows], "conv_id long, turn long, role string, text string, name string, rank int, line double")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')  WHERE conv_id IS NOT NULL AND turn IS NOT NULL")
    out = queries.op2_tool_calls(spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(out.columns)} FROM ({queries.ORACLE_SQL['op2_tool_calls']})").fetchall()
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    assert out.where("rank = 3").count() == 1


def test_text_kernel_is_independent_of_batches():
    import pyarrow as pa

    texts = [t or "" for _, t in TEXTS]
    counts, ratios = docstats.statistics(pa.array(texts))
    for i, t in enumerate(texts):
        one, ratio = docstats.statistics(pa.array([t]))
        assert (one[0] == counts[i]).all()
        assert np.allclose(ratio[0], ratios[i])


def test_digests(spark):
    r = queries.op10_line_dedup(spark, SF).first()
    assert len(r["kept_sha256"]) == len(hashlib.sha256(b"").hexdigest())
