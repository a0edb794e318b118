"""Normaliser, tokenizers, stemmer, cleaner and integer code on adversarial strings."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corploom.functions import text as X
from corploom.functions import varint

STRINGS = ["Straße ΟΔΟΣ ﬁn", "a--b -x y- d’art ’q 'z' foo_bar", "x­b c​d e—f 12½ x² Ⅻ", "İstanbul ŉ ß ẞ ſ", "", "режиссе́р ёлка", "ᏸ Ꭰ ᾳ ΐ µ", "é å", "a b c﻿d"]


def scan(s):
    """Tokens by a scanner over characters."""
    s = unicodedata.normalize("NFC", s).casefold()
    for c in X.SPACES:
        s = s.replace(c, " ")
    for c in X.VANISHING:
        s = s.replace(c, "")
    for c in X.DASHES:
        s = s.replace(c, "-")
    word = lambda c: unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd"
    out, now = [], ""
    for i, c in enumerate(s):
        joins = c in "-'’" and now and i + 1 < len(s) and word(s[i + 1]) and word(s[i - 1])
        if word(c) or joins:
            now += c
        else:
            out += [now] if now else []
            now = ""
    return out + ([now] if now else [])


def one(spark, values, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(column.alias("out")).collect()]


def test_tokens(spark):
    assert one(spark, [*STRINGS, None], X.tokens(F.col("s"))) == [*map(scan, STRINGS), []]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn"]), max_size=12), min_size=1, max_size=6))
def test_folding(spark, values):
    assert one(spark, values, X.casefold(F.col("s"))) == [v.casefold() for v in values]


def test_whitespace_tokens(spark):
    values = ["a\tb  C\x1cd e f", " ", None]
    assert one(spark, values, X.tokens(F.col("s"), "whitespace")) == [values[0].split(), [], []]
    with pytest.raises(ValueError, match="tokenizer"):
        X.tokens(F.col("s"), "other")


def test_stem(spark):
    words = {"машины": "машин", "машиной": "машин", "машинам": "машинам", "играют": "игра", "кино": "кин", "ами": "ами", "играющий": "играющ", "играл": "играл"}
    assert one(spark, list(words), X.stem(F.col("s"))) == list(words.values())


def test_clean(spark):
    cases = {"сло-\nво x -\r\n y": "слово xy", "a\tb c\x85d e f": "ab cd e f", "кино это кино": "киноэто кино", "abcd efg abcd efgh abc def": "abcdefg abcd efghabc def", None: "", " a   b ": "a b"}
    assert one(spark, list(cases), X.clean(F.col("s"))) == list(cases.values())
    assert one(spark, ["кино это"], X.clean(F.col("s"), glue=False)) == ["кино это"]


def test_alnum_and_slug(spark):
    assert one(spark, ["--", "a-", "½", "_"], X.has_alnum(F.col("s"))) == [False, True, True, False]
    assert one(spark, ["a/b"], X.slug(F.col("s"))) == ["a_b"]


def test_varint(spark):
    numbers = [0, 1, 127, 128, 300, 16384, 2**40]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(numbers)], "i int, n long").orderBy("i")
    got = df.select(F.hex(varint.encode(F.col("n"))).alias("h"), varint.size(F.col("n")).alias("size")).collect()
    assert [r["h"] for r in got][:6] == ["00", "01", "7F", "8001", "AC02", "808001"]
    assert [len(r["h"]) // 2 for r in got] == [r["size"] for r in got]
    assert varint.decode_array(bytes.fromhex("".join(r["h"] for r in got))).tolist() == numbers
    with pytest.raises(EOFError):
        varint.decode_array(b"\x80")
    with pytest.raises(EOFError):
        varint.decode_postings(b"")


@settings(max_examples=5, deadline=None)
@given(st.sets(st.integers(1, 2**40), min_size=1, max_size=40))
def test_blocks(spark, docs):
    df = spark.createDataFrame([(sorted(docs),)], "d array<long>").repartition(1)
    assert df.select(varint.decode_block(varint.encode_block(F.col("d")))).first()[0] == sorted(docs)
