"""Lexer, postfix form and evaluator: the edge cases of the query language."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corploom.operators import search
from corploom.plans.boolean import Leaf, compile_query, lex, postfix, read_leaf, required

A, B, C, ALL = {1, 2, 3}, {2, 3}, {3}, {1, 2, 3, 4}
POSTINGS = {"a": A, "b": B, "c": C}
GOLDEN = [
    ("( a && b ) || !c", "a b && c ! ||", ALL),
    ("A", "A", A), ("a b", "a b", B), ("a && b c", "a b c &&", C), ("a || b c", "a b c ||", B), ("a || b && c", "a b c && ||", A),
    ("!a", "a !", {4}), ("!!a", "a ! !", A), ("!", "!", ALL), ("a ! b", "a b !", {1, 4}), ("a && !c", "a c ! &&", {1, 2}),
    ("a &&", "a &&", set()), ("&& a", "a &&", set()), ("|| a", "a ||", A), ("! && a", "! a &&", A),
    ("(a", "a (", set()), ("(a && b", "a b && (", set()), ("a || (b", "a b ( ||", B), ("a && b) || c", "a b && c ||", B),
    ("()", "", set()), ("", "", set()), ("a&b", "a&b", set()), ("a&&&b", "a &b &&", set()), ("a & b", "a & b", B), ("zzz", "zzz", set()), ("!zzz", "zzz !", ALL),
]


def loader(word):
    return POSTINGS.get(word) or POSTINGS.get(word.lower()) or []


def evaluate(form, holds, documents):
    """What a query says of each document alone: truth values for sets."""

    def true_of(doc):
        said = []
        for x in form:
            if x == "!":
                said[-1:] = [not said[-1]] if said else [True]
            elif x == "&&":
                said[-2:] = [len(said) > 1 and said[-2] and said[-1]]
            elif x == "||":
                said[-2:] = [any(said[-2:])]
            else:
                said.append(doc in holds(x))
        return bool(said) and said[-1]

    return {d for d in documents if true_of(d)}


@pytest.fixture(scope="module")
def index(spark):
    postings = spark.createDataFrame([(t, d) for t, ds in POSTINGS.items() for d in ds], "term string, docnum long")
    forward = spark.createDataFrame([(d, f"id{d}", f"title {d}") for d in ALL], "docnum long, docid string, title string")
    return postings.cache(), forward.cache()


def test_lexer():
    assert lex("( a && b ) || !c") == ["(", "a", "&&", "b", ")", "||", "!", "c"]
    assert lex("рок-н-ролл||рок'n'roll") == ["рок-н-ролл", "||", "рок'n'roll"]


@pytest.mark.parametrize(("query", "form", "result"), GOLDEN)
def test_golden(query, form, result):
    assert " ".join(postfix(lex(query))) == form
    assert evaluate(postfix(lex(query)), loader, ALL) == result


def test_golden_by_spark(index):
    for query, _, result in GOLDEN:
        assert {r["docnum"] for r in search.matches(query, *index).collect()} == result, query


def test_set_operations(index):
    for query in ("( a && b ) || !c", "a || b && c", "!!a", "a b", "(a"):
        want = evaluate(postfix(lex(query)), loader, ALL)
        assert {r["docnum"] for r in search.by_set_operations(query, *index).collect()} == want


def test_space_as_and(index):
    assert postfix(lex("a b !c (d)"), "and") == postfix(lex("a && b && !c && (d)"))
    assert {r["docnum"] for r in search.matches("a c", *index, adjacency="and").collect()} == {3}
    with pytest.raises(ValueError, match="adjacency"):
        postfix(["a"], "or")


def test_batch_and_pages(index):
    got = search.search_many([(1, "a && !c"), (2, "zzz"), (3, "!a"), (4, "")], *index).collect()
    assert sorted((r["query_id"], r["nth"], r["docnum"]) for r in got) == [(1, 1, 1), (1, 2, 2), (3, 1, 4)]
    page = search.search_page("a", 9, *index)
    assert (page.total, page.pages, page.page, page.first, page.last, len(page.rows)) == (3, 1, 1, 1, 3, 3)
    empty = search.search_page("zzz", 1, *index)
    assert (empty.total, empty.pages, empty.first, empty.last) == (0, 1, 1, 0)


trees = st.recursive(st.sampled_from("abc"), lambda t: st.one_of(t.map(lambda x: f"!({x})"), st.tuples(t, st.sampled_from(["&&", "||"]), t).map(lambda x: f"({x[0]} {x[1]} {x[2]})")), max_leaves=8)


@settings(max_examples=60, deadline=None)
@given(trees, trees)
def test_de_morgan(x, y):
    run = lambda q: evaluate(postfix(lex(q)), loader, ALL)
    assert run(f"!({x} && {y})") == run(f"!({x}) || !({y})")
    assert run(f"!!({x})") == run(x)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "&&", "||", "!", "(", ")", "zz"]), max_size=9))
def test_any_sequence_compiles_to_the_same(spark, lexemes):
    query = " ".join(lexemes)
    flags = spark.createDataFrame([(d, d in A, d in B, d in C) for d in sorted(ALL)], "docnum long, a boolean, b boolean, c boolean")
    compiled = compile_query(query, flag=lambda w: F.col(w) if w in POSTINGS else F.lit(False))
    assert {r["docnum"] for r in flags.where(compiled.condition).collect()} == evaluate(postfix(lex(query)), lambda w: POSTINGS.get(w, []), ALL)


# the wider dialect


@pytest.mark.parametrize(("query", "form"), [
    ('"what where when"', ['"what where when"']),
    ('"what where when" / 5', ['"what where when" / 5']),
    ('"what where when" && who', ['"what where when"', "who", "&&"]),
    ("«what where»|| quiz", ["«what where»", "quiz", "||"]),
    ('"what where" && !"crystal owl"', ['"what where"', '"crystal owl"', "!", "&&"]),
    ('(“a b”/3||title:"c d")&&e', ["“a b”/3", 'title:"c d"', "||", "e", "&&"]),
    ('a"b c"d', ["a", '"b c"', "d"]), ('a "b c', ["a", "b", "c"]), ('""', ['""']),
])
def test_quotations(query, form):
    assert postfix(lex(query, quotes=True)) == form


def test_leaves():
    zones = ("text", "title")
    assert read_leaf('"a b" / 5', zones) == Leaf(("a", "b"), "text", 5)
    assert read_leaf('title:«a  b»', zones) == Leaf(("a", "b"), "title")
    assert read_leaf("title:x", zones) == Leaf(("x",), "title")
    assert read_leaf("body:x", zones) == Leaf(("body:x",))
    assert read_leaf("title:", zones) == Leaf(("title:",))
    assert read_leaf('body:"x y"', zones) == Leaf(())
    assert read_leaf('"a" / 3', zones) == Leaf(("a",))
    assert read_leaf('""', zones) == Leaf(())
    assert lex('"a b"') == ['"a', 'b"']  # the plain dialect knows no quotations


@pytest.mark.parametrize(("query", "leaves"), [("a && b", "ab"), ("a || b", ""), ("a && (b || c)", "a"), ("(a && b) || (a && c)", "a"), ("!a && b", "b"), ("!!a", ""), ("&& a", "a"), ("|| a", "a"), ("", ""), ("!", "")])
def test_required(query, leaves):
    assert required(postfix(lex(query))) == set(leaves)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "&&", "||", "!", "(", ")"]), max_size=9))
def test_no_match_lacks_a_required_leaf(lexemes):
    form = postfix(lexemes)
    for doc in evaluate(form, lambda w: POSTINGS.get(w, []), ALL):
        assert all(doc in POSTINGS.get(x, []) for x in required(form))
