"""Boolean queries: text to leaves and operators, to postfix, to a Column over per-document flags.

A leaf is a word or, in the wider dialect, a quotation: ``"a b c"`` (these words in a
row, also in guillemets or curly quotes), ``"a b c" / 5`` (in this order, the last at most five
places behind the first), either with a zone before it, as ``title:word``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

BINDS = {"||": 1, "&&": 2, "!": 3}
_LEXEME = re.compile(r"&&|\|\||[()!]|(?:(?!&&|\|\|)[^\s()!])+")
_QUOTED = r"""(?:"[^"]*"|«[^»]*»|“[^”]*”)"""
_WIDE = re.compile(rf"""&&|\|\||[()!]|(?:\w+:)?{_QUOTED}(?:\s*/\s*\d+)?|(?:(?!&&|\|\|)[^\s()!"«»“”])+""")
_LEAF = re.compile(rf"""(?:(?P<zone>\w+):)?(?P<quoted>{_QUOTED})(?:\s*/\s*(?P<within>\d+))?""")


def lex(query: str, quotes: bool = False) -> list[str]:
    """Parentheses, operators and leaves; a single & or | belongs to a word.

    quotes reads quotations as leaves; a quotation mark without its partner is passed over.
    """
    return (_WIDE if quotes else _LEXEME).findall(query)


@dataclass(frozen=True)
class Leaf:
    """Words that a document must hold in a zone: one, or several in a row, or (within) in order with so many places from first to last."""

    words: tuple[str, ...]
    zone: str = "text"
    within: int | None = None


def read_leaf(lexeme: str, zones: Iterable[str] = ("text",)) -> Leaf:
    """The leaf that a lexeme of the wider dialect spells; what stands before a colon is a zone only if there is one of that name."""
    if m := _LEAF.fullmatch(lexeme):
        words, zone = tuple(m["quoted"][1:-1].split()), m["zone"]
        if zone is not None and zone not in zones:
            words, zone = (), None
        return Leaf(words, zone or "text", int(m["within"]) if m["within"] and len(words) > 1 else None)
    zone, colon, word = lexeme.partition(":")
    return Leaf((word,), zone) if colon and word and zone in zones else Leaf((lexeme,))


def required(form: Iterable[str]) -> frozenset[str]:
    """Leaves without which no document can match the postfix form."""
    stack: list[frozenset[str]] = []
    for x in form:
        if x == "!":
            stack.append(frozenset() if not stack else (stack.pop(), frozenset())[1])
        elif x in ("&&", "||"):
            b = stack.pop() if stack else None
            a = stack.pop() if stack else None
            both = [s for s in (a, b) if s is not None]
            stack.append(frozenset().union(*both) if x == "&&" or len(both) < 2 else both[0] & both[1])
        else:
            stack.append(frozenset({x}))
    return stack[-1] if stack else frozenset()


def _with_and(lexemes: list[str]) -> list[str]:
    """An AND between neighbours that stand for operands."""
    out: list[str] = []
    for x in lexemes:
        ends = bool(out) and out[-1] not in (*BINDS, "(")
        if ends and x not in ("&&", "||", ")"):
            out.append("&&")
        out.append(x)
    return out


def postfix(lexemes: Iterable[str], adjacency: str = "last") -> list[str]:
    """Operators after their operands.

    ``!`` binds to the right, the others to the left.  A stray ``)`` closes all
    that is open; an unclosed ``(`` stays in the output, as a word that no document has.
    adjacency: ``last`` leaves neighbouring operands as they are, ``and`` joins them.
    """
    if adjacency not in ("last", "and"):
        raise ValueError(f"unknown adjacency {adjacency!r}")
    lexemes = list(lexemes)
    out: list[str] = []
    held: list[str] = []
    for x in _with_and(lexemes) if adjacency == "and" else lexemes:
        if x == ")":
            while held:
                top = held.pop()
                if top == "(":
                    break
                out.append(top)
        elif x in BINDS:
            floor = BINDS[x] + (x == "!")
            while held and BINDS.get(held[-1], 0) >= floor:
                out.append(held.pop())
            held.append(x)
        elif x == "(":
            held.append(x)
        else:
            out.append(x)
    return out + held[::-1]


@dataclass
class Compiled:
    """A query as a condition over flag columns; terms maps each word to its flag's name."""

    condition: Column
    terms: dict[str, str] = field(default_factory=dict)
    matches_nothing: bool = False


def compile_query(query: str, adjacency: str = "last", flag: Callable[[str], Column] | None = None, quotes: bool = False) -> Compiled:
    """Run the postfix form on a stack of Columns; what is missing is false, under NOT true; the result is the top."""
    names: dict[str, str] = {}

    def term(word: str) -> Column:
        if flag is not None:
            return flag(word)
        names.setdefault(word, f"t{len(names)}")
        return F.coalesce(F.col(names[word]), F.lit(False))

    stack: list[Column] = []
    for x in postfix(lex(query, quotes), adjacency):
        if x == "!":
            stack.append(~stack.pop() if stack else F.lit(True))
        elif x in ("&&", "||"):
            b = stack.pop() if stack else F.lit(False)
            a = stack.pop() if stack else F.lit(False)
            stack.append((a & b) if x == "&&" else (a | b))
        else:
            stack.append(term(x))
    return Compiled(stack[-1] if stack else F.lit(False), names, not stack)
