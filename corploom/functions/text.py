"""Text functions as Catalyst expressions; Python only where Spark has no built-in (NFC)."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dashes that become "-", spaces that become " ", characters that vanish.
DASHES = "‐‑‒–—―−"
SPACES = "  "
VANISHING = "﻿­​‌‍"
#: White space as Unicode-aware split() of strings sees it.
WHITE = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
WHITE_NOT_SPACE = WHITE.replace("-\\x20", "-\\x1f")
#: Characters that normal form C leaves as they are beside any others, and whose folding is their lower case (sharp s apart).
PLAIN = r"\x{0}-\x{B4}\x{B6}-\x{148}\x{14A}-\x{17E}\x{180}-\x{1EF}\x{1F1}-\x{2FF}\x{400}-\x{482}\x{2010}-\x{2027}\x{2030}-\x{20CF}\x{3041}-\x{3096}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}"
TOKEN = r"[\p{L}\p{Nd}]+(?:[-'’][\p{L}\p{Nd}]+)*"
ASCII_TOKEN = r"[a-z0-9]+(?:[-'][a-z0-9]+)*"  # the same in lower-case ASCII texts
WORD = r"[\p{L}\p{N}_]"
#: The suffixes of the stemmer, longest first.
SUFFIXES = (
    "ического ального евского енность овского ствами аться остью ание ение ется иями ость ться ами его ему ешь ими иям иях ого ому ост ыми ями ах ая ее ем ет ие ий им "
    "ия ое ой ом ти ть ые ый ым ью ют ям ях яя а е и о у ы ь ю я"
).split()


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def is_plain(text: Column) -> Column:
    """No character outside PLAIN.  Anchored and possessive: one pass, where a search for a character outside would start anew at each one."""
    return is_ascii(text) | text.rlike(rf"\A[{PLAIN}]*+\z")


def nfc(text: Column) -> Column:
    """Normal form C.  Only texts that may need it reach Python, as Arrow arrays; the others are nulls there."""

    @F.arrow_udf("string")
    def compose(a: pa.Array) -> pa.Array:
        return pa.array([None if x is None else unicodedata.normalize("NFC", x) for x in a.to_pylist()], pa.string())

    plain = is_plain(text)
    return F.when(plain, text).otherwise(compose(F.when(~plain, text)))


def casefold(text: Column, compose: bool = False) -> Column:
    """Full Unicode case folding, of composed text first where compose is set: lower case and sharp s for plain texts, Python for the others."""

    @F.arrow_udf("string")
    def fold(a: pa.Array) -> pa.Array:
        composed = (None if x is None else unicodedata.normalize("NFC", x) if compose else x for x in a.to_pylist())
        return pa.array([None if x is None else x.casefold() for x in composed], pa.string())

    plain = is_plain(text)
    return F.when(is_ascii(text), F.lower(text)).when(plain, F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))).otherwise(fold(F.when(~plain, text)))


def fold_signs(text: Column) -> Column:
    """Dashes to -, no-break spaces to a space, invisible characters away: one pass."""
    return F.translate(text, DASHES + SPACES + VANISHING, "-" * len(DASHES) + " " * len(SPACES))


def collapse_space(text: Column) -> Column:
    # what is one space already isn't matched
    return F.trim(F.regexp_replace(text, f" {WHITE}+|{WHITE_NOT_SPACE}{WHITE}*", " "))


def normalize(text: Column, compose: bool = True) -> Column:
    """What the tokenizer sees.  compose=False skips NFC for texts known to be composed."""
    return collapse_space(fold_signs(casefold(text, compose)))


def tokens(text: Column, mode: str | Callable[[Column], Column] = "unicode", compose: bool = True) -> Column:
    """Tokens in order with repeats (null: none).

    unicode: runs of letters and digits, joined inside by single hyphens and
    apostrophes, case folded.  whitespace: what white space separates, unchanged.
    A function in place of a name is a tokenizer of the caller's, over Columns.
    """
    text = F.coalesce(text, F.lit(""))
    if callable(mode):
        return F.coalesce(mode(text), F.array().cast("array<string>"))
    if mode == "whitespace":
        return F.filter(F.split(text, WHITE + "+"), lambda t: t != "")
    if mode != "unicode":
        raise ValueError(f"unknown tokenizer {mode!r}")
    # signs are folded before the pattern; collapsing white space can't change what it finds
    ascii_ = is_ascii(text)
    folded = F.when(ascii_, F.lower(text)).otherwise(fold_signs(casefold(text, compose)))
    return F.regexp_extract_all(folded, F.when(ascii_, F.lit(ASCII_TOKEN)).otherwise(F.lit(TOKEN)), 0)


def stem(word: Column) -> Column:
    """Lower case without the longest listed suffix that leaves three characters or more; one pass."""
    low = F.lower(word)
    size, out = F.char_length(low), F.when(is_ascii(low), low)  # no suffix is ASCII
    for n in sorted({len(s) for s in SUFFIXES}, reverse=True):
        fits = (size >= n + 3) & F.right(low, F.lit(n)).isin(*[s for s in SUFFIXES if len(s) == n])
        out = out.when(fits, F.left(low, size - n))
    return out.otherwise(low)


def lemmatizer(lemma: Callable[[], Callable[[str], str]]) -> Callable[[Column], Column]:
    """A stemmer for index.build from a Python lemmatizer, such as a morphological analyser: lemma() makes one on each worker.

    A word that it fails on stays as it is.  Dear, so the index asks it once for each distinct term.
    """

    def lemmatize(word: Column) -> Column:
        @F.arrow_udf("string")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            find = lemma()

            def safe(w: str | None) -> str | None:
                try:
                    return w if w is None else find(w)
                except Exception:  # noqa: BLE001  whatever a foreign analyser raises
                    return w

            for a in batches:
                yield pa.array([safe(w) for w in a.to_pylist()], pa.string())

        return run(word)

    return lemmatize


def has_alnum(word: Column) -> Column:
    return word.rlike(r"[\p{L}\p{N}]")


def clean(text: Column, glue: bool = True, compose: bool = True) -> Column:
    """Corpus cleaner (null: empty): signs folded, controls but line ends away, words joined over line ends, white space collapsed.

    glue also joins a word of exactly four characters to a following one of exactly three.
    """
    text = F.coalesce(text, F.lit(""))
    x = F.when(is_ascii(text), text).otherwise(fold_signs(nfc(text) if compose else text))
    x = F.when(x.rlike(r"\A[\n\r\x20-\x7E\x{A0}-\x{10FFFF}]*+\z"), x).otherwise(F.regexp_replace(x, r"[\p{Cc}&&[^\n\r]]", ""))
    side = "([A-Za-zА-Яа-яЁё0-9])"
    x = F.when(x.rlike(f"-{WHITE}*[\\r\\n]"), F.regexp_replace(x, f"{side}{WHITE}*-{WHITE}*[\\r\\n]+{WHITE}*{side}", "$1$2")).otherwise(x)
    x = collapse_space(x)
    return F.regexp_replace(x, f"(?<=(?<!{WORD}){WORD}{{4}}) +(?={WORD}{{3}}(?!{WORD}))", "") if glue else x


def slug(title: Column) -> Column:
    return F.replace(title, F.lit("/"), F.lit("_"))


def snippet(text: Column, size: int = 1000) -> Column:
    """The first size code points."""
    return F.substring(text, 1, size)
