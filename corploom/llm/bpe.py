"""Byte-level BPE encoding and decoding with a segment tree over pair ranks.

A text is cut at the vocabulary's special tokens, the rest into pre-tokens by the
byte-level pattern; merges never cross a pre-token, so each distinct pre-token is
merged once and looked up afterwards.

Merging keeps the symbols of a pre-token as a linked list and, over its positions,
a segment tree whose leaf i is ``rank of (symbol i, next symbol) * 2**32 + i``.  The
root is the least value: the lowest rank and, among equals, the leftmost pair.
Applying that merge changes three leaves - the pair's own, its left neighbour's, the
absorbed symbol's - and each change climbs log2(n) nodes.  The loop ends when the
root says that no pair has a rank.  Pre-tokens of one size class are merged side by
side, one tree a row, so a step of the loop is a handful of numpy calls; the last few
rows, and a long pre-token alone, go on one merge after another in the same arrays.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textkernel import chunks, trim
from .work import small_batches

#: Fixed value: the pre-token pattern of byte-level BPE vocabularies, with white space spelt out as Unicode has it
#: (engines differ on \x1c-\x1f).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^W\p{L}\p{N}]+|[W]+(?![^W])|[W]+".replace("W", "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000")
#: The same over ASCII texts, where the standard library's engine can do it in less time.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
CACHE_WORDS = 200_000  # distinct pre-tokens that a worker remembers at once
FEW = 12  # rows below which a merge in Python takes less time than a step of numpy calls
NO_PAIR = np.int64(1) << 62


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in such vocabularies: itself where visible, else 256 and up."""
    seen = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b) if b in seen else chr(spare))
        spare += b not in seen
    return out


class Vocabulary:
    """Ids, merges and special tokens of a vocabulary file in the JSON form of byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        ids, letters = j["model"]["vocab"], byte_alphabet()
        back = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.pieces: list[bytes] = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in ids.items():
            self.pieces[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        self.byte_ids = np.array([ids[c] for c in letters], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in j["model"]["merges"]]
        left, right = np.array([ids[a] for a, _ in pairs]), np.array([ids[b] for _, b in pairs])
        keys = left.astype(np.int64) << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        self.rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.piece_size = np.array([len(p) for p in self.pieces], dtype=np.int64)
        self.piece_at = np.concatenate([[0], np.cumsum(self.piece_size)])
        self.piece_data = np.frombuffer(b"".join(self.pieces), dtype=np.uint8)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NO_PAIR where the pair doesn't merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_PAIR)


def merge_words(vocab: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, ids, count): words[order[n]] has count[n] ids, in one row one word after another."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    order = np.argsort(size, kind="stable")
    at, ids, count = int(np.searchsorted(size[order], 1)), [np.zeros(0, np.int64)], []
    count.append(np.zeros(at, dtype=np.int64))
    while at < len(order):
        width = 1 << max(1, int(size[order[at]] - 1).bit_length())
        to = min(int(np.searchsorted(size[order], width, "right")), at + max(1, (1 << 18) // width))
        flat, own = _merge_block(vocab, [words[i] for i in order[at:to]], width)
        ids.append(flat)
        count.append(own)
        at = to
    return order, np.concatenate(ids), np.concatenate(count)


def _merge_block(vocab: Vocabulary, words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge words of at most width bytes."""
    rows, size = len(words), np.array([len(w) for w in words])
    spot = np.arange(width)
    live = spot < size[:, None]  # a symbol stands here
    symbol = np.zeros((rows, width), dtype=np.int64)
    symbol[live] = vocab.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
    following = np.broadcast_to(spot + 1, (rows, width)).copy()
    before = np.broadcast_to(spot - 1, (rows, width)).copy()
    tree = np.full((rows, 2 * width), NO_PAIR, dtype=np.int64)
    paired = live[:, 1:]
    leaf = np.full((rows, width), NO_PAIR, dtype=np.int64)
    leaf[:, :-1][paired] = vocab.pair_ranks(symbol[:, :-1][paired], symbol[:, 1:][paired])
    tree[:, width:] = np.where(leaf < NO_PAIR, leaf << 32 | spot, NO_PAIR)
    level = width
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2

    def put(r: np.ndarray, i: np.ndarray, value: np.ndarray) -> None:
        """Point updates: set leaves and recompute the nodes above them."""
        at = r * (2 * width) + i + width
        nodes[at] = value
        base, node = r * (2 * width), i + width
        for _ in range(depth):  # all leaves lie equally deep
            node >>= 1
            at = base + 2 * node
            nodes[base + node] = np.minimum(nodes[at], nodes[at + 1])

    def value(r: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The leaf of the pair that starts at i."""
        j = following[r, i]
        has = j < size[r]
        rank = vocab.pair_ranks(symbol[r, i], symbol[r, np.where(has, j, i)])
        return np.where(has & (rank < NO_PAIR), rank << 32 | i, NO_PAIR)

    nodes, depth = tree.reshape(-1), width.bit_length() - 1
    r = np.flatnonzero(tree[:, 1] < NO_PAIR)
    while len(r) >= max(1, FEW):
        root = tree[r, 1]
        i, rank = root & 0xFFFFFFFF, root >> 32
        j = following[r, i]
        symbol[r, i] = vocab.merged[rank]
        live[r, j] = False
        k = following[r, j]
        following[r, i] = k
        tied = k < size[r]
        before[r[tied], k[tied]] = i[tied]
        p = before[r, i]
        has = p >= 0
        near_r, near_i = np.concatenate([r, r[has]]), np.concatenate([i, p[has]])
        put(np.concatenate([near_r, r]), np.concatenate([near_i, j]), np.concatenate([value(near_r, near_i), np.full(len(r), NO_PAIR)]))
        r = r[tree[r, 1] < NO_PAIR]
    for row in r.tolist():
        _merge_row(vocab, *(memoryview(x[row]) for x in (symbol, following, before, tree, live)), int(size[row]))
    return symbol[live], live.sum(axis=1)


def _merge_row(vocab: Vocabulary, symbol: memoryview, following: memoryview, before: memoryview, tree: memoryview, live: memoryview, size: int) -> None:
    """The remaining merges of one row, in place."""
    ranks, merged, width, none = vocab.rank_of, vocab.merged, len(symbol), int(NO_PAIR)

    def put(i: int, value: int) -> None:
        """Point update: set a leaf and recompute the nodes above it, up to the first that doesn't change."""
        node = i + width
        tree[node] = value
        while node > 1:
            other = tree[node ^ 1]
            value = value if value < other else other
            node >>= 1
            if tree[node] == value:
                return
            tree[node] = value

    def value(i: int, j: int) -> int:
        """The leaf of the pair that starts at i and goes on at j."""
        rank = ranks.get(symbol[i] << 32 | symbol[j]) if j < size else None
        return none if rank is None else rank << 32 | i

    while (root := tree[1]) < none:
        i = root & 0xFFFFFFFF
        j = following[i]
        k = following[j]
        symbol[i], following[i], live[j] = merged[root >> 32], k, False
        if k < size:
            before[k] = i
        put(j, none)
        put(i, value(i, k))
        if (p := before[i]) >= 0:
            put(p, value(p, i))


class Encoder:
    """Encodes batches of texts; remembers the ids of pre-tokens, a bounded number at once."""

    def __init__(self, vocab: Vocabulary, cache_words: int = CACHE_WORDS):
        self.vocab, self.limit = vocab, cache_words
        self.find, self.find_ascii = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN).findall
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {t: n for n, t in enumerate(self.vocab.special)}
        self.flat = [np.array(list(self.vocab.special.values()), dtype=np.int32)]
        self.count = [np.ones(len(self.vocab.special), dtype=np.int64)]
        self.table, self.at = (self.flat[0], self.count[0]), np.arange(len(self.vocab.special))

    def _cut(self, text: str) -> list[str]:
        return self.find_ascii(text) if text.isascii() else self.find(text)

    def _pieces(self, text: str) -> list[str]:
        if self.vocab.cut is None or not any(t in text for t in self.vocab.special):
            return self._cut(text)
        out: list[str] = []
        for n, part in enumerate(self.vocab.cut.split(text)):
            out += [part] if n % 2 else self._cut(part)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in one row, number of ids of each text)."""
        if len(self.index) > self.limit:
            self._clear()
        pieces = [self._pieces(t) for t in texts]
        new = list(set().union(*pieces) - self.index.keys())
        if new:
            order, ids, own = merge_words(self.vocab, [p.encode() for p in new])
            self.index.update(zip([new[n] for n in order], range(len(self.index), len(self.index) + len(new)), strict=True))
            self.flat.append(ids.astype(np.int32))
            self.count.append(own)
            self.table = np.concatenate(self.flat), np.concatenate(self.count)
            self.flat, self.count = [self.table[0]], [self.table[1]]
            self.at = np.cumsum(self.table[1]) - self.table[1]
        flat, counts = self.table
        n = [len(p) for p in pieces]
        which = np.fromiter(map(self.index.__getitem__, chain.from_iterable(pieces)), dtype=np.int64, count=sum(n))
        count = counts[which]
        to = np.cumsum(count)
        spread = np.repeat(self.at[which] - (to - count), count) + np.arange(to[-1] if len(to) else 0)
        return flat[spread], np.diff(np.concatenate([[0], to])[np.concatenate([[0], np.cumsum(n)])])


def decode_ids(vocab: Vocabulary, ids: np.ndarray, count: np.ndarray) -> list[str]:
    """The text of each run of ids; bytes that aren't UTF-8 become U+FFFD."""
    size = vocab.piece_size[ids]
    to = np.cumsum(size)
    spread = np.repeat(vocab.piece_at[ids] - (to - size), size) + np.arange(to[-1] if len(to) else 0)
    data = vocab.piece_data[spread].tobytes()
    ends = np.concatenate([[0], to])[np.cumsum(count)] if len(count) else np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


@lru_cache(maxsize=4)
def _vocabulary(path: str) -> Vocabulary:
    vocab = Vocabulary(path)
    trim()  # the parsed file
    return vocab


@lru_cache(maxsize=4)
def _encoder(path: str) -> Encoder:
    return Encoder(_vocabulary(path))


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])


def _replace(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    keep = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), values], [*keep, name])


def encode(df: DataFrame, vocab_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with a column of token ids (array<int>) of each whole text; a null or empty text has none.

    A column that is already named as ids is replaced; all others pass through.
    vocab_path must be readable on every executor.  Ids equal those of the
    tokenizers library without added special tokens, special strings in the text
    included.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocab_path)
        for batch in chunks(batches, text):
            flat, count = encoder.encode([t or "" for t in batch.column(text).to_pylist()])
            bounds = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
            yield _replace(batch, ids, pa.ListArray.from_arrays(bounds, pa.array(flat)))

    return df.mapInArrow(run, _with(df, ids, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, vocab_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of each row's token ids; null ids give an empty text."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _vocabulary(vocab_path)
        for batch in batches:
            column = batch.column(ids)
            count = np.array(column.value_lengths().fill_null(0).to_pylist(), dtype=np.int64)
            flat = column.drop_null().flatten().to_numpy(zero_copy_only=False)
            yield _replace(batch, text, pa.array(decode_ids(vocab, flat, count), pa.string()))

    return df.mapInArrow(run, _with(df, text, T.StringType()))


def encode_decode(df: DataFrame, vocab_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """decode(encode(df)) in one pass: a task keeps one Python worker and one vocabulary instead of two.

    A null or empty text has no ids and decodes to an empty text; texts of any length
    are encoded whole; repeated rows stay rows; an empty table gives an empty one.
    Columns that are already named as ids or decoded are replaced, others pass through.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, vocab = _encoder(vocab_path), _vocabulary(vocab_path)
        for batch in chunks(batches, text):
            flat, count = encoder.encode([t or "" for t in batch.column(text).to_pylist()])
            bounds = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
            coded = _replace(batch, ids, pa.ListArray.from_arrays(bounds, pa.array(flat)))
            yield _replace(coded, decoded, pa.array(decode_ids(vocab, flat, count), pa.string()))

    coded = [f for f in _with(df, ids, T.ArrayType(T.IntegerType())).fields if f.name != decoded]
    return df.mapInArrow(run, T.StructType([*coded, T.StructField(decoded, T.StringType())]))
