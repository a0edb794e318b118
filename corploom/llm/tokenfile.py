"""Token ids in files of small compressed documents.

A folder holds two Parquet tables that Spark's committers write, so a lost executor
leaves no half of a file:

* ``dictionary`` - one row: a zstandard dictionary and its SHA-256.
* ``blocks`` - one row for some documents in ascending doc_id: their ids as
  little-endian unsigned 32-bit integers, each document compressed by itself, one
  behind the other in ``payload``; ``doc_ids``, ``counts`` and ``sizes`` are the index of
  offsets; ``before`` is the number of ids that the shard holds before the block;
  ``dict_hash`` names the dictionary that the block needs.

Documents are dealt to shards by ranges of doc_id, so the order of shards is that of
documents, and what lies before a shard is the sum of one number a shard.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textkernel import chunks
from .work import parallelism, small_batches

CACHE_WORDS = 500_000  # that an encoder remembers; beyond, it begins anew
DICT_ROWS, DICT_SLICE, DICT_BYTES = 2000, 4096, 64 << 10  # documents sampled for the dictionary, bytes of each, and its size
BLOCK_BYTES, BLOCK_DOCS = 1 << 20, 4096  # a block ends with the document that reaches either
NO_DICTIONARY = "-"

#: The normaliser and the pre-tokenizer of a word-end BPE file, for which ids of a text are those of its words.
_WORD_NORMALIZER = [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for words of ASCII signs and Latin-1 letters in lower case; all such words are in normal form C.
_plain = re.compile(r"[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+").fullmatch
_cut = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xc0-\xff]+|[0-9]|[^a-z0-9\xc0-\xff]+").findall


def _is_word_rule(spec: dict) -> bool:
    """Whether a tokenizer file cuts texts at white space, so that words can be encoded one by one."""
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = [(s["type"], (s.get("pattern") or {}).get("Regex")) for s in norm.get("normalizers", [])]
    parts = pre.get("pretokenizers", [])
    split = len(parts) == 2 and parts[0].get("pattern") == {"Regex": _WORD_SPLIT} and (parts[0].get("behavior"), parts[0].get("invert")) == ("Removed", True)
    whole = not any(c.isspace() for t in spec.get("added_tokens", []) for c in t["content"]) and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", []))
    return steps == _WORD_NORMALIZER and split and parts[1].get("type") == "ByteLevel" and not parts[1].get("add_prefix_space") and whole and not spec.get("post_processor")


class Encoder:
    """Ids of texts as the tokenizers library gives them, serialised.

    Where the file's rule cuts at white space, each different word is asked for
    once: words of plain characters are cut here and merged by the library's model,
    all others go through the whole library.  Other files encode whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation(), self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_words, self.model = _is_word_rule(spec), self.tokenizer.model
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.signs = {i: "".join(t for t, _ in level.pre_tokenize_str(chr(i))) for i in range(0x80, 0x100)}
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _serialised(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        if (out := self.pieces.get(piece)) is None:
            ids = [t.id for t in self.model.tokenize(piece if piece.isascii() else piece.translate(self.signs))]
            out = self.pieces[piece] = pack(f"<{len(ids)}I", *ids)
        return out

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if _plain(text) and not any(s in text for s in self.special):
            return b"".join(map(self._piece, _cut(text.lower())))
        return self._serialised(text)

    def __call__(self, text: bytes) -> bytes:
        """The ids of a UTF-8 text, four bytes each."""
        if not self.by_words:
            return self._serialised(text.decode())
        words, known = text.split(), self.words  # of bytes: at ASCII white space only
        for w in words:
            if w not in known:
                known[w] = self._word(w)
        out = b"".join(map(known.__getitem__, words))
        if len(known) > CACHE_WORDS:
            self.words = {}
        if len(self.pieces) > CACHE_WORDS:
            self.pieces = {}
        return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def train_dictionary(docs: DataFrame, vocab_path: str, end_id: int, rows: int = DICT_ROWS, size: int = DICT_BYTES, seed: int = 11) -> bytes:
    """A dictionary for serialised ids, from at most rows documents chosen by their ids; empty where they are too few to learn from.

    Of each document at most DICT_SLICE bytes are collected, from a place that its id
    decides, so the driver gets rows * DICT_SLICE bytes at most.  It changes sizes only.
    """
    picked = docs.where(F.col("doc_id").isNotNull()).select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(rows).distinct()
    sample = docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))  # picked: rows ids at most
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _encoder(vocab_path), pack("<I", end_id)
        for batch in chunks(batches):
            ids, taken = batch.column("doc_id").to_pylist(), []
            for i, text in zip(ids, _texts(batch), strict=True):
                data = encode(text) + end
                start = 4 * (abs(i) % max(1, (len(data) - DICT_SLICE) // 4 + 1))
                taken.append(data[start : start + DICT_SLICE])
            yield pa.RecordBatch.from_arrays([pa.array(map(str, ids), pa.string()), pa.array(taken, pa.binary())], ["doc_id", "slice"])

    got = sorted((r["doc_id"], bytes(r["slice"])) for r in sample.select("doc_id", "text").mapInArrow(cut, "doc_id string, slice binary").collect())
    try:
        return zstandard.train_dictionary(size, [s for _, s in got]).as_bytes()
    except zstandard.ZstdError:
        return b""


def _hash(dictionary: bytes) -> str:
    return hashlib.sha256(dictionary).hexdigest() if dictionary else NO_DICTIONARY


def _codec(kind: type, dictionary: bytes, **options: int):
    return kind(dict_data=zstandard.ZstdCompressionDict(dictionary), **options) if dictionary else kind(**options)


BLOCKS = "shard long, block long, before long, n_tokens long, first_id long, last_id long, dict_hash string, doc_ids array<long>, counts array<long>, sizes array<long>, payload binary"


def write(docs: DataFrame, vocab_path: str, folder: str, end_id: int = 2, level: int = 3) -> None:
    """Encode every whole text (null: empty), append end_id, and write the folder.

    docs needs doc_id (whole numbers) and text; other columns don't count.
    Documents ascend by doc_id, those without one first; rows that repeat a doc_id
    stand next to each other as documents each, in the order of their texts' hashes.  A text of
    any length is one document, in a block of its own if it is long.
    vocab_path must be readable on every executor.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dictionary = train_dictionary(docs, vocab_path, end_id)
    name = _hash(dictionary)
    spark.createDataFrame([(name, dictionary)], "dict_hash string, dictionary binary").coalesce(1).write.mode("overwrite").parquet(f"{folder}/dictionary")

    def pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, compressor, end = _encoder(vocab_path), _codec(zstandard.ZstdCompressor, dictionary, level=level), pack("<I", end_id)
        shard, block, before, held = TaskContext.get().partitionId(), 0, 0, []

        def close() -> pa.RecordBatch:
            ids, counts, packed = zip(*held, strict=True)
            known = [i for i in ids if i is not None]
            row = {
                "shard": shard, "block": block, "before": before, "n_tokens": sum(counts), "first_id": known[0] if known else None, "last_id": known[-1] if known else None,
                "dict_hash": name, "doc_ids": list(ids), "counts": list(counts), "sizes": list(map(len, packed)), "payload": b"".join(packed),
            }
            return pa.RecordBatch.from_pylist([row], _BLOCK_SCHEMA)

        size = 0
        for batch in chunks(batches):
            for i, text in zip(batch.column("doc_id").to_pylist(), _texts(batch), strict=True):
                data = encode(text) + end
                held.append((i, len(data) // 4, compressor.compress(data)))
                size += len(held[-1][2])
                if size >= BLOCK_BYTES or len(held) >= BLOCK_DOCS:
                    yield close()
                    block, before, size, held = block + 1, before + sum(n for _, n, _ in held), 0, []
        if held:
            yield close()

    tied = docs.withColumns({"__hash": F.xxhash64("text"), "__row": F.monotonically_increasing_id()})  # a doc_id of very many rows is split, too
    keys = ["doc_id", "__hash", "__row"]
    ranged = tied.repartitionByRange(parallelism(spark), *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    small_batches(spark)
    ranged.mapInArrow(pack_blocks, BLOCKS).write.mode("overwrite").parquet(f"{folder}/blocks")


_BLOCK_SCHEMA = pa.schema([
    *((n, pa.int64()) for n in ("shard", "block", "before", "n_tokens", "first_id", "last_id")), ("dict_hash", pa.string()),
    *((n, pa.list_(pa.int64())) for n in ("doc_ids", "counts", "sizes")), ("payload", pa.binary()),
])


def _placed(spark: SparkSession, folder: str) -> tuple[DataFrame, bytes]:
    """blocks with start, the ids of all documents before a block, and the dictionary."""
    row = spark.read.parquet(f"{folder}/dictionary").first()
    blocks = spark.read.parquet(f"{folder}/blocks")
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # a row a shard, as many as the writing job had tasks
    base = totals.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return blocks.join(F.broadcast(base), "shard").withColumn("start", F.col("base") + F.col("before")).drop("base"), bytes(row["dictionary"])


DOCUMENTS = "doc_id long, start long, n_tokens long, ids binary"
_DOCUMENT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _check(dictionary: bytes, names: list[str]) -> None:
    if strange := set(names) - {_hash(dictionary)}:
        raise ValueError(f"blocks need another dictionary: {sorted(strange)}")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the folder; start counts the ids of all documents before it."""
    blocks, dictionary = _placed(spark, folder)
    small_batches(spark)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompressor = _codec(zstandard.ZstdDecompressor, dictionary)
        for batch in batches:
            _check(dictionary, batch.column("dict_hash").to_pylist())
            for b in range(batch.num_rows):
                doc_ids, counts, sizes, payload, start = (batch.column(c)[b].as_py() for c in ("doc_ids", "counts", "sizes", "payload", "start"))
                ends, view = np.cumsum(sizes), memoryview(payload)
                starts = start + np.cumsum(counts) - np.array(counts)
                ids = [decompressor.decompress(view[e - s : e]) for s, e in zip(sizes, ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], schema=_DOCUMENT_SCHEMA)

    return blocks.select("start", "dict_hash", "doc_ids", "counts", "sizes", "payload").mapInArrow(unpack, DOCUMENTS)


def lookup(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """The same of some documents: only blocks whose range may hold one are read, and only the documents' own bytes are decompressed."""
    blocks, dictionary = _placed(spark, folder)
    if not doc_ids:
        return spark.createDataFrame([], DOCUMENTS)
    near = blocks.where((F.col("last_id") >= min(doc_ids)) & (F.col("first_id") <= max(doc_ids)))
    upto = lambda a, i: F.aggregate(F.slice(a, 1, i), F.lit(0).cast("long"), lambda x, y: x + y)
    asked = F.array(*[F.lit(i).cast("long") for i in sorted(set(doc_ids))])
    rows = near.where(F.arrays_overlap("doc_ids", asked)).select("*", F.posexplode("doc_ids").alias("i", "doc_id")).where(F.col("doc_id").isin(*sorted(set(doc_ids))))
    found = rows.select(
        "doc_id", (F.col("start") + upto("counts", F.col("i"))).alias("start"), F.get("counts", F.col("i")).alias("n_tokens"), "dict_hash",
        F.substr("payload", (upto("sizes", F.col("i")) + 1).cast("int"), F.get("sizes", F.col("i")).cast("int")).alias("packed"),
    )
    small_batches(spark)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompressor = _codec(zstandard.ZstdDecompressor, dictionary)
        for batch in batches:
            _check(dictionary, batch.column("dict_hash").to_pylist())
            ids = [decompressor.decompress(p) for p in batch.column("packed").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(ids, pa.binary())], schema=_DOCUMENT_SCHEMA)

    return found.mapInArrow(unpack, DOCUMENTS)
