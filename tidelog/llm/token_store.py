"""Token-id shards with a minimal perfect hash index for keyed access.

A shard file holds, little-endian: the magic; the counts of documents, distinct
keys, levels, index words and tokens and the id width; the index; the keys in
ascending order and where each document's ids begin; and the raw ids. Ids are
stored in 2 bytes where the vocabulary fits, else in 4.

The index is built by levels of bit arrays: a key alone on its bit at a level is
placed there, the others go on to the next level. The number of set bits before
a key's bit, which is stored for each word of bits, is its slot, a bijection onto
0..n-1. A slot holds a fingerprint of its key and the row of its first document.
A lookup so reads the head, a word of bits a level, one rank, one slot, one key,
two offsets and the ids, each from its place in the file and whatever the shard's
size; a key that isn't there is recognised with a chance of error of 2**-32, then
by the stored key.

Defined cases: a null or empty text has the end id alone; repeated keys stand
next to each other and a lookup gives them all; rows with a null key are stored
first, under the smallest 64-bit integer, and read back as null; an empty table
gives no shard and no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, mix, save, slices, table
from .encoding import default_path, encoder

MAGIC = b"TIDTOK02"
HEAD = struct.Struct("<8s6Q")
SHARD_BYTES = 16_000_000
NULL_KEY = -(1 << 63)
_LEVEL = 0xA0761D6478BD642F
#: Of each distinct key: fingerprint, row of its first document, number of its documents.
SLOT = np.dtype([("print", "<u4"), ("row", "<u4"), ("copies", "<u4")])


def _bit(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    return mix(keys.view(np.uint64) ^ np.uint64(((level + 1) * _LEVEL) % (1 << 64))) % np.uint64(bits)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(np.uint64) + np.uint64(_LEVEL)) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """A bijection of ``n`` distinct 64-bit keys onto ``0..n-1``."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        self.words, self.sizes = words, sizes  # bit arrays one after another, each padded to 64 bits; bits of each
        self.begins = np.concatenate([[0], np.cumsum((sizes + 63) // 64)]).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        words, sizes, level = [], [], 0
        while len(keys):
            bits = max(64, int(gamma * len(keys)))
            at = _bit(keys, level, bits).astype(np.int64)
            alone = np.bincount(at, minlength=bits)[at] == 1
            held = np.zeros((bits + 63) // 64 * 64, np.uint8)
            held[at[alone]] = 1
            words.append(np.packbits(held, bitorder="little").view(np.uint64))
            sizes.append(bits)
            keys, level = keys[~alone], level + 1
        return cls(np.concatenate(words) if words else np.zeros(0, np.uint64), np.array(sizes, np.int64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no level holds it."""
        out = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for level, bits in enumerate(self.sizes):
            at = _bit(keys[rest], level, int(bits)).astype(np.int64)
            word = self.begins[level] + at // 64
            mask = np.uint64(1) << (at % 64).astype(np.uint64)
            there = (self.words[word] & mask) != 0
            found = rest[there]
            out[found] = self.before[word[there]] + np.bitwise_count(self.words[word[there]] & (mask[there] - np.uint64(1)))
            rest = rest[~there]
            if not len(rest):
                break
        return out


def shard_bytes(keys: np.ndarray, ids: list[bytes], wide: bool) -> bytes:
    """The file of documents in ascending key order; ``ids`` are little-endian unsigned 32-bit integers."""
    tokens = np.frombuffer(b"".join(ids), "<u4")
    starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype("<u8")
    distinct, first, copies = np.unique(keys, return_index=True, return_counts=True)
    index = PerfectHash.build(distinct)
    slot = index.slots(distinct)
    slots = np.zeros(len(distinct), SLOT)
    slots["print"][slot], slots["row"][slot], slots["copies"][slot] = fingerprint(distinct), first, copies
    head = HEAD.pack(MAGIC, len(keys), len(distinct), len(index.sizes), len(index.words), len(tokens), 4 if wide else 2)
    parts = (index.sizes.astype("<i8"), index.words.astype("<u8"), index.before[:-1].astype("<u8"), slots, keys.astype("<i8"), starts, tokens if wide else tokens.astype("<u2"))
    return head + b"".join(x.tobytes() for x in parts)


class Layout:
    """Where the parts of a shard are, from its head."""

    def __init__(self, head: bytes):
        magic, self.docs, self.distinct, self.levels, self.words, self.tokens, self.width = HEAD.unpack_from(head)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.at, at = {}, HEAD.size
        for name, size in (("sizes", 8 * self.levels), ("words", 8 * self.words), ("ranks", 8 * self.words), ("slots", SLOT.itemsize * self.distinct), ("keys", 8 * self.docs), ("starts", 8 * (self.docs + 1)), ("tokens", self.width * self.tokens)):
            self.at[name], at = at, at + size
        self.size = at


class Shard:
    """Keyed access to one shard file."""

    def __init__(self, data: bytes):
        at = self.layout = Layout(data)
        self.data, self.width = data, at.width
        if len(data) != at.size:
            raise ValueError("the shard is cut off")
        self.index = PerfectHash(self._part("words", "<u8", at.words), self._part("sizes", "<i8", at.levels))
        self.slots = self._part("slots", SLOT, at.distinct)
        self.keys = self._part("keys", "<i8", at.docs)
        self.starts = self._part("starts", "<u8", at.docs + 1).astype(np.int64)
        self.tokens = self._part("tokens", "<u2" if at.width == 2 else "<u4", at.tokens)

    def _part(self, name: str, kind, n: int) -> np.ndarray:
        return np.frombuffer(self.data, kind, n, self.layout.at[name])

    def rows_of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key its first row and its number of rows, 0 if it isn't there."""
        keys = np.ascontiguousarray(keys, np.int64)
        slot = self.index.slots(keys)
        known = slot >= 0
        known[known] = self.slots["print"][slot[known]] == fingerprint(keys[known])
        known[known] = self.keys[self.slots["row"][slot[known]]] == keys[known]
        found = self.slots[np.where(known, slot, 0)] if len(self.slots) else np.zeros(len(keys), SLOT)
        return np.where(known, found["row"], 0).astype(np.int64), np.where(known, found["copies"], 0).astype(np.int64)

    def ids(self, row: int) -> np.ndarray:
        return self.tokens[self.starts[row] : self.starts[row + 1]].astype("<u4")

    def get(self, key: int) -> list[np.ndarray]:
        (first,), (n,) = self.rows_of(np.array([key]))
        return [self.ids(r) for r in range(first, first + n)]


class OpenShard:
    """Keyed access to a shard file by reads of a few bytes at their places; ``reads`` counts the bytes."""

    def __init__(self, file):
        self.file, self.reads = file, 0
        self.layout = Layout(self._read(0, HEAD.size))
        self.sizes = self._array("sizes", 0, "<i8", self.layout.levels)
        self.begins = np.concatenate([[0], np.cumsum((self.sizes + 63) // 64)])

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(size)
        if len(data) != size:
            raise ValueError("the shard is cut off")
        self.reads += size
        return data

    def _array(self, name: str, first: int, kind, n: int = 1) -> np.ndarray:
        kind = np.dtype(kind)
        return np.frombuffer(self._read(self.layout.at[name] + first * kind.itemsize, n * kind.itemsize), kind)

    def get(self, key: int) -> list[np.ndarray]:
        keys = np.array([key], np.int64)
        for level, bits in enumerate(self.sizes):
            at = int(_bit(keys, level, int(bits))[0])
            word = int(self.begins[level]) + at // 64
            held = int(self._array("words", word, "<u8")[0])
            if held >> (at % 64) & 1:
                break
        else:
            return []
        rank = int(self._array("ranks", word, "<u8")[0]) + (held & ((1 << (at % 64)) - 1)).bit_count()
        slot = self._array("slots", rank, SLOT)[0]
        row, copies = int(slot["row"]), int(slot["copies"])
        if slot["print"] != fingerprint(keys)[0] or self._array("keys", row, "<i8")[0] != key:
            return []
        starts = self._array("starts", row, "<u8", copies + 1).astype(np.int64)
        ids = self._array("tokens", int(starts[0]), "<u2" if self.layout.width == 2 else "<u4", int(starts[-1] - starts[0])).astype("<u4")
        return [ids[a - starts[0] : b - starts[0]] for a, b in zip(starts, starts[1:])]


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def read_shard(path: str) -> Shard:
    system, at = _filesystem(path)
    with system.open_input_stream(at) as f:
        return Shard(f.read())


def write_file(path: str, data: bytes) -> None:
    """Write under another name, then rename, so that a task that is lost or runs twice leaves whole files only."""
    system, at = _filesystem(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    partial = f"{at}.{uuid.uuid4().hex}"
    with system.open_output_stream(partial) as f:
        f.write(data)
    system.move(partial, at)


def write_shards(docs: DataFrame, path: str, tokenizer: str | None = None, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """Encode ``docs`` and write shards of about ``limit`` bytes to ``path`` in ascending key order.

    Returns the manifest, itself written beside the shards: a row per shard with ``path``, its first and last key,
    ``n_docs``, ``n_tokens`` and ``token_base``, the ids of all shards before it.
    """
    tokenizer = tokenizer or default_path()
    from tokenizers import Tokenizer

    wide = Tokenizer.from_file(tokenizer).get_vocab_size() > 1 << 16
    ordered = docs.select(F.coalesce(F.col(key), F.lit(NULL_KEY)).cast("bigint").alias("key"), F.col(text).alias("text"))
    ordered = ordered.repartitionByRange("key", F.xxhash64("text")).sortWithinPartitions("key", "text")
    schema = "path string, first_key bigint, last_key bigint, part int, n_docs bigint, n_tokens bigint, seq int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        keys: list[int] = []
        ids: list[bytes] = []
        size = 0

        def close():
            nonlocal seq, size
            name = f"{path}/shard-{part:06d}-{seq:05d}.tok"
            write_file(name, shard_bytes(np.array(keys, np.int64), ids, wide))
            row = [name], [keys[0]], [keys[-1]], [part], [len(keys)], [sum(map(len, ids)) // 4], [seq]
            keys.clear(), ids.clear()
            seq, size = seq + 1, 0
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds)], names=names)

        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
        names = ["path", "first_key", "last_key", "part", "n_docs", "n_tokens", "seq"]
        encode = encoder(tokenizer).encode_all
        for batch in batches:
            for cut in slices(batch):
                for k, x in zip(cut.column(0).to_pylist(), encode([t or "" for t in cut.column(1).to_pylist()])):
                    keys.append(k)
                    ids.append(x + b"\0\0\0\0")
                    size += len(ids[-1]) // (1 if wide else 2)
                    if size >= limit:
                        yield close()
        if keys:
            yield close()

    manifest = save(ordered.mapInArrow(run, schema), "token-manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard, not per document
    return manifest.withColumn("token_base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_back(manifest: DataFrame) -> DataFrame:
    """Every document by keyed access to the shards: ``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32``."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns)):
                shard = read_shard(path)
                keys = np.unique(shard.keys)
                first, copies = shard.rows_of(keys)
                row = np.repeat(first, copies) + np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                crc = [zlib.crc32(shard.ids(r)) for r in row.tolist()]
                key = np.repeat(keys, copies)
                yield pa.RecordBatch.from_arrays([pa.array(key, mask=key == NULL_KEY), pa.array(base + shard.starts[row]), pa.array(np.diff(shard.starts)[row]), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("path", "token_base").repartition(parts, "path").mapInArrow(run, schema)


def lookup(manifest: DataFrame, key: int) -> list[np.ndarray]:
    """The ids of each document with this key, read from its place in the shards of the manifest that may hold it."""
    out = []
    for r in manifest.where((F.col("first_key") <= key) & (F.col("last_key") >= key)).orderBy("part", "seq").select("path").collect():
        system, at = _filesystem(r["path"])
        with system.open_input_file(at) as f:
            out += OpenShard(f).get(key)
    return out


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(write_shards(table(spark, sf_dir, "documents"), fresh_path(spark, "tokens")))
