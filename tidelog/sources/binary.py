"""The engine's binary interchange files: sorted tables, write-ahead logs and manifests.

All integers are little-endian.

    record    u8 type (0 value, 1 tombstone), u32 key length, u32 value length, key, value
    block     records, then u32 crc32 of them
    filter    u32 bits, u8 probes, bit array, then u32 crc32
    index     per block u32 length + first key, u64 offset, u32 length; then u32 crc32
    footer    u64 filter offset, u64 filter length, u64 index offset, u64 index length, u64 entries, u32 magic
    log frame u32 crc32 of the payload, u32 length, payload: u8 type, u32 length + key, u32 length + value
    manifest  u64 next file, u32 levels, per level u32 files, per file u64 number, u64 size, u64 entries, u32 length + smallest, u32 length + largest

Decoders take whole files as rows of ``binaryFile`` and fail loudly on damage;
only the torn end of a log is left out, as its writer never acknowledged it.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sketch import bloom_build, bloom_may_contain
from ..model import RECORD_HEADER, CorruptionError
from ..storage import save

# Fixed values of the format.
MAGIC = 0x4C534D42
FOOTER = struct.Struct("<QQQQQI")
RECORD = struct.Struct("<BII")

Row = tuple[bytes, bytes, bool]


def encode_table(rows: Iterable[Row], block_size: int = 4096, bits_per_key: int = 10) -> bytes:
    """A sorted table of ``(key, value, tomb)`` in ascending key order."""
    out, block, index, keys = bytearray(), bytearray(), bytearray(), []
    first, last = b"", None

    def close() -> None:
        if block:
            index.extend(struct.pack("<I", len(first)) + first + struct.pack("<QI", len(out), len(block) + 4))
            out.extend(block + struct.pack("<I", zlib.crc32(block)))
            block.clear()

    for key, value, tomb in rows:
        if last is not None and key <= last:
            raise ValueError("keys must ascend")
        if not block:
            first = key
        block += RECORD.pack(tomb, len(key), len(value)) + key + value
        keys.append(key)
        last = key
        if len(block) >= block_size:
            close()
    close()
    parts = []
    for body in (bloom_build(keys, bits_per_key), bytes(index)):
        parts += [len(out), len(body) + 4]
        out.extend(body + struct.pack("<I", zlib.crc32(body)))
    out.extend(FOOTER.pack(*parts, len(keys), MAGIC))
    return bytes(out)


def _checked(data: bytes, offset: int, length: int, what: str) -> bytes:
    if length < 4 or offset + length > len(data):
        raise CorruptionError(f"{what} is out of bounds")
    body, (crc,) = data[offset : offset + length - 4], struct.unpack_from("<I", data, offset + length - 4)
    if zlib.crc32(body) != crc:
        raise CorruptionError(f"{what} fails its checksum")
    return body


class SortedTable:
    def __init__(self, data: bytes):
        if len(data) < FOOTER.size:
            raise CorruptionError("the table is too short")
        *where, self.entries, magic = FOOTER.unpack_from(data, len(data) - FOOTER.size)
        if magic != MAGIC:
            raise CorruptionError("not a sorted table")
        self.data = data
        self.filter = _checked(data, where[0], where[1], "the filter")
        index, at = _checked(data, where[2], where[3], "the index"), 0
        self.index: list[tuple[bytes, int, int]] = []
        self._last: bytes | None = None
        while at < len(index):
            (n,) = struct.unpack_from("<I", index, at)
            key = index[at + 4 : at + 4 + n]
            offset, length = struct.unpack_from("<QI", index, at + 4 + n)
            self.index.append((key, offset, length))
            at += 16 + n
        self.firsts = [k for k, _, _ in self.index]

    @property
    def smallest(self) -> bytes:
        return self.firsts[0] if self.firsts else b""

    @property
    def largest(self) -> bytes:
        """The last key, for which the last block is read once."""
        if self._last is None:
            self._last = max((k for k, _, _ in self.block(len(self.index) - 1)), default=b"") if self.index else b""
        return self._last

    def block(self, i: int) -> Iterator[Row]:
        body, at = _checked(self.data, *self.index[i][1:], "a block"), 0
        while at < len(body):
            if at + RECORD.size > len(body):
                raise CorruptionError("a record is cut off")
            kind, n, m = RECORD.unpack_from(body, at)
            at += RECORD.size
            if at + n + m > len(body):
                raise CorruptionError("a record is cut off")
            yield body[at : at + n], body[at + n : at + n + m], kind == 1
            at += n + m

    def rows(self) -> Iterator[Row]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def seek(self, key: bytes) -> Iterator[Row]:
        """The records from the first key at or after ``key`` on."""
        first = max(0, bisect_right(self.firsts, key) - 1)
        for i in range(first, len(self.index)):
            yield from (r for r in self.block(i) if i > first or r[0] >= key)

    def get(self, key: bytes, use_filter: bool = True) -> Row | None:
        """The record of ``key``: filter, then the last block that begins at or before it."""
        if use_filter and not bloom_may_contain(self.filter, [key])[0]:
            return None
        i = bisect_right(self.firsts, key) - 1
        return next((r for r in self.block(i) if r[0] == key), None) if i >= 0 else None


def encode_log(rows: Iterable[Row]) -> bytes:
    out = bytearray()
    for key, value, tomb in rows:
        payload = struct.pack("<BI", tomb, len(key)) + key + struct.pack("<I", len(value)) + value
        out += struct.pack("<II", zlib.crc32(payload), len(payload)) + payload
    return bytes(out)


def replay_log(data: bytes) -> Iterator[Row]:
    """The intact records from the beginning; the first torn or damaged one ends the log."""
    at = 0
    while at + 8 <= len(data):
        crc, n = struct.unpack_from("<II", data, at)
        payload = data[at + 8 : at + 8 + n]
        if len(payload) < n or zlib.crc32(payload) != crc or n < 9:
            return
        kind, k = struct.unpack_from("<BI", payload)
        if 9 + k > n:
            return
        (v,) = struct.unpack_from("<I", payload, 5 + k)
        if 9 + k + v != n:
            return
        yield payload[5 : 5 + k], payload[9 + k :], kind == 1
        at += 8 + n


def encode_manifest(next_file: int, levels: list[list[tuple[int, int, int, bytes, bytes]]]) -> bytes:
    out = bytearray(struct.pack("<QI", next_file, len(levels)))
    for files in levels:
        out += struct.pack("<I", len(files))
        for number, size, entries, low, high in files:
            out += struct.pack("<QQQI", number, size, entries, len(low)) + low + struct.pack("<I", len(high)) + high
    return bytes(out)


def decode_manifest(data: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """``(level, number, size, entries, smallest, largest)`` of every file."""
    try:
        _, levels = struct.unpack_from("<QI", data)
        at = 12
        for level in range(levels):
            (n,) = struct.unpack_from("<I", data, at)
            at += 4
            for _ in range(n):
                number, size, entries, low = struct.unpack_from("<QQQI", data, at)
                at += 28
                smallest = data[at : at + low]
                (high,) = struct.unpack_from("<I", data, at + low)
                at += low + 4
                largest = data[at : at + high]
                at += high
                if at > len(data):
                    raise CorruptionError("the manifest is cut off")
                yield level, number, size, entries, smallest, largest
    except struct.error as e:
        raise CorruptionError("the manifest is cut off") from e


def file_number(name: str) -> tuple[int, str] | None:
    """Number and kind of a file of a store, ``000012.sst`` or ``000007.log``; None for any other name."""
    m = re.fullmatch(r"(\d+)\.(sst|log)", name)
    return (int(m[1]), m[2]) if m else None


def _put_file(path: str, data: bytes) -> None:
    """Write under another name, then rename, so that a task that is lost or runs twice leaves whole files only."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    system.create_dir(at.rpartition("/")[0], recursive=True)
    partial = f"{at}.{uuid.uuid4().hex}"
    with system.open_output_stream(partial) as f:
        f.write(data)
    system.move(partial, at)


def _written(rows: DataFrame, path: str, kind: str, limit: int, parts: int, encode) -> DataFrame:
    """Files of about ``limit`` bytes of ``key``, ``value`` and ``tomb`` from each partition in order: ``number``, ``path``, ``entries``, ``size``,
    ``smallest`` and ``largest``. A partition's numbers are its own and ``parts`` apart, so a task that runs again writes the same names."""
    schema = pa.schema([("number", pa.int64()), ("path", pa.string()), ("entries", pa.int64()), ("size", pa.int64()), ("smallest", pa.binary()), ("largest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() + 1, [], 0

        def close() -> pa.RecordBatch:
            nonlocal number, size
            data, name = encode(held), f"{path}/{number:06d}.{kind}"
            _put_file(name, data)
            keys = [r[0] for r in held]
            out = pa.RecordBatch.from_pylist([{"number": number, "path": name, "entries": len(held), "size": len(data), "smallest": min(keys), "largest": max(keys)}], schema=schema)
            held.clear()
            number, size = number + parts, 0
            return out

        for batch in batches:
            for key, value, tomb in zip(*(c.to_pylist() for c in batch.columns)):
                held.append((key, value, tomb))
                size += RECORD_HEADER + len(key) + len(value)
                if size >= limit:
                    yield close()
        if held:
            yield close()

    binary = rows.select(F.col("key").cast("binary").alias("key"), F.coalesce(F.col("value").cast("binary"), F.lit(b"")).alias("value"), "tomb")
    return save(binary.mapInArrow(run, "number bigint, path string, entries bigint, size bigint, smallest binary, largest binary"), "files")


def write_tables(rows: DataFrame, path: str, limit: int = 2 << 20, block_size: int = 4096, bits_per_key: int = 10) -> DataFrame:
    """Sorted tables of ``key``, ``value`` and ``tomb``, a row per key, with disjoint key ranges; a row per file as ``_written`` gives."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.withColumn("key", F.col("key").cast("binary")).repartitionByRange(parts, "key").sortWithinPartitions("key")
    return _written(placed, path, "sst", limit, parts, lambda held: encode_table(held, block_size, bits_per_key))


def write_logs(rows: DataFrame, path: str, limit: int = 4 << 20) -> DataFrame:
    """Logs of ``seq``, ``key``, ``value`` and ``tomb``, each of a range of ``seq`` in order; a row per file as ``_written`` gives."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _written(rows.repartitionByRange(parts, "seq").sortWithinPartitions("seq"), path, "log", limit, parts, encode_log)


def write_manifest(files: DataFrame, path: str, next_file: int) -> None:
    """One manifest of ``files`` (``level`` and what ``write_tables`` gives), a row per file and so small."""
    levels: list[list] = []
    for r in files.select("level", "number", "size", "entries", "smallest", "largest").orderBy("level", "smallest").collect():
        levels += [[] for _ in range(r["level"] + 1 - len(levels))]
        levels[r["level"]].append((r["number"], r["size"], r["entries"], bytes(r["smallest"]), bytes(r["largest"])))
    _put_file(path, encode_manifest(next_file, levels))


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def _decoded(files: DataFrame, schema: str, columns: list[str], rows) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch.path, batch.content):
                yield pd.DataFrame([(path, *r) for r in rows(bytes(content))], columns=["path", *columns])

    return files.mapInPandas(run, "path string, " + schema)


def read_tables(spark: SparkSession, path: str, pattern: str = "*.sst") -> DataFrame:
    """``path``, ``key``, ``value`` and ``tomb`` of every record of the sorted tables under ``path``."""
    return _decoded(_files(spark, path, pattern), "key binary, value binary, tomb boolean", ["key", "value", "tomb"], lambda b: SortedTable(b).rows())


def read_logs(spark: SparkSession, path: str, pattern: str = "*.log") -> DataFrame:
    """The intact records of logs, with ``seq`` from 0 in each file."""
    return _decoded(_files(spark, path, pattern), "seq bigint, key binary, value binary, tomb boolean", ["seq", "key", "value", "tomb"], lambda b: ((i, *r) for i, r in enumerate(replay_log(b))))


def read_manifests(spark: SparkSession, path: str, pattern: str = "MANIFEST*") -> DataFrame:
    return _decoded(_files(spark, path, pattern), "level int, number bigint, size bigint, entries bigint, smallest binary, largest binary", ["level", "number", "size", "entries", "smallest", "largest"], decode_manifest)
