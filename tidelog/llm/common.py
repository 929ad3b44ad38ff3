"""Shared pieces: the folder all executors see, written tables, vectorised words.

A *word* is a maximal run of bytes that are not space or 0x09-0x0D. Those bytes
never occur inside a multi-byte UTF-8 character, so words can be cut on the
encoded text without decoding it.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..storage import discard, fresh_path, save, shared_dir  # noqa: F401

#: Text bytes handled at once by the vectorised code; one longer text makes a chunk of its own.
CHUNK_BYTES = 1_000_000
#: Words longer than this are hashed one by one.
LONG_WORD = 64

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has."""
    there, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in there:
            name += "_"
        there.add(name.lower())
        out.append(name)
    return out


def arrow_map(df: DataFrame, columns: list[str], schema: str, f: Callable[[pa.RecordBatch], Iterator[dict]], text: str | None = None) -> DataFrame:
    """Apply ``f`` to slices of ``columns``, cut by ``CHUNK_BYTES`` of the column ``text``, else of one of that name or the first string one."""
    kept = df.select(*columns)
    arrow = pa.schema(_arrow_fields(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text=text):
                for out in f(part):
                    yield pa.RecordBatch.from_arrays([pa.array(out[n], t) if not isinstance(out[n], pa.Array) else out[n].cast(t) for n, t in zip(arrow.names, arrow.types)], schema=arrow)
        give_back()

    return kept.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system at a task's end: Spark keeps its Python workers, and an executor's memory holds all of them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def _arrow_fields(schema: str | StructType) -> list[pa.Field]:
    return list(to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema))


def text_column(batch: pa.RecordBatch) -> pa.Array | None:
    """The column ``text``, else the first of strings."""
    strings = {n: c for n, c in zip(batch.schema.names, batch.columns) if pa.types.is_string(c.type) or pa.types.is_large_string(c.type)}
    return strings.get("text", next(iter(strings.values()), None))


def slices(batch: pa.RecordBatch, limit: int = CHUNK_BYTES, text: str | None = None) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` with at most ``limit`` bytes of text, or one row."""
    column = batch.column(batch.schema.get_field_index(text)) if text else text_column(batch)
    if column is None:
        yield batch
        return
    ends = np.cumsum(np.nan_to_num(np.asarray(pc.binary_length(column).to_numpy(zero_copy_only=False), float))) if batch.num_rows else np.zeros(0)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def only_shared(df: DataFrame, key: str, then: list[str], distinct: bool = False, salt: str | None = None) -> DataFrame:
    """The rows of an integer table whose ``key`` other rows have too, and with ``distinct`` each row once.

    The rows of a key come to one task in order and pass through it: a key may have any number. A key that is known to be
    shared by many can be dealt to several tasks: all rows whose ``salt``, which is then left out of the result, isn't 0 are kept.
    """
    names = df.columns
    first, kinds = names.index(key), [f.type for f in _arrow_fields(df.schema)]
    out = [i for i, n in enumerate(names) if n != salt]

    def kept(rows: list[np.ndarray], keep: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[i][keep], kinds[i]) for i in out], names=[names[i] for i in out])

    def run(batches: Iterator[pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
        held, carried = [np.zeros(0, np.int64)] * len(names), False  # the last row so far, and whether its key had rows before it
        for batch in _and_none(batches):
            rows = held if batch is None else [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns)]
            if not len(rows[0]):
                continue
            if distinct:
                new = np.ones(len(rows[0]), bool)
                new[1:] = np.any([c[1:] != c[:-1] for c in rows], axis=0)
                rows = [c[new] for c in rows]
            k = rows[first]
            like = k[1:] == k[:-1]
            shared = np.zeros(len(k), bool) if salt is None else rows[names.index(salt)] != 0
            shared[1:] |= like
            shared[:-1] |= like
            shared[0] |= carried
            if batch is None:
                yield kept(rows, shared)
                continue
            held, carried = [c[-1:] for c in rows], bool(shared[-1])
            shared[-1] = False  # that row comes with the next batch
            yield kept(rows, shared)

    return df.repartition(key, *([salt] if salt else [])).sortWithinPartitions(key, *then).mapInArrow(run, df.select(*(names[i] for i in out)).schema)


def _and_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    """Words of consecutive texts. Word ``i`` is ``data[start[i]:end[i]]``; text ``d`` has words ``first[d]`` to ``first[d + 1]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    bounds: np.ndarray

    def of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def encoded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: empty) and the bounds of each."""
    texts = texts.fill_null("").cast(pa.large_binary())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def cut_words(texts: pa.Array, lower: bool = False) -> Words:
    data, bounds = encoded(texts)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    opens[inner] = inside[inner]
    closes[inner - 1] = inside[inner - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(data, start, end, np.searchsorted(start, bounds), bounds)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    size = end - start
    out = np.full(len(start), 0xCBF29CE484222325, np.uint64)
    live = np.flatnonzero(size <= LONG_WORD)
    k = 0
    while len(live):
        live = live[size[live] > k]
        out[live] = (out[live] ^ data[start[live] + k]) * np.uint64(0x100000001B3)
        k += 1
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return mix(out ^ (size.astype(np.uint64) * _MULTIPLIER))


def word_hashes(words: Words) -> np.ndarray:
    return hash_spans(words.data, words.start, words.end)


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every ``size`` consecutive word hashes; one entry for each start that has so many."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(n, _MULTIPLIER), dtype=np.uint64)])
    return mix((total[size:] - total[:-size]) * powers(n - size + 1, _INVERSE))


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)
