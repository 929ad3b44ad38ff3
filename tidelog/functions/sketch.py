"""MurmurHash3 x64-128 and bloom filters with a fixed layout, vectorised."""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of MurmurHash3 x64-128.
C1, C2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
F1, F2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
A1, A2 = 0x52DCE729, 0x38495AB5

U = np.uint64


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def _fmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(F1)
    x = (x ^ (x >> U(33))) * U(F2)
    return x ^ (x >> U(33))


def murmur128(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the hash (seed 0) of each key. Keys of one length are hashed together."""
    size = np.array([len(k) for k in keys], np.int64)
    one, two = np.zeros(len(keys), U), np.zeros(len(keys), U)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        padded = n // 16 * 16 + 16
        lanes = np.frombuffer(b"".join(keys[i].ljust(padded, b"\0") for i in at), "<u8").reshape(len(at), -1)
        h1, h2 = np.zeros(len(at), U), np.zeros(len(at), U)
        for b in range(n // 16):
            h1 ^= _rotl(lanes[:, 2 * b] * U(C1), 31) * U(C2)
            h1 = (_rotl(h1, 27) + h2) * U(5) + U(A1)
            h2 ^= _rotl(lanes[:, 2 * b + 1] * U(C2), 33) * U(C1)
            h2 = (_rotl(h2, 31) + h1) * U(5) + U(A2)
        h2 ^= _rotl(lanes[:, -1] * U(C2), 33) * U(C1)  # the tail is padded with zeros, which hash to nothing
        h1 ^= _rotl(lanes[:, -2] * U(C1), 31) * U(C2)
        h1, h2 = h1 ^ U(n), h2 ^ U(n)
        h1 = h1 + h2
        h2 = h2 + h1
        h1, h2 = _fmix(h1), _fmix(h2)
        h1 = h1 + h2
        one[at], two[at] = h1, h2 + h1
    return one, two


def probes(bits_per_key: int) -> int:
    return min(max(round(bits_per_key * math.log(2)), 1), 30)


def probes_column(bits_per_key: Column) -> Column:
    return F.least(F.greatest(F.round(bits_per_key * 0.6931471805599453), F.lit(1)), F.lit(30)).cast("int")


def false_positive_column(bits_per_key: Column) -> Column:
    k = probes_column(bits_per_key)
    return F.pow(1 - F.exp(-k / bits_per_key), k)


def filter_bits(entries: Column, bits_per_key: int) -> Column:
    return (F.ceil(F.greatest(entries * bits_per_key, F.lit(64)) / 8) * 8).cast("bigint")


def bloom_build(keys: list[bytes], bits_per_key: int) -> bytes:
    """``u32 bits, u8 probes, bit array``, little-endian."""
    bits = (max(64, len(keys) * bits_per_key) + 7) // 8 * 8
    h1, h2 = murmur128(keys)
    held = np.zeros(bits, np.uint8)
    for j in range(probes(bits_per_key)):
        held[((h1 + U(j) * h2) % U(bits)).astype(np.int64)] = 1
    return struct.pack("<IB", bits, probes(bits_per_key)) + np.packbits(held, bitorder="little").tobytes()


def bloom_may_contain(data: bytes | None, keys: list[bytes]) -> np.ndarray:
    """No false negatives. A filter that is missing or malformed says maybe to everything."""
    if not data or len(data) < 5:
        return np.ones(len(keys), bool)
    bits, k = struct.unpack_from("<IB", data)
    if not bits or len(data) < 5 + (bits + 7) // 8:
        return np.ones(len(keys), bool)
    held = np.unpackbits(np.frombuffer(data, np.uint8, (bits + 7) // 8, 5), bitorder="little")
    h1, h2 = murmur128(keys)
    out = np.ones(len(keys), bool)
    for j in range(k):
        out &= held[((h1 + U(j) * h2) % U(bits)).astype(np.int64)] == 1
    return out


def _bytes(values: pd.Series) -> list[bytes]:
    return [v.encode() if isinstance(v, str) else bytes(v) for v in values]


def murmur_column(key: str):
    """A column with both halves as 16 hexadecimal digits each."""

    @F.pandas_udf("string")
    def digest(values: pd.Series) -> pd.Series:
        one, two = murmur128(_bytes(values))
        return pd.Series([f"{int(a):016x}{int(b):016x}" for a, b in zip(one, two)])

    return digest(F.col(key))


def bloom_by_run(rows: DataFrame, bits_per_key: int) -> DataFrame:
    """``run_id`` and ``filter`` over each run's keys; a run is one file and so bounded by the flush threshold."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"run_id": group.run_id[:1], "filter": [bloom_build(_bytes(group.key), bits_per_key)]})

    return rows.select("run_id", "key").groupBy("run_id").applyInPandas(build, "run_id bigint, filter binary")


def may_contain(probe: DataFrame, filters: DataFrame) -> DataFrame:
    """``run_id``, ``key`` and ``maybe`` for every probe row (``run_id``, ``key``)."""

    def test(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        data = right["filter"].iloc[0] if len(right) else None
        return left[["run_id", "key"]].assign(maybe=bloom_may_contain(data, _bytes(left.key)))

    return probe.groupBy("run_id").cogroup(filters.groupBy("run_id")).applyInPandas(test, "run_id bigint, key string, maybe boolean")
