"""Schemas, options and errors of the key-value engine.

Rows of the operation log carry an explicit ``seq``, unique and increasing with
acknowledgement. The larger ``seq`` of a key wins; a deletion is a row with
``tomb`` set, never a null or empty value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

FOUND, DELETED, NOT_FOUND = "FOUND", "DELETED", "NOT_FOUND"

#: Bytes of a record besides its key and value, in the size model of runs.
RECORD_HEADER = 9


def op_schema(key: str = "string", value: str = "string") -> T.StructType:
    return T.StructType.fromDDL(f"key {key}, seq bigint, value {value}, tomb boolean")


@dataclass(frozen=True)
class Options:
    """Tuning of one table. Sizes are in bytes."""

    memtable_flush_threshold: int = 4 << 20
    l0_compaction_trigger: int = 4
    l1_target_bytes: int = 8 << 20
    level_size_multiplier: int = 10
    target_file_size: int = 2 << 20
    max_levels: int = 7
    bloom_bits_per_key: int = 10
    block_size: int = 4096
    block_cache_bytes: int = 8 << 20
    keep_versions: int = 3
    keep_tokens: int = 1000

    def budget(self, level: int) -> int:
        return self.l1_target_bytes * self.level_size_multiplier ** (level - 1)


class EngineError(Exception):
    pass


class CorruptionError(EngineError):
    """Stored bytes don't match their checksum or format."""


class InvalidArgument(EngineError):
    pass


class ConflictError(EngineError):
    """Another writer published a version first."""
