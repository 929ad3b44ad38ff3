"""Versioned snapshots of a table: which files make up which level, and which log batches are not flushed yet."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, replace

from .model import CorruptionError
from .storage import Storage

NAME = re.compile(r"^manifest-(\d{12})\.json$")


@dataclass(frozen=True)
class FileMeta:
    number: int
    level: int
    smallest: str
    largest: str
    bytes: int
    entries: int
    path: str

    def holds(self, start: str | None, end: str | None) -> bool:
        """Whether keys of ``[start, end)`` may be inside."""
        return (not start or self.largest >= start) and (not end or self.smallest < end)

    def overlaps(self, low: str, high: str) -> bool:
        return self.largest >= low and self.smallest <= high


@dataclass(frozen=True)
class Batch:
    """A committed batch of the log."""

    number: int
    path: str
    bytes: int
    token: str | None = None


@dataclass(frozen=True)
class Version:
    number: int = 0
    next_file: int = 1
    next_seq: int = 0
    files: tuple[FileMeta, ...] = ()
    batches: tuple[Batch, ...] = ()
    user_bytes: int = 0
    flush_bytes: int = 0
    compaction_bytes: int = 0
    tokens: dict[str, int] = field(default_factory=dict)

    def level(self, n: int) -> list[FileMeta]:
        """Level 0 by age, oldest first; others by key."""
        return sorted((f for f in self.files if f.level == n), key=lambda f: f.number if n == 0 else (f.smallest, f.number))

    def deepest(self) -> int:
        return max((f.level for f in self.files), default=-1)

    def next(self, **changes) -> Version:
        return replace(self, number=self.number + 1, **changes)

    def dumps(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def loads(cls, text: str) -> Version:
        try:
            d = json.loads(text)
            return cls(**d | {"files": tuple(FileMeta(**f) for f in d["files"]), "batches": tuple(Batch(**b) for b in d["batches"])})
        except (ValueError, KeyError, TypeError) as e:
            raise CorruptionError(f"the manifest can't be read: {e}") from e


def published(storage: Storage) -> list[int]:
    return sorted(int(m[1]) for name, _ in storage.list() if (m := NAME.match(name)))


def name_of(number: int) -> str:
    return f"manifest-{number:012d}.json"


def load(storage: Storage) -> Version:
    numbers = published(storage)
    return Version.loads(storage.read(name_of(numbers[-1]))) if numbers else Version()


def commit(storage: Storage, version: Version) -> Version:
    storage.publish(name_of(version.number), version.dumps())
    return version
