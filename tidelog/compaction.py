"""Which files to merge next: a planner over the manifest, on the driver."""

from __future__ import annotations

from dataclasses import dataclass

from .manifest import FileMeta, Version
from .model import Options


@dataclass(frozen=True)
class Task:
    source: int
    target: int
    inputs: tuple[FileMeta, ...]
    bottommost: bool


def needs(version: Version, options: Options) -> bool:
    return pick(version, options) is not None


def flushes(files: list[FileMeta]) -> int:
    """Flushes that files of level 0 come from: one may have written several with disjoint keys."""
    return len({f.path.rpartition("/")[0] or f.number for f in files})


def pick(version: Version, options: Options) -> Task | None:
    """Level 0 first, when it has enough flushes; else the first file of the first level over its budget."""
    zero = version.level(0)
    if flushes(zero) >= options.l0_compaction_trigger:
        return _task(version, 0, zero)
    for level in range(1, options.max_levels - 1):
        files = version.level(level)
        if files and sum(f.bytes for f in files) > options.budget(level):
            return _task(version, level, files[:1])
    return None


def _task(version: Version, level: int, chosen: list[FileMeta]) -> Task:
    low, high = min(f.smallest for f in chosen), max(f.largest for f in chosen)
    below = [f for f in version.level(level + 1) if f.overlaps(low, high)]
    # A tombstone may go only if every deeper level is empty, whatever its keys.
    return Task(level, level + 1, (*chosen, *below), version.deepest() <= level + 1)
