"""A persistent, ordered, versioned key-value table.

    t = KVTable.open(spark, path)
    t.put(df)                   # columns key, value
    t.delete(df)                # column key
    t.scan("a", "b")            # live rows of [a, b)
    t.multi_get(probe)          # key -> FOUND, DELETED or NOT_FOUND
    t.flush(); t.compact()

Every change is a new manifest version; a reader keeps the files of the version
it opened. A flush or compaction goes on top of what others published meanwhile
where that leaves its inputs alone; else, and for a second writer that appends,
it is a ``ConflictError``.

A deleted key reads DELETED while its tombstone is stored and NOT_FOUND once a
merge into the last level has dropped it.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import compaction, manifest
from .manifest import Batch, FileMeta, Version
from .model import RECORD_HEADER, ConflictError, InvalidArgument, Options, op_schema
from .operators import merge
from .operators.runs import key_value_bytes, user_bytes
from .storage import Storage

#: Parquet settings of runs: page checksums written and checked, a filter on the key.
CHECKSUMS = {"parquet.page.write-checksum.enabled": "true"}
VERIFY = {"parquet.page.verify-checksum.enabled": "true"}


class KVTable:
    def __init__(self, spark: SparkSession, path: str, options: Options):
        self.spark, self.options, self.storage = spark, options, Storage(spark, path)
        self.version = manifest.load(self.storage)

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: Options | None = None) -> KVTable:
        options = options or Options()
        if min(options.memtable_flush_threshold, options.l0_compaction_trigger, options.target_file_size, options.max_levels) < 1 or options.level_size_multiplier < 1:
            raise InvalidArgument("sizes and counts must be positive")
        table = cls(spark, path, options)
        table.storage.mkdirs()
        return table

    # ---- writing

    def put(self, df: DataFrame, order: Column | None = None, token: str | None = None) -> KVTable:
        """Append ``key``, ``value``; with a column ``tomb`` also deletions. Later rows in ``order`` (else in ``df``) win.

        ``token`` names the batch: a token that was committed before is not applied again.
        """
        tomb = F.coalesce(F.col("tomb"), F.lit(False)) if "tomb" in df.columns else F.lit(False)
        return self._append(df, tomb, order, token)

    def delete(self, df: DataFrame, order: Column | None = None, token: str | None = None) -> KVTable:
        return self._append(df.withColumn("value", F.lit("")), F.lit(True), order, token)

    def _append(self, df: DataFrame, tomb: Column, order: Column | None, token: str | None) -> KVTable:
        base = self.version
        if token is not None and token in base.tokens:
            return self
        ops = df if order is None else df.repartitionByRange(order).sortWithinPartitions(order)
        # Increasing with the order of rows; gaps don't matter.
        ops = ops.select("key", (F.monotonically_increasing_id() + F.lit(base.next_seq)).alias("seq"), F.when(~tomb, F.col("value")).otherwise("").alias("value"), tomb.alias("tomb"))
        name = f"log/batch-{base.number + 1:012d}-{uuid.uuid4().hex[:8]}"
        nulls = F.count_if(F.col("key").isNull() | F.col("value").isNull())
        seen = self._write(ops, name, CHECKSUMS, top=F.max("seq"), user=F.sum(user_bytes()), held=F.sum(key_value_bytes()), nulls=nulls)
        if seen["nulls"]:
            self.storage.delete(name)
            raise InvalidArgument("keys and values can't be null")
        if seen["top"] is None and token is None:
            self.storage.delete(name)
            return self
        top = base.next_seq if seen["top"] is None else seen["top"] + 1

        def change(v: Version) -> Version:
            if v.next_seq != base.next_seq or token is not None and token in v.tokens:
                raise ConflictError("another writer appended first")
            batch = Batch(v.number + 1, name, seen["held"] or 0, token)
            tokens = dict(sorted((v.tokens | ({token: batch.number} if token is not None else {})).items(), key=lambda t: t[1])[-self.options.keep_tokens :])
            return v.next(batches=(*v.batches, batch), next_seq=top, user_bytes=v.user_bytes + (seen["user"] or 0), tokens=tokens)

        self._commit(change)
        if sum(b.bytes for b in self.version.batches) >= self.options.memtable_flush_threshold:
            self.flush()
        return self

    def flush(self) -> KVTable:
        """Write what the log holds as one flush of level 0, one row per key with its tombstones; more than fits a file becomes several with disjoint keys."""
        batches = self.version.batches
        if not batches:
            return self
        ops = merge.newest_wins(self._read([b.path for b in batches]))
        held = sum(b.bytes for b in batches)
        files, raw = self._write_files(ops, 0, -(-held // max(self.options.target_file_size, self.options.memtable_flush_threshold)), held)

        def change(v: Version) -> Version:
            if not set(batches) <= set(v.batches):
                raise ConflictError("another writer flushed first")
            return v.next(batches=tuple(b for b in v.batches if b not in batches), flush_bytes=v.flush_bytes + raw, **_numbered(v, v.files, files))

        self._commit(change)
        return self

    def _write(self, df: DataFrame, name: str, options: dict[str, str], **seen: Column) -> dict[str, object]:
        """Write ``df`` and return what is ``seen`` of its rows meanwhile, so that nothing is read again for it."""
        spy = Observation()
        df.observe(spy, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in seen.items())).write.options(**options).parquet(self.storage.uri(name))
        return {k: spy.get.get(k) for k in seen}

    def _write_files(self, ops: DataFrame, level: int, parts: int, held: int) -> tuple[list[FileMeta], int]:
        """Sorted files with disjoint keys, and the bytes of their records. Their bounds come from one pass over the written keys."""
        name = f"runs/{self.version.number + 1:012d}-{uuid.uuid4().hex[:8]}"
        parts = max(1, int(parts))
        # About as many keys as a file of the target size holds; a filter for more would outweigh a small file.
        keys = max(64, -(-held // parts) // 32)
        wanted = {"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.expected.ndv#key": str(keys), "parquet.bloom.filter.fpp#key": str(max(1e-6, 0.6185 ** self.options.bloom_bits_per_key)), **CHECKSUMS}
        placed = ops.select("key", "seq", "value", "tomb")
        placed = (placed.repartitionByRange(parts, "key") if parts > 1 else placed.repartition(1)).sortWithinPartitions("key")
        seen = self._write(placed, name, wanted, raw=F.sum((key_value_bytes() + RECORD_HEADER).cast("bigint")))
        sizes = {f: s for f, s in self.storage.list(name) if f.endswith(".parquet")}
        bounds = self._read([name]).groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count(F.lit(1)).alias("n"))
        # A row per file; the numbers come with the version that is published.
        return [FileMeta(0, level, r["lo"], r["hi"], sizes[r["file"]], r["n"], f"{name}/{r['file']}") for r in sorted(bounds.collect(), key=lambda r: r["lo"])], seen["raw"] or 0

    # ---- compaction

    def needs_compaction(self) -> bool:
        return compaction.needs(self.version, self.options)

    def compact_once(self) -> bool:
        task = compaction.pick(self.version, self.options)
        if task is None:
            return False
        base = self.version
        held = sum(f.bytes for f in task.inputs)
        merged = merge.newest_wins(self._read([f.path for f in task.inputs]), keep_tombstones=not task.bottommost)
        files, raw = self._write_files(merged, task.target, -(-held // self.options.target_file_size), held)
        gone = {f.path for f in task.inputs}
        there = {f.path for f in base.files}

        def change(v: Version) -> Version:
            new = [f for f in v.files if f.path not in there and f.level > 0]
            clash = any(f.level == task.target and files and f.overlaps(files[0].smallest, files[-1].largest) for f in new)
            if not gone <= {f.path for f in v.files} or clash or task.bottommost and v.deepest() > max(task.target, base.deepest()):
                raise ConflictError("another writer merged these files first")
            return v.next(compaction_bytes=v.compaction_bytes + raw, **_numbered(v, [f for f in v.files if f.path not in gone], files))

        self._commit(change)
        return True

    def compact(self) -> int:
        """Merge until no level is over its budget."""
        n = 0
        while self.compact_once():
            n += 1
        return n

    # ---- reading

    def _read(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], op_schema())
        return self.spark.read.schema(op_schema()).options(**VERIFY).parquet(*(self.storage.uri(n) for n in names))

    def ops(self, start: str | None = None, end: str | None = None) -> DataFrame:
        """All stored operations of files that may hold keys of ``[start, end)``."""
        names = [b.path for b in self.version.batches] + [f.path for f in self.version.files if f.holds(start, end)]
        return self._read(names)

    def scan(self, start: str | None = None, end: str | None = None, limit: int | None = None) -> DataFrame:
        return merge.scan(self.ops(start, end), start, end, limit=limit)

    def get(self, key: str) -> tuple[str, str | None]:
        names = [b.path for b in self.version.batches] + [f.path for f in self.version.files if f.smallest <= key <= f.largest]
        return merge.get(self._read(names), key)

    def multi_get(self, probe: DataFrame, few: int = 1000) -> DataFrame:
        """``key``, ``status`` and ``value`` for every row of ``probe``. Only files that may hold a key are read; up to ``few`` distinct keys
        go to the files themselves as a filter, which their row groups' bounds and bloom filters answer."""
        asked = probe.where(F.col("key").isNotNull()).select("key")
        keys = sorted(r["key"] for r in asked.distinct().limit(few + 1).collect())
        if len(keys) <= few:
            holds = lambda f: (i := bisect_left(keys, f.smallest)) < len(keys) and keys[i] <= f.largest
        else:
            low, high = asked.agg(F.min("key"), F.max("key")).first()
            holds = lambda f: f.overlaps(low, high)
        found = self._read([b.path for b in self.version.batches] + [f.path for f in self.version.files if holds(f)] if keys else [])
        return merge.multi_get(found.where(F.col("key").isin(keys)) if len(keys) <= few else found, probe)

    # ---- upkeep

    def stats(self) -> DataFrame:
        v = self.version
        levels = [v.level(n) for n in range(v.deepest() + 1)]
        ratio = (v.flush_bytes + v.compaction_bytes) / v.user_bytes if v.user_bytes else 0.0
        row = (v.user_bytes, v.flush_bytes, v.compaction_bytes, v.flush_bytes + v.compaction_bytes, ratio, [len(x) for x in levels], [sum(f.bytes for f in x) for x in levels])
        return self.spark.createDataFrame([row], "user_bytes bigint, flush_bytes bigint, compaction_bytes bigint, sstable_bytes_written bigint, write_amplification double, files_per_level array<int>, bytes_per_level array<bigint>")

    def levels_with_data(self) -> int:
        return len({f.level for f in self.version.files})

    def orphans(self) -> list[str]:
        """Folders of runs and log batches that none of the versions still kept names."""
        keep = set()
        for n in manifest.published(self.storage)[-self.options.keep_versions :]:
            v = Version.loads(self.storage.read(manifest.name_of(n)))
            keep |= {f.path.rpartition("/")[0] for f in v.files} | {b.path for b in v.batches}
        there = [f"{top}/{name}" for top in ("runs", "log") for name, _ in self.storage.list(top)]
        return [x for x in there if x not in keep]

    def remove_orphans(self) -> int:
        gone = self.orphans()
        for name in gone:
            self.storage.delete(name)
        for n in manifest.published(self.storage)[: -self.options.keep_versions]:
            self.storage.delete(manifest.name_of(n))
        return len(gone)

    def _commit(self, change: Callable[[Version], Version], attempts: int = 50) -> None:
        """Publish ``change`` of the newest version; it raises ``ConflictError`` where what others published meanwhile rules it out."""
        for _ in range(attempts):
            try:
                self.version = manifest.commit(self.storage, change(self.version))
                return
            except ConflictError:
                newest = manifest.load(self.storage)
                if newest.number == self.version.number:
                    raise
                self.version = newest
        raise ConflictError("other writers were faster each time")


def _numbered(v: Version, kept, files: list[FileMeta]) -> dict[str, object]:
    """The files of a version with new ones, which get its next numbers."""
    return {"files": (*kept, *(replace(f, number=v.next_file + i) for i, f in enumerate(files))), "next_file": v.next_file + len(files)}
