"""Best-fit packing of token pieces into sequences, improved by swap-based local search.

Only lengths matter for the plan, and there are at most ``capacity`` of them, so
the plan is made over the histogram of lengths, whatever the number of pieces.
A *class* is a number of bins with the same contents. Best fit decreasing places
the histogram; local search then takes documents out of the emptiest bin by
moves, one-for-one and two-for-one exchanges with other underfull bins. Each
step makes the sum of squared fills larger, until bins are empty or no step is
left. The pieces are then numbered within their length, and each number range
maps to a sequence and an offset.

Defined cases: a null or empty text has the end id alone and is packed like any
other; repeated rows are packed once each; an empty table gives no rows; a null
``doc_id`` is kept; columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, save, table
from .encoding import default_path, encoder

CAPACITY = 2048
END = b"\0\0\0\0"
#: Pieces of a length that are numbered by one task, and the most such parts that there are besides one a length.
PART_PIECES, MOST_PARTS = 1000, 200_000
#: Below any room a bin can have.
NONE = -(1 << 40)

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The ids of every document, cut into pieces of ``capacity`` where there are more; the first piece takes the rest."""

    def run(batch):
        rows = {n: [] for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
        encode = encoder(tokenizer).encode_all
        for doc, ids in zip(batch.column(0).to_pylist(), encode([t or "" for t in batch.column(1).to_pylist()])):
            ids = memoryview(ids + END)
            n, at, k = len(ids) // 4, 0, 0
            while at < n:
                to = at + ((n - at) % capacity or capacity) if at == 0 else at + capacity
                for name, v in zip(rows, (doc, k, at, to - at, zlib.crc32(ids[4 * at : 4 * to]))):
                    rows[name].append(v)
                at, k = to, k + 1
        yield rows

    return arrow_map(docs, ["doc_id", "text"], PIECES, run)


class Partners:
    """Underfull classes by the sizes they hold, for classes looked at from the emptiest on.

    For each size, and for 0 (nothing is taken back), the class with most room among those at least as full as the one looked at
    is at hand. One emptier than that is not, until the next pass.
    """

    def __init__(self, capacity: int, count: dict[tuple, int]):
        self.capacity, self.count = capacity, count
        self.by_size: list[list] = [[] for _ in range(capacity + 1)]
        self.sizes = np.arange(capacity + 1)
        self.room = np.full(capacity + 1, NONE)  # by size: most room in the heap of the size
        for k in count:
            if sum(k) < capacity:
                self.add(k)

    def add(self, key: tuple) -> None:
        free = self.capacity - sum(key)
        for y in (0, *dict.fromkeys(key)):
            heappush(self.by_size[y], (-free, key))
            self.room[y] = max(self.room[y], free)

    def _tidy(self, y: int, most: int, but: tuple | None) -> None:
        """Classes of size ``y`` that are gone or emptier than ``most`` leave the heap, and ``but`` does for now."""
        heap = self.by_size[y]
        while heap and (-heap[0][0] > most or heap[0][1] not in self.count or heap[0][1] == but):
            heappop(heap)
        self.room[y] = -heap[0][0] if heap else NONE

    def best(self, low: tuple) -> tuple[tuple, tuple, tuple] | None:
        """The move, one-for-one or two-for-one exchange that takes most tokens out of ``low``: (class, given sizes, taken sizes)."""
        most = self.capacity - sum(low)
        but = low if self.count[low] == 1 else None
        for y in np.flatnonzero(self.room > most).tolist():
            self._tidy(y, most, but)
        if but:
            for y in (0, *dict.fromkeys(low)):
                self._tidy(y, most, but)
        one = np.array(list(dict.fromkeys(low)))
        pairs = one[:, None] + one
        twice = np.array([low.count(x) > 1 for x in one.tolist()])
        pairs[np.diag_indices(len(one))] = np.where(twice, 2 * one, 0)
        sums = np.unique(np.concatenate([one, pairs.ravel()]))
        sums = sums[sums > 0]
        while True:
            # The least y for which a class that holds it has room for sum - y.
            reach = np.maximum.accumulate(self.room + self.sizes)
            takes = np.searchsorted(reach, sums)
            gains = sums - takes
            gains[(takes > self.capacity) | (gains <= 0)] = 0
            at = int(np.argmax(gains))
            y = int(takes[at])
            if not gains[at] or self.by_size[y][0][1] in self.count:
                break
            self._tidy(y, most, but)  # a class that is gone
        step = None
        if gains[at]:
            d = int(sums[at])
            give = (d,) if d in low else next((x, d - x) for x in low if d - x in low and (2 * x != d or low.count(x) > 1))
            step = (self.by_size[y][0][1], give, (y,) if y else ())
        if but:
            self.add(low)
        return step


class Plan:
    """Bins by class: ``classes`` holds ``[free, count, sizes]`` with ``sizes`` ascending."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        self.least = -(-sum(s * n for s, n in histogram.items()) // capacity)
        self.classes = self._best_fit(histogram)

    def bins(self) -> int:
        return sum(c[1] for c in self.classes)

    def _best_fit(self, histogram: dict[int, int]) -> list[list]:
        """Best fit decreasing, all items of a size and all like bins at a time."""
        done, opened = [], []  # opened: (free, serial, count, contents), ascending
        serial = 0

        def keep(free: int, count: int, contents: tuple) -> None:
            nonlocal serial
            serial += 1
            if count:
                insort(opened, (free, serial, count, contents)) if free else done.append((free, serial, count, contents))

        for size in sorted(histogram, reverse=True):
            n = histogram[size]
            while n:
                k = bisect_left(opened, (size,))
                free, _, count, contents = opened.pop(k) if k < len(opened) else (self.capacity, 0, n, ())
                each = free // size
                full = min(count, n // each)
                keep(free - each * size, full, (*contents, (size, each)))
                n -= full * each
                rest = n if full < count else 0
                if rest:
                    keep(free - rest * size, 1, (*contents, (size, rest)))
                    n = 0
                if contents:
                    keep(free, count - full - bool(rest), contents)
        return [[free, count, sorted(s for s, k in held for _ in range(k))] for free, _, count, held in (*done, *opened)]

    def improve(self, scans: int | None = None) -> int:
        """Take documents out of the emptiest bins until no step is left or the lower bound is met; with ``scans``, after so many looks at most.

        Every step raises the sum of squared fills, as it takes tokens from a bin to one at least as full. It is done in as many like
        bins at once as there are. Classes are looked at in passes from the emptiest on, and the last pass finds no step for any.
        Returns the number of bins saved.
        """
        before, count = self.bins(), {}
        for _, n, sizes in self.classes:
            count[tuple(sizes)] = count.get(tuple(sizes), 0) + n
        bins, changed = sum(count.values()), True
        while changed and bins > self.least and scans != 0:
            changed, partners = False, Partners(self.capacity, count)
            left = [(-free, k) for k in count if (free := self.capacity - sum(k))]
            heapify(left)
            while left and bins > self.least and scans != 0:
                low = heappop(left)[1]
                if low not in count:
                    continue
                scans = scans and scans - 1
                step = partners.best(low)
                if step is None:
                    continue
                changed = True
                high, give, take = step
                n = count[low] // 2 if high == low else min(count[low], count[high])
                for key, out, into in ((low, give, take), (high, take, give)):
                    count[key] -= n
                    if not count[key]:
                        del count[key]
                    sizes = list(key)
                    for x in out:
                        sizes.remove(x)
                    new = tuple(sorted([*sizes, *into]))
                    if not new:
                        bins -= n
                        continue
                    count[new] = count.get(new, 0) + n
                    if free := self.capacity - sum(new):
                        partners.add(new)
                        heappush(left, (-free, new))
                if low in count:
                    heappush(left, (sum(low) - self.capacity, low))
        self.classes = [[self.capacity - sum(k), n, list(k)] for k, n in count.items()]
        return before - bins

    def slots(self) -> list[tuple[int, int, int, int, int, int]]:
        """``(length, low, high, per bin, first sequence, offset)``: the pieces numbered low to high (exclusive) of a length fill
        their bins in turn, so many to a bin from that offset on."""
        used, base, out = {}, 0, []
        for _, count, sizes in self.classes:
            at, k = 0, 0
            while k < len(sizes):
                size, same = sizes[k], 1
                while k + same < len(sizes) and sizes[k + same] == size:
                    same += 1
                low = used.get(size, 0)
                used[size] = low + same * count
                out.append((size, low, used[size], same, base, at))
                at += size * same
                k += same
            base += count
        return out


def numbered(pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """``pieces`` with ``number``, from 0 within each length. A frequent length is numbered in parts, so that none is one task's."""
    # A part has so many pieces, and all lengths together MOST_PARTS and one each at most.
    each = max(PART_PIECES, -(-sum(histogram.values()) // MOST_PARTS))
    split = {length: -(-n // each) for length, n in histogram.items() if n > each}
    parts = F.coalesce(F.create_map(*(F.lit(x) for kv in split.items() for x in kv))[F.col("length")], F.lit(1)) if split else F.lit(1)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), parts))
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(inner) - 1)
    return ranked.join(F.broadcast(bases), ["length", "_salt"]).withColumn("number", F.col("_base") + F.col("_rank")).drop("_salt", "_rank", "_base")


def pack(pieces: DataFrame, capacity: int = CAPACITY, scans: int | None = None) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table of pieces (as ``PIECES``) that can be read again at no great cost."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    plan = Plan(histogram, capacity)
    plan.improve(scans)
    slots = spark.createDataFrame(plan.slots(), "length bigint, low bigint, high bigint, per_bin bigint, base bigint, at bigint")
    place = F.col("number") - F.col("low")
    joined = numbered(pieces, histogram).join(F.broadcast(slots), "length").where((F.col("number") >= F.col("low")) & (F.col("number") < F.col("high")))
    return joined.select(
        *(c for c in pieces.columns),
        (F.col("base") + F.floor(place / F.col("per_bin"))).cast("bigint").alias("sequence_id"),
        (F.col("at") + (place % F.col("per_bin")) * F.col("length")).cast("bigint").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack ``docs``: one row per piece. The pieces are written once to the shared folder."""
    return pack(save(token_pieces(docs, tokenizer or default_path(), capacity), "pieces"), capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
