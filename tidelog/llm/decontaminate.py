"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared in lower case with each run of white space as one
space. An item of ``m`` characters may be found with up to ``k = floor(rate *
m)`` edits anywhere in a text. It is split into ``k + 1`` pieces: ``k`` edits
can't touch them all, so every match holds a piece unchanged. All pieces are
found in one pass by an automaton; around each hit Myers' bit-parallel distance
decides.

Items of up to ``BLOCK_CHARS`` characters go to all executors. More of them are
not broadcast: pieces and texts then meet in a join (see ``by_pieces``), which
finds the same matches in one scan of the documents.

Defined cases: null and empty texts hold nothing; null and empty items are found
nowhere; repeated items and documents are reported once each as often as they
are there; of several places with the least distance the first counts; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, gram_hashes, mix, save, slices, table, unused

#: Edits allowed for each character of an item.
RATE = 0.05
#: Most characters of items that are sent to the executors.
BLOCK_CHARS = 4_000_000
#: Numbers of a piece's characters that are looked up, and bits of the map of their hashes.
ANCHORS = (1, 2, 3, 4, 6, 8, 12, 16)
BITMAP_BITS = 1 << 27

FOUND = "doc_id bigint, item_id bigint, distance int, end bigint"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, rate: float = RATE) -> list[tuple[int, str]]:
    """``floor(rate * length) + 1`` pieces of an item, with their places."""
    n = int(rate * len(item)) + 1
    at = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(at, at[1:])]


def myers(pattern: str, text: str, masks: dict[str, int] | None = None) -> tuple[int, int]:
    """The least edit distance of ``pattern`` to a substring of ``text``, and where the first such substring ends."""
    m = len(pattern)
    masks = masks if masks is not None else letter_masks(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, at = m, 0
    for i, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        x = eq | down
        d0 = ((((x & up) + up) ^ up) | x) & full
        hp = down | (full & ~(d0 | up))
        hn = up & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = (hp << 1) & full
        hn = (hn << 1) & full
        up = hn | (full & ~(d0 | hp))
        down = hp & d0
        if score < best:
            best, at = score, i
    return best, at


def letter_masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Matcher:
    """Finds ``items`` (id and normal text) in normal texts."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float = RATE):
        import ahocorasick

        self.items = [(i, t, letter_masks(t), int(rate * len(t))) for i, t in items if t]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, _, _) in enumerate(self.items):
            for at, piece in pieces(t, rate):
                places.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int | None, int, int]]:
        """``(item id, least distance, end of the first such match)`` of every item found."""
        if not self.items or not text:
            return []
        spans: dict[int, list[tuple[int, int]]] = {}
        for last, (size, where) in self.automaton.iter(text):
            for k, at in where:
                begin = last + 1 - size - at
                spans.setdefault(k, []).append((begin, begin + len(self.items[k][1])))
        out = []
        for k, found in spans.items():
            item_id, item, masks, budget = self.items[k]
            best = (budget + 1, 0)
            exact = text.find(item) if len(found) > 1 or budget == 0 else -1
            if exact >= 0:
                best = (0, exact + len(item))
            else:
                merged: list[list[int]] = []
                for a, b in sorted((max(0, a - budget), b + budget) for a, b in found):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                for a, b in merged:
                    distance, end = myers(item, text[a:b], masks)
                    best = min(best, (distance, a + end))
            if best[0] <= budget:
                out.append((item_id, *best))
        return out


def _block(items: DataFrame, limit: int) -> list | None:
    """The items as ``(id, normal text)`` if they have at most ``limit`` characters, else none."""
    total = items.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    return [(r["item_id"], normal(r["text"])) for r in items.where(F.col("text").isNotNull()).select("item_id", "text").collect()] if total <= limit else None


def matches(docs: DataFrame, items: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id``, ``item_id``, ``distance`` and ``end`` (in the normal text) of every item that a document holds."""
    block = _block(items, block_chars)
    if block is not None:
        return _scan(docs, docs.sparkSession.sparkContext.broadcast(block), rate)
    found, numbered = by_pieces(docs, items, rate)
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", _key(F.col("text")).alias("key"))
    return rows.join(found, "key").join(numbered.select("item", "item_id"), "item").select("doc_id", "item_id", "distance", "end")


def _scan(docs: DataFrame, sent, rate: float) -> DataFrame:
    key = uuid.uuid4().hex

    def run(batch):
        matcher = _matcher(key, sent, rate)
        rows = [(d, *hit) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for hit in matcher.find(normal(t))]
        if rows:
            yield dict(zip(("doc_id", "item_id", "distance", "end"), map(list, zip(*rows))))

    return arrow_map(docs, ["doc_id", "text"], FOUND, run)


_matchers: dict = {}


def _matcher(key, sent, rate: float) -> Matcher:
    if (key, rate) not in _matchers:
        _matchers.clear()
        _matchers[key, rate] = Matcher(sent.value, rate)
    return _matchers[key, rate]


def _key(text):
    return F.sha2(text.cast("binary"), 256)


def anchor_size(n: int) -> int:
    """How many of a piece's first characters are looked up: few sizes, so that a text is hashed few times."""
    return max(w for w in ANCHORS if w <= n)


def anchor_hashes(text: str, size: int) -> np.ndarray:
    """A hash of the ``size`` characters at each place of ``text``."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return gram_hashes(mix(chars + np.uint64(0x9E3779B97F4A7C15)), size) ^ np.uint64(size)


def by_pieces(docs: DataFrame, items: DataFrame, rate: float) -> tuple[DataFrame, DataFrame]:
    """``key`` (of a text), ``item``, ``distance`` and ``end`` of every match, and ``item``, ``item_id`` and ``norm`` of the items.

    For items of any size: pieces and places of the texts meet in a join on the hash of a piece's first characters. A bitmap of fixed size
    drops places that no piece has; the rest carry only a hash and a place. Hits give windows of a text, in which Myers' distance decides.
    """
    spark = docs.sparkSession
    numbered = save(_normal_items(items.where(F.col("text").isNotNull())).where("norm <> ''").withColumn("item", F.monotonically_increasing_id()), "items")

    def cut(batch):
        rows = [(i, int(anchor_hashes(p, w := anchor_size(len(p)))[:1].view(np.int64)[0]), w, at) for i, t in zip(*(c.to_pylist() for c in batch.columns)) for at, p in pieces(t, rate)]
        yield dict(zip(("item", "hash", "size", "at"), map(list, zip(*rows))))

    cuts = save(arrow_map(numbered, ["item", "norm"], "item bigint, hash bigint, size int, at int", cut), "pieces")
    bits = F.pmod("hash", F.lit(BITMAP_BITS)) + 1
    bitmap = np.zeros(BITMAP_BITS // 8, np.uint8)
    # At most BITMAP_BITS / 32768 rows of 4 KB.
    for r in cuts.groupBy(F.bitmap_bucket_number(bits).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bits)).alias("m")).collect():
        bitmap[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["m"], np.uint8)
    sizes = [r["size"] for r in cuts.select("size").distinct().collect()]  # at most len(ANCHORS)
    sent = spark.sparkContext.broadcast(bitmap)

    def look(batch):
        out: dict[str, list] = {"key": [], "norm": [], "hash": [], "place": []}
        for key, text in zip(batch.column(0).to_pylist(), map(normal, batch.column(1).to_pylist())):
            for size in sizes:
                h = anchor_hashes(text, size)
                bit = (h.view(np.int64) % BITMAP_BITS).astype(np.int64)
                places = np.flatnonzero(sent.value[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                if len(places):
                    out["key"] += [key] * len(places)
                    out["norm"] += [None] * len(places)
                    out["hash"] += h[places].view(np.int64).tolist()
                    out["place"] += places.tolist()
            if out["key"] and out["key"][-1] == key:
                for name, value in (("key", key), ("norm", text), ("hash", None), ("place", None)):
                    out[name].append(value)
        yield out

    keyed = docs.where(F.col("text").isNotNull()).select(_key(F.col("text")).alias("key"), "text")
    seen = save(arrow_map(keyed, ["key", "text"], "key string, norm string, hash bigint, place bigint", look, text="text"), "places")
    hits = seen.where("hash is not null").select("key", "hash", "place").distinct().join(cuts, "hash").select("key", "item", (F.col("place") - F.col("at")).alias("begin")).distinct()
    n = F.length("norm")
    budgets = numbered.select("item", F.col("norm").alias("sought"), F.floor(F.lit(rate) * n).alias("budget"))
    placed = hits.join(budgets, "item").withColumn("from", F.greatest(F.lit(0), F.col("begin") - F.col("budget")))
    texts = seen.where("norm is not null").groupBy("key").agg(F.any_value("norm").alias("norm"))
    till = F.col("begin") + F.length("sought") + F.col("budget")
    windows = placed.join(texts, "key").select("key", "item", "sought", "budget", "from", F.col("norm").substr((F.col("from") + 1).cast("int"), (till - F.col("from")).cast("int")).alias("window"))

    def decide(batch):
        rows = []
        for key, item, sought, budget, start, window in zip(*(c.to_pylist() for c in batch.columns)):
            distance, end = myers(sought, window)
            if distance <= budget:
                rows.append((key, item, distance, start + end))
        if rows:
            yield dict(zip(("key", "item", "distance", "end"), map(list, zip(*rows))))

    judged = arrow_map(windows, windows.columns, "key string, item bigint, distance int, end bigint", decide, text="window")
    best = judged.groupBy("key", "item").agg(F.min(F.struct("distance", "end")).alias("best")).select("key", "item", "best.*")
    return save(best, "found"), numbered


def _normal_items(items: DataFrame) -> DataFrame:
    def run(batch):
        yield {"item_id": batch.column(0), "norm": list(map(normal, batch.column(1).to_pylist()))}

    return arrow_map(items.select(F.col("item_id").cast("bigint").alias("item_id"), "text"), ["item_id", "text"], "item_id bigint, norm string", run)


def clean(docs: DataFrame, items: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold no item, with all their columns; rows are judged by their own text."""
    block = _block(items, block_chars)
    if block is None:
        found, _ = by_pieces(docs, items, rate)
        (key,) = unused(docs, "_key")
        return docs.withColumn(key, _key(F.col("text"))).join(found.select(F.col("key").alias(key)).distinct(), key, "left_anti").select(*docs.columns)
    sent, key = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex
    at = docs.columns.index("text")

    def run(batches):
        matcher = _matcher(key, sent, rate)
        for batch in batches:
            for part in slices(batch):
                keep = [not matcher.find(normal(t)) for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(np.array(keep, bool)))

    return docs.mapInArrow(run, docs.schema)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
