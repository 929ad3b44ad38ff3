"""Removal of repeated passages by suffix trees over prefix groups of suffixes.

A *window* is ``width`` consecutive words of a document, the first words of a
suffix. Words that lie in a window whose sequence starts anywhere else too are
removed.

Suffixes are split by prefixes of varying length. The first cut is the window's
least 8-word hash (its *anchor*): equal windows have equal anchors at equal
offsets, and suffixes with one anchor stand together in a document, so they
travel as one *segment* of words rather than as a row each. Anchors that occur
once fall out. Equal segments are counted and travel once; windows of a segment
that occurs more than once are repeats. What is left has an anchor with several
different segments:

- up to ``GROUP`` segments, they are one group;
- beyond, its suffixes are dealt by their own first 8 words, and where more than
  ``GROUP`` have the same, by their first 16, 24 and 32; what is then still too
  large is dealt by the whole window, and such a group is one node, which needs a
  count of its suffixes only.

For each group, which fits a task's memory, the suffix tree is built: the order
of its suffixes by prefix doubling, and the length of the common prefix of
neighbours in that order. Suffixes between which it never falls below ``width``
hang under one internal node of that depth, and a node with two or more suffixes
makes its windows repeats.

Defined cases: a null text has no words; a text shorter than a window keeps all;
repeated rows repeat each other; a null ``doc_id`` is a document like others; an
empty table gives no rows; other columns are ignored. Words are told apart by
64-bit hashes.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _INVERSE, _MULTIPLIER, arrow_map, as_long, cut_words, gram_hashes, mix, powers, save, table, word_hashes

WIDTH, PREFIX = 35, 8
#: Lengths of the prefixes that split the suffixes of a frequent anchor.
LENGTHS = (8, 16, 24, 32)
#: Segments or suffixes of one group, and of one task's batch of groups.
GROUP, BATCH = 2000, 4000


def least_start(grams: np.ndarray, span: int) -> np.ndarray:
    """For each place the first of the least of ``span`` entries from there."""
    best, reach = np.arange(len(grams)), 1
    pick = lambda a, b: np.where(grams[b] < grams[a], b, a)
    while reach * 2 <= span:
        best, reach = pick(best[:-reach], best[reach:]), reach * 2
    return pick(best[: len(best) - (span - reach)], best[span - reach :]) if span > reach else best


def segments(texts, width: int) -> dict[str, np.ndarray]:
    """For each anchor of each text: ``doc``, ``low`` (first window), ``n`` (windows), ``gram`` and ``segment`` hashes."""
    w = cut_words(texts)
    h, doc, size = word_hashes(w), w.of(), min(PREFIX, width)
    start = np.flatnonzero(doc[: len(h) - width + 1] == doc[width - 1 :]) if len(h) >= width else np.zeros(0, np.int64)
    if not len(start):
        return {k: np.zeros(0, np.int64) for k in ("doc", "low", "n", "gram", "segment")}
    grams = gram_hashes(h, size)
    anchor = least_start(grams, width - size + 1)[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    low, anchor, n = start[new], anchor[new], np.diff(np.append(np.flatnonzero(new), len(start)))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(len(h), _MULTIPLIER), dtype=np.uint64)])
    whole = mix((total[low + n + width - 1] - total[low]) * powers(len(h), _INVERSE)[low])
    shape = (anchor - low).astype(np.uint64) * np.uint64(width) + n.astype(np.uint64)
    return {"doc": doc[low], "low": low - w.first[doc[low]], "n": n, "gram": as_long(grams[anchor]), "segment": as_long(mix(whole ^ mix(shape)))}


class SuffixTree:
    """The suffix tree of strings of words, as the order of some of its suffixes and their common prefixes.

    ``leaves`` has the places (in all strings one after another) of the suffixes in order, and ``common`` for each but the
    first how many words it shares with the one before. The internal nodes are the runs of leaves that share more than
    their neighbours outside.
    """

    def __init__(self, strings: list[np.ndarray], places: np.ndarray):
        size = np.array([len(x) for x in strings], np.int64)
        ends = np.cumsum(size + 1) - 1  # each string has an end of its own, which equals nothing
        rank = np.zeros(len(size) + size.sum(), np.int64)
        inside = np.ones(len(rank), bool)
        inside[ends] = False
        words, rank[inside] = np.unique(np.concatenate(strings) if len(size) else np.zeros(0, np.uint64), return_inverse=True)
        rank[ends] = len(words) + np.arange(len(size))
        ranks, reach, longest = [rank], 1, int(size.max(initial=0)) + 1
        while reach < longest:  # prefix doubling
            after = np.zeros(len(rank), np.int64)
            after[: len(rank) - reach] = rank[reach:] + 1
            rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1]
            ranks.append(rank)
            reach *= 2
        at = places + np.repeat(np.arange(len(size)), size)[places] if len(size) else places
        order = np.argsort(rank[at])
        self.leaves, at = places[order], at[order]
        a, b, self.common = at[:-1].copy(), at[1:].copy(), np.zeros(max(0, len(at) - 1), np.int64)
        for k in reversed(range(len(ranks))):
            same = ranks[k][np.minimum(a, len(rank) - 1)] == ranks[k][np.minimum(b, len(rank) - 1)]
            self.common += same << k
            a, b = a + (same << k), b + (same << k)

    def nodes(self, depth: int) -> np.ndarray:
        """For each leaf in order the number of its outermost internal node of so many words, or of the leaf itself."""
        return np.concatenate([np.zeros(1, np.int64), np.cumsum(self.common < depth)]) if len(self.leaves) else np.zeros(0, np.int64)


def deep_nodes(contents: list[np.ndarray], copies: np.ndarray, width: int) -> np.ndarray:
    """For each segment of a batch of groups a bit per window, set where its node has two or more suffixes."""
    size = np.array([len(c) for c in contents], np.int64)
    windows = size - width + 1
    owner = np.repeat(np.arange(len(size)), windows)
    bit = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    tree = SuffixTree(contents, np.repeat(np.cumsum(size) - size, windows) + bit)
    leaf = np.searchsorted(np.cumsum(size), tree.leaves, side="right")
    bit = (tree.leaves - (np.cumsum(size) - size)[leaf]).astype(np.uint64)
    node = tree.nodes(width)
    shared = np.bincount(node, copies[leaf].astype(float))[node] >= 2 if len(node) else np.zeros(0, bool)
    masks = np.zeros(len(size), np.uint64)
    np.bitwise_or.at(masks, leaf[shared], np.uint64(1) << bit[shared])
    return masks


def trees(groups: DataFrame, width: int) -> DataFrame:
    """``segment`` and ``mask`` of every row of ``groups`` (``bin``, ``segment``, ``bit``, ``copies``, ``words``), the tree built bin by bin.
    ``bit`` is the place in its segment of the first window."""

    def run(batch: pa.Table) -> pa.Table:
        batch = batch.combine_chunks()
        contents = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("words")]
        masks = deep_nodes(contents, batch.column("copies").to_numpy(), width) << batch.column("bit").to_numpy().astype(np.uint64)
        return pa.table([batch.column("segment"), pa.array(as_long(masks))], names=["segment", "mask"])

    return groups.groupBy("bin").applyInArrow(run, "segment bigint, mask bigint")


def binned(group, rows: DataFrame):
    """A number of a batch of groups, of about ``BATCH`` of ``rows`` each."""
    return F.pmod(F.xxhash64(group), F.lit(max(1, -(-rows.count() // BATCH)))).alias("bin")


def split(content: DataFrame, width: int, most: int) -> DataFrame:
    """``segment`` and ``mask`` for anchors with too many segments (``content``: ``segment``, ``copies``, ``words``): the suffixes are dealt
    by their own prefixes, lengthened until each group has at most ``most``."""
    lengths = [n for n in LENGTHS if n < width]
    names = [f"p{n}" for n in lengths]

    def suffixes(batch):
        for segment, copies, raw in zip(*(c.to_pylist() for c in batch.columns)):
            words = np.frombuffer(raw, np.uint64)
            n = len(words) - width + 1
            yield {p: as_long(gram_hashes(words, k)[:n]) for p, k in zip(names, lengths)} | {"window": as_long(gram_hashes(words, width)), "segment": np.full(n, segment), "bit": np.arange(n), "copies": np.full(n, copies)}

    rest = save(arrow_map(content, ["segment", "copies", "words"], ", ".join(f"{p} bigint" for p in names) + ", window bigint, segment bigint, bit int, copies bigint", suffixes), "suffixes")
    dealt = []
    for p in names:
        # Counts are combined before the shuffle and saved, so that the joins are of plain tables and Spark can split a frequent prefix.
        counts = save(rest.groupBy(p).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "prefixes")
        dealt.append(rest.join(counts.where(F.col("n") <= most), p, "left_semi").select(F.xxhash64(F.lit(p), p).alias("group"), "segment", "bit"))
        larger = counts.where(F.col("n") > most)
        if not larger.limit(1).count():
            rest = None
            break
        rest = save(rest.join(larger, p, "left_semi"), "suffixes")
    fitting = save(reduce(DataFrame.unionByName, dealt).groupBy("segment").agg(F.collect_list(F.struct("group", "bit")).alias("w")), "dealt")  # at most 63 windows
    held = content.join(fitting, "segment").select("segment", "copies", "words", F.col("w.group").alias("group"), F.col("w.bit").alias("bit"))

    def windows(batch):
        segment, copies, raw, group, bit = (c.to_pylist() for c in batch.columns)
        for i in range(len(segment)):
            yield {"group": group[i], "segment": [segment[i]] * len(bit[i]), "bit": bit[i], "copies": [copies[i]] * len(bit[i]), "words": [raw[i][8 * k : 8 * (k + width)] for k in bit[i]]}

    rows = save(arrow_map(held, ["segment", "copies", "words", "group", "bit"], "group bigint, segment bigint, bit int, copies bigint, words binary", windows), "windows")
    out = trees(rows.select(binned("group", rows), "segment", "bit", "copies", "words"), width)
    if rest is not None:
        nodes = save(rest.groupBy("window").agg(F.sum("copies").alias("suffixes")).where("suffixes > 1").select("window"), "nodes")
        out = out.unionByName(rest.join(nodes, "window", "left_semi").select("segment", F.expr("shiftleft(1L, bit)").alias("mask")))
    return out


def repeated(docs: DataFrame, width: int, most: int = GROUP) -> DataFrame:
    """``key``, ``low`` and ``mask`` of every segment with repeats; ``docs`` has ``key`` and ``text``. ``mask`` has a bit per window from ``low`` on."""

    def cut(batch):
        s = segments(batch.column(1), width)
        key = batch.column(0).to_numpy()
        yield {"gram": s["gram"], "segment": s["segment"], "key": key[s["doc"]], "low": s["low"], "n": s["n"]}

    schema = "gram bigint, segment bigint, key bigint, low int, n int"
    every = save(arrow_map(docs, ["key", "text"], schema, cut), "anchors")
    # Counts are combined before the shuffle and saved: joins below are of plain tables, so that Spark can split a frequent anchor or segment.
    frequent = save(every.groupBy("gram").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("gram"), "frequent")
    live = save(every.join(frequent, "gram", "left_semi"), "segments")
    distinct = live.groupBy("gram", "segment").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("key", "low", "n")).alias("at"))
    counted = save(distinct.select("gram", "segment", "copies", "at.*"), "distinct")
    groups = save(counted.groupBy("gram").agg(F.count(F.lit(1)).alias("segments")).where("segments > 1"), "groups")
    copied = counted.where("copies > 1").select("segment", ((F.lit(2) ** F.col("n")).cast("bigint") - 1).alias("mask"))

    # The words of one document that holds the segment.
    several = counted.join(groups, "gram")
    wanted = several.groupBy("key").agg(F.collect_set(F.struct("segment", "gram", "low", "n", "copies", (F.col("segments") > most).alias("large"))).alias("w"))
    rows = docs.join(wanted, "key").dropDuplicates(["key"]).select("text", F.col("w.segment").alias("s"), F.col("w.gram").alias("g"), F.col("w.low").alias("l"), F.col("w.n").alias("n"), F.col("w.copies").alias("c"), F.col("w.large").alias("b"))

    def read(batch):
        w = cut_words(batch.column(0))
        raw = word_hashes(w)
        count = np.array([len(x) for x in batch.column(1)])
        of = [c.flatten().to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
        begin = np.repeat(w.first[:-1], count) + of[2]
        yield {"segment": of[0], "gram": of[1], "copies": of[4], "large": of[5].astype(bool), "words": [raw[a : a + n + width - 1].tobytes() for a, n in zip(begin, of[3])]}

    content = save(arrow_map(rows, ["text", "s", "g", "l", "n", "c", "b"], "segment bigint, gram bigint, copies bigint, large boolean, words binary", read), "content")
    small, large = content.where("not large"), content.where("large")
    found = trees(small.select(binned("gram", small), "segment", F.lit(0).alias("bit"), "copies", "words"), width).unionByName(copied)
    if large.limit(1).count():
        found = found.unionByName(split(large, width, most))
    masks = save(found.where("mask <> 0").groupBy("segment").agg(F.bit_or("mask").alias("mask")), "masks")
    return live.join(masks, "segment").select("key", "low", "mask")


def dedup(docs: DataFrame, width: int = WIDTH, texts: bool = False, most: int = GROUP) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept_sha256`` of every document; with ``texts`` also ``kept``, the words left."""
    if not PREFIX <= width <= 62:
        raise ValueError(f"a window has {PREFIX} to 62 words")
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    found = repeated(keyed, width, most).groupBy("key").agg(F.collect_set(F.struct("low", "mask")).alias("r"))  # no more than the document's own words
    rows = keyed.join(found, "key", "left").select("doc_id", "text", F.coalesce("r.low", F.array().cast("array<int>")).alias("low"), F.coalesce("r.mask", F.array().cast("array<bigint>")).alias("mask"))

    def finish(batch):
        w = cut_words(batch.column(1))
        count = np.array([len(x) for x in batch.column(2)], np.int64)
        low = np.repeat(w.first[:-1], count) + batch.column(2).flatten().to_numpy(zero_copy_only=False)
        mask = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        edge = np.zeros(len(w.start) + 1, np.int64)
        for bit in range(width):
            at = low[(mask >> bit) & 1 == 1] + bit
            np.add.at(edge, at, 1)
            np.add.at(edge, at + width, -1)
        gone = np.cumsum(edge[:-1]) > 0
        removed = np.concatenate([[0], np.cumsum(gone)])
        data = w.data.tobytes()
        kept = []
        for d in range(batch.num_rows):
            a, b = w.first[d], w.first[d + 1]
            if removed[b] == removed[a]:
                kept.append(b" ".join(data[w.bounds[d] : w.bounds[d + 1]].split()))
            else:
                keep = a + np.flatnonzero(~gone[a:b])
                kept.append(b" ".join([data[s:e] for s, e in zip(w.start[keep], w.end[keep])]))
        out = {"doc_id": batch.column(0), "n_words": np.diff(w.first), "n_removed": removed[w.first[1:]] - removed[w.first[:-1]], "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]}
        yield out | ({"kept": [k.decode() for k in kept]} if texts else {})

    return arrow_map(rows, ["doc_id", "text", "low", "mask"], "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * texts, finish)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT row_no, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n
  FROM (SELECT row_no, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts)
),
windows AS (
  SELECT row_no, i, word, CASE WHEN i + 34 <= n THEN string_agg(word, ' ') OVER (PARTITION BY row_no ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) END AS passage FROM words
),
counted AS (SELECT row_no, i, word, passage IS NOT NULL AND count(*) OVER (PARTITION BY passage) > 1 AS repeated FROM windows),
judged AS (SELECT row_no, i, word, bool_or(repeated) OVER (PARTITION BY row_no ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS removed FROM counted),
found AS (SELECT row_no, count(*) AS n_words, count(*) FILTER (removed) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT removed) AS kept FROM judged GROUP BY row_no)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM texts LEFT JOIN found USING (row_no)
"""
