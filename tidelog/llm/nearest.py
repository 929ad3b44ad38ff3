"""Approximate nearest neighbours by cosine over balanced posting lists.

Centroids are trained on a bounded sample of unit vectors; there are about as
many as the square root of the number of vectors. Every vector goes to the list
of its nearest centroid, and, where it lies near a boundary, to further ones:
those within ``(1 + slack)`` of the least distance, unless a centroid already
taken is nearer to the new one than the vector is. A query finds centroids by
walking a neighbour graph in memory, and takes the lists within a distance ratio
of the nearest. A list with more vectors than ``list_size`` is dealt into parts,
and the queries of a list into pieces, so no list is one task's whatever its
share or the number of queries.

Scores are cosines of the original vectors in double precision, each scaled by a
power of two so that no square is too large or small, and summed in the order of
the components, so equal vectors score alike wherever they are.

The sample has ``SAMPLE`` vectors, or eight a list where there are more lists, but
never more than ``MOST_SAMPLE``; beyond that the lists grow longer, in more parts.

Defined cases: vectors that are null, zero, of another length than most, or hold
null or non-finite components take no part, nor do rows with a null id; with
fewer candidates than ``k`` all found are returned; ties go to the smaller id;
rows that repeat an id are vectors of their own, each with a rank, but never
candidates of their id's queries, and each of several queries of one id gets
``k`` ranks only; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_long, hash_spans, save, table

#: Vectors of the training sample, and the most there can be, whatever the table.
SAMPLE, MOST_SAMPLE = 20_000, 200_000
#: Vectors of one part of a list, and queries of one piece.
LIST_SIZE, PIECE = 2000, 1000


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, all of one length, as doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that the largest component is between 1/2 and 1: exact, and squares don't overflow or vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows, summed in the order of the components."""
    a, b = scaled(a), scaled(b)
    dot, aa, bb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for j in range(a.shape[1]):
        dot += a[:, j] * b[:, j]
        aa += a[:, j] * a[:, j]
        bb += b[:, j] * b[:, j]
    return dot / (np.sqrt(aa) * np.sqrt(bb))


class Index(NamedTuple):
    centroids: np.ndarray
    graph: np.ndarray
    entry: np.ndarray

    @classmethod
    def build(cls, sample: np.ndarray, lists: int, rounds: int = 8, degree: int = 16, seed: int = 5) -> Index:
        """Spherical k-means; clusters that grow large lose members to a size penalty, so lists stay balanced."""
        rng = np.random.default_rng(seed)
        x = unit(sample)
        distinct = np.unique(x, axis=0)
        c = distinct[rng.permutation(len(distinct))[:lists]]
        size = np.zeros(len(c))
        blocks = [slice(i, i + 4096) for i in range(0, len(x), 4096)]
        for _ in range(rounds):
            near = np.concatenate([(x[b] @ c.T - 0.005 * size * len(c) / len(x)).argmax(1) for b in blocks])
            size = np.bincount(near, minlength=len(c)).astype(float)
            total = np.zeros_like(c)
            np.add.at(total, near, x)
            moved = np.sqrt((total**2).sum(1)) > 1e-9
            c[moved] = unit(total[moved])
        degree = min(degree, len(c) - 1)
        graph = np.zeros((len(c), degree), np.int64)
        for b in range(0, len(c) if degree else 0, 1024):
            close = c[b : b + 1024] @ c.T
            close[np.arange(len(close)), b + np.arange(len(close))] = -2
            graph[b : b + 1024] = np.argsort(-close, axis=1)[:, :degree]
        entry = rng.permutation(len(c))[: max(1, int(4 * np.sqrt(len(c))))]
        return cls(c, graph, entry)

    def walk(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids of each unit vector found by the graph, nearest first, and their squared distances."""
        n, c = len(x), self.centroids
        beam = min(beam, len(c))
        ids = np.broadcast_to(self.entry, (n, len(self.entry)))
        score = x @ c[self.entry].T
        best = np.argsort(-score, axis=1)[:, :beam]
        ids, score = np.take_along_axis(ids, best, 1), np.take_along_axis(score, best, 1)
        seen = np.zeros((n, len(c)), bool)
        rows = np.arange(n)[:, None]
        while True:
            fresh = ~seen[rows, ids]
            if not fresh.any():
                return ids, np.maximum(0, 2 - 2 * score)
            seen[rows, ids] = True
            pick = np.argsort(np.where(fresh, -score, 9), axis=1)[:, :4]  # the nearest centroids not opened so far
            far = ~np.take_along_axis(fresh, pick, 1)
            new = self.graph[np.take_along_axis(ids, pick, 1)]
            new = np.where(far[:, :, None], ids[:, :1, None], new).reshape(n, -1)
            s = np.einsum("nkd,nd->nk", c[new], x)
            ids, score = np.concatenate([ids, new], 1), np.concatenate([score, s], 1)
            order = np.lexsort((ids, -score), axis=1)
            ids, score = np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)
            again = np.zeros_like(ids, bool)
            again[:, 1:] = ids[:, 1:] == ids[:, :-1]
            order = np.argsort(np.where(again, 9, -score), axis=1, kind="stable")[:, :beam]
            ids, score = np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)

    def lists(self, x: np.ndarray, most: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of row and list under the replication rule."""
        ids, d = self.walk(x, max(4 * most, 16))
        keep = np.zeros(ids.shape, bool)
        keep[:, 0] = True
        for j in range(1, min(ids.shape[1], 2 * most)):
            near = (d[:, j] <= (1 + slack) ** 2 * d[:, 0] + 1e-12) & (keep.sum(1) < most)
            for i in range(j):
                between = 2 - 2 * np.einsum("nd,nd->n", self.centroids[ids[:, i]], self.centroids[ids[:, j]])
                near &= ~keep[:, i] | (between > d[:, j])
            keep[:, j] = near
        row, at = np.nonzero(keep)
        return row, ids[row, at]

    def probes(self, x: np.ndarray, most: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of row and list within ``ratio`` of the nearest centroid's distance."""
        ids, d = self.walk(x, most)
        row, at = np.nonzero(d <= ratio**2 * d[:, :1] + 1e-12)
        return row, ids[row, at]


def usable(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    v = F.col(vector)
    sound = v.isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    return rows.where(sound & F.col(id_column).isNotNull()).select(F.col(id_column).cast("bigint").alias("vec_id"), v.cast("array<double>").alias("v"))


def _mapped(df: DataFrame, sent, schema: str, f) -> DataFrame:
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                row, lists = f(sent.value, unit(matrix(part.column(1))))
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), *taken.columns], names=["list", "vec_id", "v"])

    return df.mapInArrow(run, schema)


def _share(n: int, wanted: int):
    """A condition that a hash of the id meets for about ``wanted`` of ``n`` rows."""
    of = 1 << 30
    return F.pmod(F.xxhash64("vec_id"), F.lit(of)) < min(of, -(-of * wanted // n))


def search(rows: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "vec_id", vector: str = "embedding", replicas: int = 2, slack: float = 0.1, probes: int = 1024, ratio: float = 1.24, list_size: int = LIST_SIZE, piece: int = PIECE) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` nearest rows to each query, itself excepted."""
    spark = rows.sparkSession
    base = usable(rows, id_column, vector)
    width = base.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if width is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    base, asked = base.where(F.size("v") == width["n"]), usable(queries, id_column, vector).where(F.size("v") == width["n"])
    total = width["count"]
    lists = max(1, int(np.sqrt(total)))
    wanted = min(MOST_SAMPLE, max(SAMPLE, 8 * lists))
    taken = base.where(_share(total, wanted)).limit(2 * wanted).select("v").toArrow().column("v").chunks
    sample = np.concatenate([matrix(x) for x in taken]) if sum(map(len, taken)) else np.array([base.first()["v"]], float)
    # As many centroids as an eighth of the sample at most.
    sent = spark.sparkContext.broadcast(Index.build(sample, min(lists, max(SAMPLE, wanted) // 8)))
    schema = "list int, vec_id bigint, v array<double>"
    posted = save(_mapped(base, sent, schema, lambda index, x: index.lists(x, replicas, slack)), "postings")
    probed = save(_mapped(asked, sent, schema, lambda index, x: index.probes(x, probes, ratio)), "probes")
    found = _top(_meet(posted, probed, k, list_size, piece), k)
    # A query whose lists hold fewer than k candidates goes to all lists.
    found = save(found, "nearest")
    short = asked.join(found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
    if short.limit(1).count():
        anywhere = save(short.select(F.explode(F.sequence(F.lit(0), F.lit(len(sent.value.centroids) - 1))).alias("list"), "vec_id", "v"), "probes")
        more = _top(_meet(posted, anywhere, k, list_size, piece), k)
        found = found.join(more.select("query_id").distinct(), "query_id", "left_anti").unionByName(more)
    return found


def _top(found: DataFrame, k: int) -> DataFrame:
    """A vector that stands in several lists comes back once: every list gives like rows of an id the same numbers."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "vector", "copy")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _meet(posted: DataFrame, probed: DataFrame, k: int, list_size: int, piece: int) -> DataFrame:
    """The ``k`` nearest of each part of a list to each query that takes the list."""
    number = lambda of, n, name: of.groupBy("list").agg((F.floor(F.count(F.lit(1)) / F.lit(n)) + 1).cast("int").alias(name))
    plan = F.broadcast(number(posted, list_size, "parts").join(number(probed, piece, "pieces"), "list"))  # a row per list
    of = lambda name, n: F.pmod(F.xxhash64("vec_id", F.lit(name)), F.col(n)).cast("int").alias(name)
    every = lambda name, n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    place = ["list", "part", "piece"]
    members = posted.join(plan, "list").select("list", of("part", "parts"), every("piece", "pieces"), "vec_id", "v")
    asking = probed.join(plan, "list").select("list", every("part", "parts"), of("piece", "pieces"), "vec_id", "v")
    return members.groupBy(*place).cogroup(asking.groupBy(*place)).applyInArrow(_nearest(k), "query_id bigint, vec_id bigint, score double, vector bigint, copy int")


def _nearest(k: int):
    names = ["query_id", "vec_id", "score", "vector", "copy"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        out: list[list[np.ndarray]] = [[] for _ in names]
        if left.num_rows and right.num_rows:
            of = lambda t, name: pa.concat_arrays(t.column(name).chunks)
            ids, x = of(left, "vec_id").to_numpy(), matrix(of(left, "v"))
            qid, q = of(right, "vec_id").to_numpy(), matrix(of(right, "v"))
            order = np.lexsort((*x.T[::-1], ids))
            ids, x = ids[order], x[order]
            same = np.zeros(len(ids), bool)
            same[1:] = (ids[1:] == ids[:-1]) & (x[1:] == x[:-1]).all(1)
            copy = np.arange(len(ids)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(ids))))
            content = hash_spans(np.ascontiguousarray(x + 0.0).view(np.uint8).ravel(), np.arange(len(x)) * x.shape[1] * 8, np.arange(1, len(x) + 1) * x.shape[1] * 8)
            ux, uq = unit(x), unit(q)
            for at in range(0, len(q), 256):
                close = uq[at : at + 256] @ ux.T
                close[qid[at : at + 256, None] == ids[None, :]] = -9  # its own row, and further rows of the same id
                kth = np.partition(close, -min(k, close.shape[1]), axis=1)[:, -min(k, close.shape[1])]
                row, col = np.nonzero(close >= np.maximum(kth, -2)[:, None] - 1e-9)
                # Of many equal vectors the smallest ids win; the rest need no exact score.
                score = cosine(q[at + row], x[col])
                best = np.lexsort((copy[col], content[col], ids[col], -score, row))
                row, col, score = row[best], col[best], score[best]
                begin = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1]) if len(row) else np.zeros(0, int)
                rank = np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row))))
                top = rank < k
                for o, v in zip(out, (qid[at + row[top]], ids[col[top]], score[top], as_long(content[col[top]]), copy[col[top]])):
                    o.append(v)
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int32()]
        return pa.table([pa.array(np.concatenate(o) if o else [], t) for o, t in zip(out, kinds)], names=names)

    return run


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where(F.col("vec_id") % 50 == 0))
