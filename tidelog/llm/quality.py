"""Quality by regularised quadratic discriminant analysis over document statistics.

Statistics of the whole text are transformed to be roughly symmetric. Each class
has a mean and a covariance shrunk towards the pooled one and towards its
diagonal. A score is the logistic of the difference of the two Mahalanobis log
densities plus that of the log priors; the Cholesky factors are computed once and
their inverses kept in the model. Means and covariances come from sums over all
labelled rows: no sample is taken.

Defined cases: a null or empty text has statistics of zero words and is scored
like any other; labels other than 0 and 1 or null, and labels of no document,
are left out; repeated labels count as often as they are there; with no rows of
one class the score is the share of label 1 (0.5 with no labels); a null
``doc_id`` is scored and not held out; an empty table gives no rows; columns of
clashing names are never joined in.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, cut_words, gram_hashes, save, slices, table, word_hashes

THRESHOLD = 0.3

#: The statistics, in the order of a row.
FEATURES = [
    "log_words", "log_bytes", "word_bytes", "word_bytes_spread", "symbols", "bars", "digits", "upper", "punctuation", "lines",
    "accents", "repeats", "variety", "pair_variety", "symbol_words", "long_words", "short_words", "spaces",
]


def _share(counts: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Log odds of a share, with half a case added on either side."""
    return np.log((counts + 0.5) / (np.maximum(of - counts, 0) + 0.5))


def statistics(texts) -> np.ndarray:
    """A row of ``FEATURES`` for each text."""
    w = cut_words(texts)
    n_docs = len(w.first) - 1
    size = np.diff(w.bounds).astype(float)
    n = np.diff(w.first).astype(float)
    doc = w.of()
    per_word = lambda x: np.bincount(doc, x, n_docs)

    def bytes_in(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[w.bounds[1:]] - total[w.bounds[:-1]]).astype(float)

    kind = np.zeros(256, np.uint8)  # 1 symbol, 2 bar, 3 digit, 4 upper case, 5 punctuation, 6 line end, 7 high, 8 space
    for code, chars in enumerate((b"#$%&*@^~<>=_\\{}[]+", b"|", b"0123456789", bytes(range(65, 91)), b".,;:!?", b"\n", bytes(range(128, 256)), b" \t"), 1):
        kind[list(chars)] = code
    kinds = kind[w.data]
    symbols = kinds == 1
    run = np.concatenate([[0], np.cumsum(symbols)])
    length = (w.end - w.start).astype(float)
    h = word_hashes(w)
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])

    def distinct(values: np.ndarray, of: np.ndarray) -> np.ndarray:
        order = np.lexsort((values, of))
        v, d = values[order], of[order]
        new = np.ones(len(v))
        new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
        return np.bincount(d, new, n_docs)

    pairs = gram_hashes(h, 2)
    inside = doc[1:] == doc[:-1] if len(doc) > 1 else np.zeros(0, bool)
    n_pairs = np.maximum(n - 1, 0)
    mean = per_word(length) / np.maximum(n, 1)
    spread = np.sqrt(np.maximum(per_word(length**2) / np.maximum(n, 1) - mean**2, 0))
    return np.stack(
        [
            np.log1p(n), np.log1p(size), np.log1p(mean), np.log1p(spread),
            *(_share(bytes_in(kinds == k), size) for k in range(1, 8)),
            _share(per_word(same), n_pairs), _share(distinct(h, doc), n), _share(distinct(pairs[inside], doc[:-1][inside]), n_pairs) if len(pairs) else _share(np.zeros(n_docs), n_pairs),
            _share(per_word((run[w.end] - run[w.start]) > 0), n), _share(per_word(length > 12), n), _share(per_word(length <= 2), n), _share(bytes_in(kinds == 8), size),
        ],
        axis=1,
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``features`` of every document."""

    def run(batch):
        yield {"doc_id": batch.column(0), "features": list(statistics(batch.column(1)))}

    return arrow_map(docs, ["doc_id", "text"], "doc_id bigint, features array<double>", run)


class Model(NamedTuple):
    """Per class 0 and 1: prior, mean, inverse Cholesky factor, log determinant. ``share`` is used where a class is missing."""

    share: float
    classes: list[tuple[float, np.ndarray, np.ndarray, float]]

    def score(self, x: np.ndarray) -> np.ndarray:
        if len(self.classes) < 2:
            return np.full(len(x), self.share)
        log = [np.log(p) - 0.5 * (det + (((x - mean) @ inverse.T) ** 2).sum(1)) for p, mean, inverse, det in self.classes]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def fit(labelled: DataFrame, pooled: float = 0.3, diagonal: float = 0.05) -> Model:
    """From ``features`` and ``label`` (0 or 1). ``pooled`` and ``diagonal`` are the shares of the shrinkage targets."""
    d = len(FEATURES)
    schema = "label int, at int, value double"

    def run(batch):
        label = batch.column(0).to_numpy(zero_copy_only=False)
        x = np.array(batch.column(1).to_pylist(), float).reshape(-1, d)
        for c in (0, 1):
            y = x[label == c]
            if len(y):
                sums = np.concatenate([[len(y)], y.sum(0), (y.T @ y).ravel()])
                yield {"label": np.full(len(sums), c, np.int32), "at": np.arange(len(sums), dtype=np.int32), "value": sums}

    # 2 * (1 + d + d * d) rows come to the driver, whatever the input.
    rows = arrow_map(labelled, ["label", "features"], schema, run).groupBy("label", "at").agg(F.sum("value").alias("value")).collect()
    sums = np.zeros((2, 1 + d + d * d))
    for r in rows:
        sums[r["label"], r["at"]] = r["value"]
    n = sums[:, 0]
    if not n.all():
        return Model(float(n[1] / n.sum()) if n.sum() else 0.5, [])
    means = sums[:, 1 : 1 + d] / n[:, None]
    cov = [sums[c, 1 + d :].reshape(d, d) / n[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    common = (cov[0] * n[0] + cov[1] * n[1]) / n.sum()
    classes = []
    for c in (0, 1):
        s = (1 - pooled - diagonal) * cov[c] + pooled * common + diagonal * np.diag(np.diag(common)) + 1e-6 * np.eye(d)
        factor = np.linalg.cholesky(s)
        classes.append((float(n[c] / n.sum()), means[c], np.linalg.inv(factor), float(2 * np.log(np.diag(factor)).sum())))
    return Model(float(n[1] / n.sum()), classes)


def score(features: DataFrame, model: Model) -> DataFrame:
    def run(batch):
        x = np.array(batch.column(1).to_pylist(), float).reshape(-1, len(FEATURES))
        yield {"doc_id": batch.column(0), "score": model.score(x)}

    return arrow_map(features, ["doc_id", "features"], "doc_id bigint, score double", run)


def remainder(doc_id, of: int):
    """crc32 of an id as text, by ``of``; null ids have none."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def classify(docs: DataFrame, labels: DataFrame, fold: int = 5, held: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document; rows held out teach nothing."""
    features = save(with_statistics(docs), "statistics")
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("label"))
    learn = features.where(remainder(F.col("doc_id"), fold) != held).join(known, F.col("doc_id") == F.col("_id")).select("label", "features")
    scored = score(features, fit(learn))
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), fold) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, fold: int = 5, held: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """The documents predicted 1, with all their columns. Statistics are made again where rows are judged, so texts aren't shuffled."""
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("label"))
    features = save(with_statistics(docs.where(remainder(F.col("doc_id"), fold) != held)), "statistics")
    model = fit(features.join(known, F.col("doc_id") == F.col("_id")).select("label", "features"))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(model.score(statistics(part.column(at))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
