"""Quality: a regularised quadratic discriminant over transformed document statistics.

Every whole text becomes a short vector of statistics. The class means and covariances come from sums that Spark adds up
over all labelled rows one may learn from, so no row reaches the driver. Each covariance is shrunk towards its diagonal
and towards the pooled one; its Cholesky factor is kept in the model, and a score is the logistic of the difference of the
two log densities (squared Mahalanobis lengths and log determinants) and of the log class shares.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import single_labels

#: The statistics, in the order of the vector.
FEATURES = (
    "log_words", "word_length", "upper", "marks", "digits", "stops", "distinct", "top_word", "marked_words", "line_words", "repeated_lines", "wide_bytes",
)

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[44, 46]] = True  # comma and full stop
_MARK = ~(_LETTER | _DIGIT | _SPACE | _STOP)


def statistics(text: str | None) -> list[float]:
    """The vector of a text; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    bytes_of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    n = len(words)
    solid = max(1, int(bytes_of[~_SPACE].sum()))
    letters = max(1, int(bytes_of[_LETTER].sum()))
    counts = Counter(words)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    share = lambda mask, of: math.log(1e-3 + int(bytes_of[mask].sum()) / of)
    marked = sum(k for w, k in counts.items() if _MARK[w[-1]])
    return [
        math.log1p(n), math.log(solid / max(1, n)), share(_UPPER, letters), share(_MARK, solid), share(_DIGIT, solid), share(_STOP, solid),
        math.log1p(len(counts)) / math.log(2 + n), math.log(1e-3 + max(counts.values(), default=0) / max(1, n)), math.log(1e-2 + marked / max(1, n)),
        math.log1p(n / max(1, len(lines))), math.log(1e-2 + 1 - len(set(lines)) / max(1, len(lines))), share(slice(128, 256), solid),
    ]


def statistics_of(text: Column) -> Column:
    """The vector of a text column."""

    @F.pandas_udf("array<double>")
    def vectors(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts], dtype=object)

    return vectors(text)


@dataclass(frozen=True)
class QuadraticModel:
    """Per class: log share, mean, Cholesky factor of the inverse-free kind (lower, of the covariance) and log determinant.
    Without both classes `classes` is empty and `share` is every text's score."""

    share: float
    classes: tuple[tuple[float, np.ndarray, np.ndarray, float], ...]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), self.share)
        logs = []
        for log_share, mean, lower, log_det in self.classes:
            z = np.linalg.solve(lower, (x - mean).T)
            logs.append(log_share - 0.5 * ((z * z).sum(axis=0) + log_det))
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -700, 700)))


def fit_quadratic(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = 0.1, pool: float = 0.1, ridge: float = 1e-3) -> QuadraticModel:
    """From each class's row count, sum and sum of outer products. A covariance keeps 1 - shrink - pool of its own entries;
    `shrink` goes to its diagonal and `pool` to the pooled covariance. A class of fewer than two rows counts as absent."""
    total = sum(s[0] for s in sums.values())
    share = sums.get(1, (0,))[0] / total if total else 0.0
    if any(sums.get(y, (0,))[0] < 2 for y in (0, 1)):
        return QuadraticModel(share, ())
    means = {y: s[1] / s[0] for y, s in sums.items()}
    covs = {y: s[2] / s[0] - np.outer(means[y], means[y]) for y, s in sums.items()}
    pooled = sum(covs[y] * sums[y][0] for y in (0, 1)) / total
    classes = []
    for y in (0, 1):
        cov = (1 - shrink - pool) * covs[y] + shrink * np.diag(np.diag(covs[y])) + pool * pooled + ridge * np.eye(len(pooled))
        lower = np.linalg.cholesky(cov)
        classes.append((math.log(sums[y][0] / total), means[y], lower, 2 * float(np.log(np.diag(lower)).sum())))
    return QuadraticModel(share, tuple(classes))


def class_sums(vectors: DataFrame, labels: DataFrame, label: str = "quality") -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Sums over every labelled row of `vectors` (`doc_id`, `x`), added up in Spark; two rows come back."""
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    aggregates = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d)] + [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}_{j}") for i, j in pairs]
    known = single_labels(labels, label)
    rows = vectors.where(F.col("doc_id").isNotNull()).join(known, "doc_id").groupBy("_y").agg(F.count("*").alias("n"), *aggregates).collect()
    sums = {}
    for r in rows:
        outer = np.zeros((d, d))
        for i, j in pairs:
            outer[i, j] = outer[j, i] = r[f"p{i}_{j}"]
        sums[r["_y"]] = (float(r["n"]), np.array([r[f"s{i}"] for i in range(d)]), outer)
    return sums


def quality_score(model: QuadraticModel, vector: Column) -> Column:
    """The score of a vector column."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            yield pd.Series(model.scores(np.array(part.tolist(), float).reshape(len(part), len(FEATURES))))

    return score(vector)


def classify_quality(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """One row per row of `docs`: `doc_id`, `score` (0 to 1, higher: class 1 likelier) and `predicted` (1 from 0.5 on).

    `labels` must hold only the rows one may learn from; all of them are used. Null texts count as empty, and empty texts
    are scored by the same densities. Null ids never learn but are scored; repeated rows are rows like any other; labels
    that contradict each other for one id count as the smallest; with labels of one class only (or none) every row scores
    that class's share. An empty table gives an empty result; further columns are not read.
    """
    vectors = cut_lineage(docs.select("doc_id", statistics_of(F.col("text")).alias("x")))
    model = fit_quadratic(class_sums(vectors, labels, label))
    rows = vectors.select("doc_id", quality_score(model, F.col("x")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
