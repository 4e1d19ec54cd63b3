"""Quality: regularised quadratic discriminant analysis of transformed document statistics.

Each class has a mean and a covariance shrunk towards the pooled one and its scaled identity; the score is the posterior of
label 1 from the difference of Mahalanobis log densities, whose Cholesky factors are computed once. At most `most_rows`
labelled rows outside the held-out fold are learned from; every whole text is scored.

Nulls, empty texts, repeated rows, missing labels, empty tables and other columns: as for toxicity. Texts of any length are
read whole; a score on the threshold counts as label 1.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import features, shared


class Discriminant:
    def __init__(self, to_pooled: float = 0.1, to_identity: float = 0.05):
        self.to_pooled, self.to_identity = to_pooled, to_identity

    def fit(self, x: np.ndarray, y: np.ndarray) -> Discriminant:
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        z = (x - self.mean) / self.scale
        d = z.shape[1]
        centres = [z[y == c].mean(axis=0) for c in (0, 1)]
        own = [np.cov(z[y == c].T, bias=True).reshape(d, d) if (y == c).sum() > 1 else np.eye(d) for c in (0, 1)]
        share = [(y == c).mean() for c in (0, 1)]
        pooled = share[0] * own[0] + share[1] * own[1]
        self.parts = []
        for c in (0, 1):
            s = (1 - self.to_pooled) * own[c] + self.to_pooled * pooled
            s = (1 - self.to_identity) * s + self.to_identity * max(np.trace(s) / d, 1e-3) * np.eye(d)
            chol = np.linalg.cholesky(s)
            self.parts.append((centres[c], np.linalg.inv(chol), float(np.log(share[c]) - np.log(np.diag(chol)).sum())))
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        bad, good = (const - 0.5 * (((z - centre) @ inverse.T) ** 2).sum(axis=1) for centre, inverse, const in self.parts)
        return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))


def quality(spark: SparkSession, documents: DataFrame, labels: DataFrame, most_rows: int = 20_000, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scratch = shared.Scratch(spark, "quality")
    names = features.QUALITY_NAMES
    table = scratch.save(features.featured(documents, features.quality_features, names))
    x, y, _ = features.labelled_sample(table, labels, "quality", names, most_rows)
    if len(y) == 0 or y.min() == y.max():
        value = float(y[0]) if len(y) else 0.0
        return features.scored(table, names, lambda rows: np.full(len(rows), value), threshold)
    return features.scored(table, names, Discriminant().fit(x, y), threshold)


def op8(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    return quality(spark, documents, labels)
