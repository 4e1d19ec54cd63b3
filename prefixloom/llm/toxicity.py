"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

At most `most_rows` labelled rows outside the held-out fold are learned from: one half gives a lexicon of words and word
stems that mark toxic texts (at most `most_terms` = 20 000, the most frequent in toxic ones), the other grows the trees in numpy, but for a quarter of it that fits the calibration. Every
whole text is scored.

Nulls: a null text scores as an empty one, a null doc_id is never held out; null labels and labels other than 0 and 1 are
left out. Repeated rows are scored each, repeated labels count each. With no labels, or one value only, every score is that
value's (0 without labels). Texts of any length are read whole; a score on the threshold counts as label 1. An empty table gives no row. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import features, shared


class Trees:
    """Boosted trees of logistic loss over quantile bins, second order."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0):
        self.n, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        d = x.shape[1]
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        binned = np.column_stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)])
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        margin = np.full(len(y), self.start)
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), dtype=np.int64)
            feature, cut = np.zeros(2**self.depth - 1, dtype=np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                width, base = 2**level, 2**level - 1
                best = np.zeros(width)
                chosen = np.full(width, -1)
                where = np.zeros(width, dtype=np.int64)
                for j in range(d):
                    if not len(edges[j]):
                        continue
                    k = len(edges[j]) + 1
                    gs, hs = (np.bincount(node * k + binned[:, j], weights=v, minlength=width * k).reshape(width, k).cumsum(axis=1) for v in (g, h))
                    gl, hl, ga, ha = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                    gain = gl**2 / (hl + self.ridge) + (ga - gl) ** 2 / (ha - hl + self.ridge) - ga**2 / (ha + self.ridge)
                    gain[(hl < 0.5) | (ha - hl < 0.5)] = 0
                    at = gain.argmax(axis=1)
                    better = gain[np.arange(width), at] > best + 1e-9
                    best, chosen, where = np.where(better, gain[np.arange(width), at], best), np.where(better, j, chosen), np.where(better, at, where)
                for i in range(width):
                    if chosen[i] >= 0:
                        feature[base + i], cut[base + i] = chosen[i], edges[chosen[i]][where[i]]
                node = 2 * node + (x[np.arange(len(y)), feature[base + node]] > cut[base + node])
            leaves = 2**self.depth
            value = -self.rate * np.bincount(node, weights=g, minlength=leaves) / (np.bincount(node, weights=h, minlength=leaves) + self.ridge)
            margin += value[node]
            self.nodes.append((feature, cut, value))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, value in self.nodes:
            node = np.zeros(len(x), dtype=np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (x[rows, feature[at]] > cut[at])
            out += value[node]
        return out


class Isotonic:
    """Non-decreasing least-squares fit (pool adjacent violators), linear between the pools' centres."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(x, kind="stable")
        pools: list[list[float]] = []
        for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
            pools.append([a, b, 1.0])
            while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
                a2, b2, n2 = pools.pop()
                a1, b1, n1 = pools[-1]
                pools[-1] = [(a1 * n1 + a2 * n2) / (n1 + n2), (b1 * n1 + b2 * n2) / (n1 + n2), n1 + n2]
        self.x, self.y = np.array([p[0] for p in pools]), np.array([p[1] for p in pools])
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.x, self.y)


def train(x: np.ndarray, y: np.ndarray, h: np.ndarray):
    """A function from features to calibrated scores."""
    if len(y) == 0 or y.min() == y.max():
        return lambda rows, v=float(y[0]) if len(y) else 0.0: np.full(len(rows), v)
    kept = np.abs(h) % 4 == 3
    if len(np.unique(y[kept])) < 2 or len(np.unique(y[~kept])) < 2:
        kept = np.zeros(len(y), dtype=bool)
    trees = Trees().fit(x[~kept], y[~kept])
    if not kept.any():
        return lambda rows: 1 / (1 + np.exp(-trees.margin(rows)))
    curve = Isotonic().fit(trees.margin(x[kept]), y[kept])

    def score(rows: np.ndarray) -> np.ndarray:
        m = trees.margin(rows)
        return 0.98 * curve(m) + 0.02 / (1 + np.exp(-m))  # the second part orders what the first pools

    return score


def weigh(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Smoothed log odds of a term's document counts under label 1 and label 0."""
    return np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))


def term_counts(texts: DataFrame, only: np.ndarray | None = None) -> DataFrame:
    """(term, n): in how many of the texts each term (a hash) stands; only those given, if any are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.in_batches(batches):
            data, bounds = shared.text_bytes(b.column("text"))
            starts, ends = features.runs(features.LETTER[data], bounds)
            text = np.searchsorted(bounds, starts, side="right") - 1
            found = []
            for at, h in features.terms(shared.prefix_sums(features.FOLD[data]), starts, ends):
                if only is not None:
                    ok = np.isin(h, only)
                    at, h = at[ok], h[ok]
                pair = np.unique(np.rec.fromarrays([h, text[at]], names="h,t")) if len(h) else np.rec.fromarrays([h, text[at]], names="h,t")
                found.append(pair["h"])
            term, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"])

    return texts.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def learn_lexicon(sample: DataFrame, most_terms: int = 20_000, least: int = 3, odds: float = 2.5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and weights of words and stems that mark label 1 in (text, y), at most most_terms: first counted where y is 1, then those few where it is 0."""
    n = dict(sample.groupBy("y").count().toPandas().itertuples(index=False))
    seen = term_counts(sample.filter("y = 1").select("text")).filter(F.col("n") >= least).orderBy(F.col("n").desc(), "term").limit(most_terms).toPandas()
    terms = seen["term"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(terms)
    terms, toxic = terms[order], seen["n"].to_numpy(float)[order]
    if not len(terms):
        return terms, toxic
    other = term_counts(sample.filter("y = 0").select("text"), terms).toPandas()
    clean = np.zeros(len(terms))
    clean[np.searchsorted(terms, other["term"].to_numpy(np.int64).view(np.uint64))] = other["n"].to_numpy(float)
    weight = weigh(toxic, clean, n.get(1, 0), n.get(0, 0))
    keep = weight >= odds
    return terms[keep], weight[keep]


def toxicity(spark: SparkSession, documents: DataFrame, labels: DataFrame, most_rows: int = 20_000, threshold: float = 0.5, folds: int = 5, held_fold: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scratch = shared.Scratch(spark, "toxicity")
    known = labels.filter(F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
    known = known.filter(shared.fold("doc_id", folds) != held_fold)
    known = scratch.save(features.drawn(known, most_rows).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "y").limit(most_rows))
    # the lexicon comes from other rows than the trees, so that its counts mean the same on rows it has not seen
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lexicon = learn_lexicon(scratch.save(texts.join(F.broadcast(known.filter(F.pmod("h", F.lit(2)) == 0)), "doc_id").select("text", "y").repartition(8)))
    names = features.TOXIC_NAMES
    table = scratch.save(features.featured(documents, lambda data, bounds: features.toxic_features(data, bounds, lexicon), names))
    cols = [f"f_{x}" for x in names]
    rows = table.join(F.broadcast(known.filter(F.pmod("h", F.lit(2)) == 1)), "doc_id").select("h", "y", *cols).orderBy("h", "y", *cols).limit(most_rows).toPandas()
    model = train(rows[cols].to_numpy(float).reshape(len(rows), len(cols)), rows["y"].to_numpy(float), rows["h"].to_numpy(np.int64) // 2)
    return features.scored(table, names, model, threshold, folds, held_fold)


def op4(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    return toxicity(spark, documents, labels)


def keep_clean(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not judged toxic, with their columns. Ids that repeat share the verdict of their highest score."""
    judged = toxicity(spark, documents, labels).groupBy("doc_id").agg(F.max("predicted").alias("toxic__"))
    bad = judged.filter("toxic__ = 1").select(F.col("doc_id").alias("bad__"))
    return documents.join(bad, documents["doc_id"].eqNullSafe(bad["bad__"]), "left_anti")
