"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

Whole texts run through the network in stretches of `STRETCH` bytes, many at once; either direction starts each stretch from
rest. Every position gets a distribution over languages; a document's is the mean over all its positions.

Training takes stretches of at most `most_docs` documents outside the held-out fold, drawn evenly over languages. All
languages are learned: their number, not the corpus, decides the size of the list that reaches the driver.

Nulls: a null text, or one without a letter, is `und` with score 0; a null doc_id is never held out; a null lang teaches
nothing. Repeated rows are predicted each. With no languages to learn every document is `und`; with one, all with letters get it.
Of equally likely languages the first in code-point order is named. Very long texts take as many stretches as they need; an empty table gives no row. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

STRETCH = 96
UND = "und"


def sigmoid(x: np.ndarray) -> np.ndarray:
    """0.5 + 0.5 * tanh(x / 2), in place."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


class Direction:
    """One gated recurrent layer; states are columns: (units, batch)."""

    def __init__(self, units: int, rng: np.random.Generator):
        self.h = units
        self.p = {
            "x": rng.normal(0, 0.3, (3 * units, 256)).astype(np.float32),  # input weights by byte, biases included
            "u": (rng.normal(0, 1, (2 * units, units)) / np.sqrt(units)).astype(np.float32),
            "v": (rng.normal(0, 1, (units, units)) / np.sqrt(units)).astype(np.float32),
        }
        self.p["x"][:units] += 1.0

    def step(self, byte: np.ndarray, state: np.ndarray, live: np.ndarray | None) -> tuple:
        h = self.h
        x = np.take(self.p["x"], byte, axis=1)
        gates = sigmoid(x[: 2 * h] + self.p["u"] @ state)
        keep, reset = gates[:h], gates[h:]
        held = reset * state
        new = np.tanh(x[2 * h :] + self.p["v"] @ held)
        out = new + keep * (state - new)
        if live is not None:
            out = np.where(live, out, state)
        return out, (byte, state, keep, reset, held, new, live)

    def back(self, d_out: np.ndarray, cache: tuple, grad: dict[str, np.ndarray]) -> np.ndarray:
        byte, state, keep, reset, held, new, live = cache
        d_pass = 0.0
        if live is not None:
            d_pass, d_out = np.where(live, 0, d_out), np.where(live, d_out, 0)
        d_new = d_out * (1 - keep) * (1 - new * new)
        d_keep = d_out * (state - new) * keep * (1 - keep)
        d_held = self.p["v"].T @ d_new
        d_reset = d_held * state * reset * (1 - reset)
        d_gates = np.concatenate([d_keep, d_reset])
        grad["v"] += d_new @ held.T
        grad["u"] += d_gates @ state.T
        np.add.at(grad["x"].T, byte, np.concatenate([d_gates, d_new]).T)
        return d_out * keep + d_held * reset + self.p["u"].T @ d_gates + d_pass


class Network:
    def __init__(self, classes: int, units: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.ahead, self.behind = Direction(units, rng), Direction(units, rng)
        self.out = rng.normal(0, 0.3, (classes, 2 * units + 1)).astype(np.float32)
        self.units = units

    def states(self, data: np.ndarray, live: np.ndarray | None, keep: bool = False) -> tuple:
        """data: (time, batch). Both directions' states at each position, and what backpropagation needs."""
        t, n = data.shape
        found, caches = [], []
        for layer, order in ((self.ahead, range(t)), (self.behind, range(t - 1, -1, -1))):
            s, at, cache = np.zeros((self.units, n), np.float32), [None] * t, [None] * t
            for i in order:
                s, c = layer.step(data[i], s, None if live is None else live[i])
                at[i] = s
                if keep:
                    cache[i] = c
            found.append(at)
            caches.append(cache)
        return found, caches

    def label(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Probabilities of the classes (rows) at one position."""
        u = self.units
        z = self.out[:, :u] @ a + self.out[:, u : 2 * u] @ b + self.out[:, 2 * u :]
        z -= z.max(axis=0)
        np.exp(z, out=z)
        z /= z.sum(axis=0)
        return z

    def pooled(self, data: np.ndarray, live: np.ndarray | None) -> np.ndarray:
        """Sum of the class probabilities over the live positions of each column."""
        (a, b), _ = self.states(data, live)
        total = np.zeros((len(self.out), data.shape[1]), np.float32)
        for i in range(len(data)):
            p = self.label(a[i], b[i])
            total += p if live is None else p * live[i]
        return total

    def train(self, data: np.ndarray, y: np.ndarray, steps: int, batch: int, rate: float, seed: int = 11) -> Network:
        """data: (rows, time) of bytes; y: class of each row. Adam on the mean cross-entropy over positions."""
        rng = np.random.default_rng(seed)
        params = [(self.ahead.p, k) for k in "xuv"] + [(self.behind.p, k) for k in "xuv"]
        store = {"o": self.out}
        params.append((store, "o"))
        first, second = [np.zeros_like(d[k]) for d, k in params], [np.zeros_like(d[k]) for d, k in params]
        by_class = [np.flatnonzero(y == c) for c in range(len(self.out))]
        u = self.units
        for step in range(1, steps + 1):
            rows = np.concatenate([rng.choice(c, batch // len(by_class) + 1) for c in by_class])
            x, target = np.ascontiguousarray(data[rows].T), y[rows]
            (a, b), (ca, cb) = self.states(x, None, keep=True)
            t, n = x.shape
            d_out = np.zeros_like(self.out)
            da, db = [None] * t, [None] * t
            for i in range(t):
                p = self.label(a[i], b[i])
                p[target, np.arange(n)] -= 1
                p /= t * n
                d_out[:, :u] += p @ a[i].T
                d_out[:, u : 2 * u] += p @ b[i].T
                d_out[:, 2 * u] += p.sum(axis=1)
                da[i], db[i] = self.out[:, :u].T @ p, self.out[:, u : 2 * u].T @ p
            grads = []
            for layer, cache, d, order in ((self.ahead, ca, da, range(t - 1, -1, -1)), (self.behind, cb, db, range(t))):
                g = {k: np.zeros_like(v) for k, v in layer.p.items()}
                carry = np.zeros((u, n), np.float32)
                for i in order:
                    carry = layer.back(d[i] + carry, cache[i], g)
                grads += [g[k] for k in "xuv"]
            grads.append(d_out)
            now = rate * (1 - step / (steps + 1))
            for (d, k), g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                d[k] -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            self.out = store["o"]
        return self


def stretches(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, start, length) of every stretch; each text is cut from its start into stretches of STRETCH bytes and a rest."""
    size = np.diff(bounds)
    count = -(-size // STRETCH)
    owner = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = bounds[owner] + nth * STRETCH
    return owner, start, np.minimum(STRETCH, bounds[owner + 1] - start)


def predict(net: Network, data: np.ndarray, bounds: np.ndarray, columns: int = 1024) -> np.ndarray:
    """Mean class probabilities of each text (rows); zeros for empty ones."""
    owner, start, length = stretches(data, bounds)
    out = np.zeros((len(bounds) - 1, len(net.out)))
    full = length == STRETCH
    step = np.arange(STRETCH)[:, None]
    for part, whole in ((np.flatnonzero(full), True), (np.flatnonzero(~full)[np.argsort(length[~full], kind="stable")], False)):
        for i in range(0, len(part), columns):
            at = part[i : i + columns]
            if whole:
                total = net.pooled(data[start[at] + step], None)
            else:
                t = step[: length[at].max()]
                live = t < length[at]
                total = net.pooled(np.where(live, data[np.minimum(start[at] + t, len(data) - 1)], 32), live)
            for c in range(len(out[0])):
                out[:, c] += np.bincount(owner[at], weights=total[c], minlength=len(out))
    return out / np.maximum(1, np.diff(bounds))[:, None]


def learn(documents: DataFrame, most_docs: int = 4000, folds: int = 3, held_fold: int = 1, steps: int = 150, batch: int = 160, per_doc: int = 3) -> tuple[list[str], Network | None]:
    """Languages in code-point order, and the network that tells them apart."""
    known = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0))
    known = known.filter(shared.fold("doc_id", folds) != held_fold).withColumn("h", F.xxhash64("doc_id", F.lit(5)))
    langs = sorted(r[0] for r in known.select("lang").distinct().collect())
    if len(langs) < 2:
        return langs, None
    # at most about an equal share of each language, by a threshold on a hash; drawn as stretches, so that long texts do not reach the driver whole
    share = max(1, most_docs // len(langs))
    size = F.length("text")
    cuts = [F.substring("text", (1 + F.pmod(F.xxhash64("h", F.lit(k)), F.greatest(F.lit(1), size - STRETCH))).cast("int"), F.lit(STRETCH)) for k in range(per_doc)]
    limit = known.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(1.25 * share) / F.count("*")).alias("part"))
    drawn = known.join(F.broadcast(limit), "lang").filter(F.pmod("h", F.lit(1 << 20)) < F.greatest(F.col("part") * (1 << 20), F.lit(1.0)))
    by = Window.partitionBy("lang").orderBy("h", "c0")
    drawn = drawn.select("h", "lang", *[c.alias(f"c{k}") for k, c in enumerate(cuts)]).withColumn("nth", F.row_number().over(by)).filter(F.col("nth") <= share)
    rows = sorted(drawn.collect(), key=lambda r: (r["lang"], r["nth"]))
    data, y = [], []
    for r in rows:
        for k in range(per_doc):
            raw = r[f"c{k}"].encode()[:STRETCH]
            data.append(raw + (b" " + raw) * (STRETCH // (len(raw) + 1) + 1))
            y.append(langs.index(r["lang"]))
    bytes_ = np.frombuffer(b"".join(d[:STRETCH] for d in data), np.uint8).reshape(len(data), STRETCH)
    return langs, Network(len(langs)).train(bytes_[:, : STRETCH // 2], np.array(y), steps, batch, 0.03)


def identify(spark: SparkSession, documents: DataFrame, folds: int = 3, held_fold: int = 1, **how) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    langs, net = learn(documents, folds=folds, held_fold=held_fold, **how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.in_batches(batches, 1 << 21):
            letters = b.column("letters").to_numpy(zero_copy_only=False)
            if net is None:
                best, top = np.zeros(b.num_rows, dtype=int), np.ones(b.num_rows)
            else:
                p = predict(net, *shared.text_bytes(b.column("text")))
                best, top = p.argmax(axis=1), np.clip(p.max(axis=1), 0, 1)
            names = [langs[i] if ok and langs else UND for i, ok in zip(best, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(np.where(letters, top, 0.0) if langs else np.zeros(b.num_rows))], names=["doc_id", "lang_pred", "score"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    out = docs.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(shared.fold("doc_id", folds) == held_fold, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9(spark: SparkSession, documents: DataFrame) -> DataFrame:
    return identify(spark, documents)
