"""Dense statistics of whole texts, computed over batches of UTF-8 bytes in numpy: inputs of the toxicity and quality models.

A null text counts as empty; an empty text has zeros throughout. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Words that insult.
INSULTS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
#: Words that address the reader, in English, German, French and Spanish.
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "toi", "ton", "ta", "vous", "votre", "tú", "ti", "tuyo", "usted", "ustedes", "vosotros")

_B = np.arange(256)
UPPER, LOWER, DIGIT = (_B >= 65) & (_B <= 90), (_B >= 97) & (_B <= 122), (_B >= 48) & (_B <= 57)
HIGH, LEAD = _B >= 128, (_B < 128) | (_B >= 192)
SPACE = np.isin(_B, [9, 10, 11, 12, 13, 32])
PUNCT = (_B > 32) & (_B < 127) & ~UPPER & ~LOWER & ~DIGIT
LETTER = UPPER | LOWER | HIGH
FOLD = np.where(UPPER, _B + 32, _B).astype(np.uint8)
#: Characters written for letters.
DISGUISE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
UNMASK, MASKED = FOLD.copy(), LETTER.copy()
for _a, _b in DISGUISE.items():
    UNMASK[ord(_a)], MASKED[ord(_a)] = ord(_b), True


def hashes(words: tuple[str, ...]) -> np.ndarray:
    raw = [w.encode() for w in words]
    data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(w) for w in raw])
    return np.sort(shared.span_hash(shared.prefix_sums(data), ends - [len(w) for w in raw], ends))


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs that no text bound crosses."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = bounds[1:-1][(bounds[1:-1] < len(inside)) & (bounds[1:-1] > 0)]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[bounds]).astype(float)


def at_text(where: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of the sorted positions lie in each text."""
    return np.diff(np.searchsorted(where, bounds)).astype(float)


def known(h: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    return lexicon[np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)] == h


_INSULTS, _SECOND = hashes(INSULTS), hashes(SECOND_PERSON)

TOXIC_NAMES = ("learned_sum", "learned_rate", "learned_likely", "learned_sure", "learned_most", "insult_rate", "insults", "kinds_bound", "masked_rate", "masked", "second_rate", "near_second", "capital_rate", "capital_words", "punct_rate", "bang_rate", "star_rate", "digit_rate", "word_length", "log_words")


#: Lengths in bytes of the word beginnings that a learned lexicon may hold beside whole words.
STEMS = range(3, 10)


def terms(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For whole words, then for each length of stem: indices of the words that have it, and its hash."""
    yield np.arange(len(starts)), shared.span_hash(sums, starts, ends)
    for k in STEMS:
        at = np.flatnonzero(ends - starts >= k)
        yield at, shared.span_hash(sums, starts[at], starts[at] + k) ^ shared.GOLD


def word_weights(lexicon: tuple[np.ndarray, np.ndarray], sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The largest weight in the lexicon (sorted hashes, weights) of each word's terms, else 0."""
    keys, weights = lexicon
    out = np.zeros(len(starts))
    if len(keys):
        sieve = np.zeros(1 << 16, dtype=bool)
        sieve[keys & np.uint64(0xFFFF)] = True
        for at, h in terms(sums, starts, ends):
            maybe = np.flatnonzero(sieve[h & np.uint64(0xFFFF)])
            place = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
            hit = keys[place] == h[maybe]
            np.maximum.at(out, at[maybe[hit]], weights[place[hit]])
    return out


def toxic_features(data: np.ndarray, bounds: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0))) -> np.ndarray:
    """A row a text: lexicon densities (fixed and learned), second-person proximity, capitals, punctuation and obfuscation rates."""
    n = np.maximum(1.0, np.diff(bounds))
    starts, ends = runs(LETTER[data], bounds)
    folded = shared.prefix_sums(FOLD[data])
    h = shared.span_hash(folded, starts, ends)
    words = at_text(starts, bounds)
    w = np.maximum(1.0, words)
    weight = word_weights(lexicon, folded, starts, ends)
    heavy = np.flatnonzero(weight)
    owner = np.searchsorted(bounds, starts[heavy], side="right") - 1
    learned, most = np.bincount(owner, weights=weight[heavy], minlength=len(n)), np.zeros(len(n))
    np.maximum.at(most, owner, weight[heavy])
    likely, sure = (at_text(starts[weight >= t], bounds) for t in (3.0, 4.0))
    bad, you = np.flatnonzero(known(h, _INSULTS) | (weight >= 4.0)), np.flatnonzero(known(h, _SECOND))
    insults, second = at_text(starts[bad], bounds), at_text(starts[you], bounds)
    ms, me = runs(MASKED[data], bounds)
    plain = LETTER[data]
    mixed = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(~plain, out=mixed[1:])
    odd = np.flatnonzero((mixed[me] > mixed[ms]) & (me - ms > 3) & (me - ms < 24))
    sums = shared.prefix_sums(UNMASK[data])
    # marks at the end of a word are punctuation, not letters
    tail = me[odd].copy()
    for _ in range(3):
        tail = np.where((tail > ms[odd]) & ~plain[np.maximum(tail - 1, 0)] if len(odd) else np.zeros(0, bool), tail - 1, tail)
    hit = (known(shared.span_hash(sums, ms[odd], me[odd]), _INSULTS) | known(shared.span_hash(sums, ms[odd], tail), _INSULTS)) & (mixed[tail] > mixed[ms[odd]])
    masked = at_text(ms[odd][hit], bounds)
    near = np.zeros(len(bounds) - 1)
    if len(bad) and len(you):
        text = np.searchsorted(bounds, starts[bad], side="right") - 1
        for k in (-1, 0):
            other = you[np.clip(np.searchsorted(you, bad) + k, 0, len(you) - 1)]
            same = np.searchsorted(bounds, starts[other], side="right") - 1 == text
            np.maximum.at(near, text, np.where(same, 1.0 / (1 + np.abs(other - bad)), 0.0))
    capital = UPPER[data]
    caps = per_text(capital, bounds)
    total = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(capital, out=total[1:])
    shouted = at_text(starts[(total[ends] - total[starts] == ends - starts) & (ends - starts > 1)], bounds)
    rate = [per_text(t[data], bounds) / n for t in (PUNCT, _B == 33, (_B == 42) | (_B == 36) | (_B == 64) | (_B == 35), DIGIT)]
    letters = at_text(np.flatnonzero(plain), bounds)
    return np.column_stack([learned, learned / w, likely, sure, most, 100 * insults / w, np.minimum(insults, 50), np.minimum(insults, w) / (1 + np.log1p(w)), 100 * masked / w, np.minimum(masked, 50), second / w, near, caps / n, shouted / w, *rate, letters / w, np.log1p(words)])


QUALITY_NAMES = ("log_bytes", "log_words", "word_length", "word_spread", "capital_rate", "shouted_rate", "punct_rate", "symbol_rate", "bang_rate", "pipe_rate", "digit_rate", "stop_rate", "high_rate", "line_words", "line_repeats", "word_repeats", "pair_repeats", "marked_words", "short_words")


def quality_features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row a text of transformed statistics (logs of counts, logs of odds of rates)."""
    size = np.diff(bounds).astype(float)
    n = np.maximum(1.0, size)
    starts, ends, at = shared.words_of(data, bounds)
    words = np.diff(at).astype(float)
    w = np.maximum(1.0, words)
    length = (ends - starts).astype(float)
    total = np.concatenate([[0.0], np.cumsum(length)])
    square = np.concatenate([[0.0], np.cumsum(length**2)])
    mean = np.diff(total[at]) / w
    spread = np.sqrt(np.maximum(0, np.diff(square[at]) / w - mean**2))
    sums = shared.prefix_sums(FOLD[data])
    h = shared.span_hash(sums, starts, ends)
    capital, letter = UPPER[data], LETTER[data]
    c = np.concatenate([[0], np.cumsum(capital, dtype=np.int64)])
    m = np.concatenate([[0], np.cumsum(PUNCT[data], dtype=np.int64)])
    shouted = at_text(starts[c[ends] - c[starts] >= 2], bounds)
    marked = at_text(starts[m[ends] - m[starts] >= 2], bounds)
    short = at_text(starts[length <= 2], bounds)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(at))

    def repeats(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Share of each text's values that stood before in it."""
        if not len(values):
            return np.zeros(len(bounds) - 1)
        order = np.lexsort((values, owner))
        v, o = values[order], owner[order]
        again = np.concatenate([[False], (v[1:] == v[:-1]) & (o[1:] == o[:-1])])
        count = np.bincount(owner, minlength=len(bounds) - 1)
        return np.bincount(o[again], minlength=len(bounds) - 1) / np.maximum(1, count)

    pair = shared.mix(h[:-1] * shared.GOLD + h[1:])[text[1:] == text[:-1]] if len(h) > 1 else np.zeros(0, np.uint64)
    ls, le = runs(data != 10, bounds)
    line_text = np.searchsorted(bounds, ls, side="right") - 1
    lines = np.maximum(1.0, np.bincount(line_text, minlength=len(bounds) - 1))

    def odds(x: np.ndarray) -> np.ndarray:
        return np.log((x + 1e-3) / (1.001 - np.minimum(x, 1.0)))

    rates = [per_text(t[data], bounds) / n for t in (UPPER, PUNCT, PUNCT & ~np.isin(_B, [33, 39, 40, 41, 44, 45, 46, 58, 59, 63]), _B == 33, _B == 124, DIGIT, _B == 46, HIGH)]
    return np.column_stack([
        np.log1p(size), np.log1p(words), np.log1p(mean), np.log1p(spread), odds(rates[0]), odds(shouted / w), *[odds(r) for r in rates[1:]],
        np.log1p(words / lines), odds(repeats(shared.span_hash(sums, ls, le), line_text)), odds(repeats(h, text)), odds(repeats(pair, text[1:][text[1:] == text[:-1]] if len(h) > 1 else text[:0])), odds(marked / w), odds(short / w),
    ])


def featured(documents: DataFrame, compute: Callable, names: tuple[str, ...]) -> DataFrame:
    """(doc_id, one double column a feature) of every document."""
    schema = pa.schema([("doc_id", pa.int64()), *[(f"f_{x}", pa.float64()) for x in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.in_batches(batches):
            if b.num_rows:
                rows = compute(*shared.text_bytes(b.column("text")))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(rows[:, i]) for i in range(len(names))]], schema=schema)

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, ", ".join(["doc_id long", *[f"f_{x} double" for x in names]]))


def drawn(labels: DataFrame, most: int) -> DataFrame:
    """About 1.25 * most of the rows (doc_id, ...) by a threshold on a hash of the id, all if there are no more: what is sorted and collected after does not grow with the table."""
    n = labels.count()
    return labels if n * 4 <= most * 5 else labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * 1.25 * most / n))


def labelled_sample(features: DataFrame, labels: DataFrame, label: str, names: tuple[str, ...], most: int, folds: int = 5, held_fold: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and a hash of at most `most` labelled rows outside the held-out fold, in an order that ids alone decide."""
    y = labels.filter(F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(shared.fold("doc_id", folds) != held_fold)
    cols = [f"f_{x}" for x in names]
    y = drawn(y, most)
    rows = y.join(features, "doc_id").select(F.xxhash64("doc_id").alias("h"), "y", *cols).orderBy("h", "y", *cols).limit(most).toPandas()
    return rows[cols].to_numpy(float).reshape(len(rows), len(cols)), rows["y"].to_numpy(float), rows["h"].to_numpy(np.int64)


def scored(features: DataFrame, names: tuple[str, ...], model: Callable[[np.ndarray], np.ndarray], threshold: float, folds: int = 5, held_fold: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = np.clip(model(np.column_stack([b.column(f"f_{x}").to_numpy() for x in names])), 0.0, 1.0)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    out = features.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(shared.fold("doc_id", folds) == held_fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
