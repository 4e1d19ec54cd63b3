"""Suffix-array dedup: bytes covered by a string of `least` bytes that also starts elsewhere are removed.

Windows of `least` bytes meet by their minimizer: of the hashed GRAM-byte strings in a window the least, leftmost at ties, is
the same wherever the window stands, and each window has one. Windows that share a minimizer occurrence are a stretch of
text. A minimizer that occurs once has no repeated window; stretches that are equal as a whole repeat as a whole; groups of
different stretches are told apart by an exact index:

the stretches of many groups are concatenated, sorted into a suffix array, and common prefixes derived by backward extension
on the Burrows-Wheeler transform: breadth first, intervals of strings of length l give all neighbours with a common prefix of
just l bytes, for increasing l, stopping at `least`. Neighbours left open share `least` bytes or more. Prefixes below FIRST
bytes are read off the sorted bytes. A window counts at its own minimizer only, so that no place is taken for two.

A group of more than CROWD different stretches (a common passage amid different texts) is split by the offset of its windows from the minimizer,
in pieces of 16 and then of one: a piece's key is a hash of the bytes that all its windows share. Each of the last pieces is a
window, met by hash alone. So no task holds all of a hot group, and no repeat is lost. Equality across groups rests on two 64-bit hashes.

Nulls: a null text is empty, a null doc_id a name like any other. Texts under `least` bytes lose nothing. Repeated rows are
documents of their own and repeat each other. An empty table gives no row. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

LEAST, GRAM, FIRST, CROWD, BLOCK = 400, 128, 16, 64, 1 << 20
#: Bits of the broadcast bitmap that tells which texts have places: 2 MB of bits, as 262 144 rows at most.
MARKS = 1 << 24
STRETCHES = "doc_id long, th long, lo int, hi int, at int, key long, ctx long"


def stretches(data: np.ndarray, bounds: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first start, last start, minimizer, its hash, hash of the whole stretch); places count from the text's beginning."""
    gram = min(gram, max(1, least // 3))
    n, wide = len(data), least - gram + 1
    windows = n - least + 1
    if windows < 1:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    sums = shared.prefix_sums(data)
    at = np.arange(n - gram + 1)
    h = shared.span_hash(sums, at, at + gram)
    bits = np.uint64(max(1, int(n).bit_length()))
    key = (h >> bits << bits) | at.astype(np.uint64)
    size = -(-len(key) // wide) * wide
    grid = np.full(size, np.uint64(2**64 - 1))
    grid[: len(key)] = key
    grid = grid.reshape(-1, wide)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    best = (np.minimum(behind[:windows], ahead[wide - 1 : wide - 1 + windows]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    valid = np.zeros(windows + 1, dtype=np.int32)
    ok = np.flatnonzero(np.diff(bounds) >= least)
    np.add.at(valid, bounds[ok], 1)
    np.add.at(valid, bounds[ok + 1] - least + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    same = (best[1:] == best[:-1]) & valid[1:] & valid[:-1]
    lo = np.flatnonzero(valid & ~np.concatenate([[False], same]))
    hi = np.flatnonzero(valid & ~np.concatenate([same, [False]]))
    p = best[lo]
    text = np.searchsorted(bounds, lo, side="right") - 1
    whole = shared.mix(shared.span_hash(sums, lo, hi + least) + (p - lo).astype(np.uint64) * shared.GOLD)
    base = bounds[text]
    return text, lo - base, hi - base, p - base, h[p], whole


def pieces(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, width: int, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """The stretches of one text cut by the windows' offsets from the minimizer, in multiples of width; the key is a hash of what a piece's windows share."""
    low, high = (at - hi) // width, (at - lo) // width
    count = high - low + 1
    owner = np.repeat(np.arange(len(lo)), count)
    c = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + low[owner]
    last, first = at[owner] - c * width, at[owner] - c * width - width + 1
    sums = shared.prefix_sums(data)
    key = shared.mix(shared.span_hash(sums, last, first + least) + (c + 1).astype(np.uint64) * shared.GOLD)
    a, b = np.maximum(first, lo[owner]), np.minimum(last, hi[owner])
    whole = shared.mix(shared.span_hash(sums, a, b + least) + (at[owner] - a).astype(np.uint64) * shared.GOLD)
    return a, b, at[owner], key, whole


def suffix_ranks(text: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks of symbols that hold a unique one every now and then, by prefix doubling from four symbols on."""
    n = len(text)
    wide = np.zeros(n + 4, dtype=np.int64)
    wide[:n] = text + 1
    b = np.int64(max(1, int(text.max()) + 2))
    bits = int(b).bit_length()
    key = wide[:n].copy()
    done = 1
    while done < 4 and bits * (done + 1) < 63:
        key = (key << bits) | wide[done : n + done]
        done += 1
    rank = np.empty(n, dtype=np.int64)
    while True:
        order = np.argsort(key, kind="stable")
        k = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        if rank[order[-1]] == n - 1 or done >= 2 * n:
            return order, rank
        key = (rank + 1) << 32
        key[: n - done] |= rank[done:] + 1 if done < n else 0
        done *= 2


def open_neighbours(text: np.ndarray, separators: int, least: int, first: int = FIRST) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, open): open[i] tells whether suffixes i - 1 and i of the array share `least` symbols or more.

    Symbols below `separators` stand once each and end a stretch."""
    n = len(text)
    order, rank = suffix_ranks(text, least)
    first = min(first, least)
    wide = np.concatenate([text, np.full(first, -1)])
    common = np.zeros(n, dtype=np.int64)
    live = np.arange(1, n)
    for k in range(first):
        live = live[(wide[order[live] + k] == wide[order[live - 1] + k])]
        common[live] = k + 1
    is_open = common >= first
    is_open[0] = False
    if first >= least:
        return order, is_open
    # intervals of strings of `first` symbols that end where the common prefix is first - 1
    ends = np.append(np.flatnonzero(~is_open), n)
    begin, end = ends[:-1], ends[1:]
    ok = (end < n) & (np.append(common, -1)[end] == first - 1)
    lo, hi = begin[ok], end[ok]
    back = rank[order - 1]  # where the suffix one to the left stands
    left = text[order - 1]
    left[order == 0] = 0
    gate = np.append(is_open, False)
    for _ in range(first, least):
        if not len(lo):
            break
        size = hi - lo
        owner = np.repeat(np.arange(len(lo)), size)
        row = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + lo[owner]
        ok = left[row] >= separators
        owner, row = owner[ok], row[ok]
        to = back[row]
        o = np.argsort(to)
        to, owner, symbol = to[o], owner[o], left[row[o]]
        cut = np.ones(len(to), dtype=bool)
        cut[1:] = (to[1:] != to[:-1] + 1) | (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])
        start = np.flatnonzero(cut)
        lo, hi = to[start], to[np.append(start[1:], len(to)) - 1] + 1 if len(to) else to
        ok = gate[hi]
        lo, hi = lo[ok], hi[ok]
        gate[hi] = False
    return order, gate[:n]


def repeated_starts(parts: list[np.ndarray], owned: np.ndarray, times: np.ndarray, least: int = LEAST) -> list[np.ndarray]:
    """For each stretch the flags of its starts 0 .. owned - 1 whose window also starts in another, or stands `times` > 1 times."""
    sep = len(parts)
    text = np.concatenate([np.concatenate([p.astype(np.int64) + sep, [i]]) for i, p in enumerate(parts)])
    length = np.array([len(p) + 1 for p in parts])
    base = np.cumsum(length) - length
    mine = np.zeros(len(text), dtype=np.int64)
    for b, o, t in zip(base.tolist(), owned.tolist(), times.tolist(), strict=True):
        mine[b : b + o] = t
    order, is_open = open_neighbours(text, sep, least)
    group = np.cumsum(~is_open)
    flag = np.zeros(len(text), dtype=bool)
    flag[order] = np.bincount(group, weights=mine[order])[group] > 1
    return [flag[b : b + o] for b, o in zip(base.tolist(), owned.tolist(), strict=True)]


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]])))
    return edge[::2], edge[1::2] - 1


def marked(texts: DataFrame, places: DataFrame) -> DataFrame:
    """Texts with near__: false only where no place belongs to a text. A bitmap of hashes tells, MARKS bits whatever the input; full, it lets all pass."""
    bit = f"pmod(th, {MARKS}L)"
    words = places.select(F.expr(f"shiftright({bit}, 6) AS word__"), F.expr(f"shiftleft(1L, int({bit} % 64)) AS bit__")).groupBy("word__").agg(F.bit_or("bit__").alias("bits__"))
    near = F.expr(f"coalesce(shiftrightunsigned(bits__, int({bit} % 64)) & 1L, 0L) = 1L")
    return texts.withColumn("word__", F.expr(f"shiftright({bit}, 6)")).join(F.broadcast(words), "word__", "left").withColumn("near__", near).drop("word__", "bits__")


def with_places(texts: DataFrame, places: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    """Texts with the array `places` of structs of cols that belong to each. Only texts that may have one are shuffled."""
    rows = places.groupBy("doc_id", "th").agg(F.collect_list(F.struct(*cols)).alias("places")).withColumnRenamed("doc_id", "id__").withColumnRenamed("th", "th__")
    known = marked(texts, places)
    near = known.filter("near__").drop("near__")
    found = near.join(rows, (near["th"] == rows["th__"]) & near["doc_id"].eqNullSafe(rows["id__"]), how).drop("id__", "th__")
    if how == "inner":
        return found
    return found.unionByName(known.filter("not near__").drop("near__").withColumn("places", F.lit(None).cast(rows.schema["places"].dataType)))


def first_stretches(texts: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.in_batches(batches):
            text, lo, hi, at, key, ctx = stretches(*shared.text_bytes(b.column("text")), least)
            i = pa.array(text)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(i), b.column("th").take(i), *[pa.array(x.astype(np.int32)) for x in (lo, hi, at)], *[pa.array(x.view(np.int64)) for x in (key, ctx)]], names=["doc_id", "th", "lo", "hi", "at", "key", "ctx"])

    return texts.mapInArrow(run, STRETCHES)


def next_stretches(texts: DataFrame, places: DataFrame, width: int, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.in_batches(batches):
            for doc, th, text, at in zip(*[b.column(c).to_pylist() for c in ("doc_id", "th", "text", "places")], strict=True):
                rows = np.unique(np.array([(p["lo"], p["hi"], p["at"]) for p in at], dtype=np.int64), axis=0)
                found = pieces(np.frombuffer(text.encode(), np.uint8), rows[:, 0], rows[:, 1], rows[:, 2], width, least)
                n = len(found[0])
                yield pa.RecordBatch.from_arrays([pa.array([doc] * n, pa.int64()), pa.array([th] * n, pa.int64()), *[pa.array(x.astype(np.int32)) for x in found[:3]], *[pa.array(x.view(np.int64)) for x in found[3:]]], names=["doc_id", "th", "lo", "hi", "at", "key", "ctx"])

    return with_places(texts, places, ["lo", "hi", "at"]).select("doc_id", "th", "text", "places").mapInArrow(run, STRETCHES)


def indexed(texts: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """(key, ctx, a, b): runs of repeated starts, from a stretch's first start, of the classes (key, ctx, n, doc_id, th, lo, hi)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.in_batches(batches):
            rows = []
            for text, at in zip(b.column("text").to_pylist(), b.column("places").to_pylist(), strict=True):
                raw = text.encode()
                rows += [(p["key"], p["ctx"], p["n"], p["hi"] - p["lo"] + 1, raw[p["lo"] : p["hi"] + least]) for p in at]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["key", "ctx", "n", "owned", "bytes"])

    def block(rows: list[dict]) -> pa.RecordBatch:
        flags = repeated_starts([np.frombuffer(r["bytes"], np.uint8) for r in rows], np.array([r["owned"] for r in rows]), np.array([r["n"] for r in rows]), least)
        out = [(r["key"], r["ctx"], int(a), int(z)) for r, f in zip(rows, flags, strict=True) for a, z in zip(*runs_of(f), strict=True)]
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["key", "ctx", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size, key = 0, None
        for b in shared.in_batches(batches):
            for r in b.to_pylist():
                if size >= BLOCK and r["key"] != key:
                    yield block(held)
                    held, size = [], 0
                held.append(r)
                size, key = size + len(r["bytes"]), r["key"]
        if held:
            yield block(held)

    found = with_places(texts, classes, ["key", "ctx", "n", "lo", "hi"]).select("text", "places").mapInArrow(cut, "key long, ctx long, n long, owned int, bytes binary")
    parts = shared.partitions(texts.sparkSession)
    return found.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, "key long, ctx long, a int, b int")


def repeated(spark: SparkSession, texts: DataFrame, scratch: shared.Scratch, least: int = LEAST, crowd: int = CROWD) -> DataFrame:
    """(doc_id, th, lo, hi): ranges of window starts that repeat, from (doc_id, th, text)."""
    found: list[DataFrame] = []
    rows = scratch.save(first_stretches(texts, least))
    for width in (16, 1, 0):
        groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("ctx").alias("c1"), F.max("ctx").alias("c2")).filter("n > 1")
        # tables that are joined are written first: a hot key's rows can then be split over tasks
        groups = scratch.save(groups.select("key", (F.col("c1") == F.col("c2")).alias("even")))
        active = scratch.save(rows.join(groups, "key"))
        scratch.drop(rows)
        found.append(active.filter("even").select("doc_id", "th", "lo", "hi"))
        mixed = active.filter("not even")
        classes = mixed.groupBy("key", "ctx").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("doc_id", "th", "lo", "hi", "at")])
        classes = scratch.save(classes)
        crowded = scratch.save(classes.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > crowd).select("key"))
        runs = scratch.save(indexed(texts, classes.join(crowded, "key", "left_anti"), least))
        found.append(mixed.join(runs, ["key", "ctx"]).select("doc_id", "th", (F.col("lo") + F.col("a")).alias("lo"), (F.col("lo") + F.col("b")).alias("hi")))
        if not width or not crowded.take(1):
            break
        # of a crowded group's equal stretches all repeat, and one stands for them against the others
        hot = scratch.save(classes.join(crowded, "key", "left_semi"))
        found.append(mixed.join(hot.filter("n > 1").select("key", "ctx"), ["key", "ctx"]).select("doc_id", "th", "lo", "hi"))
        rows = scratch.save(next_stretches(texts, hot.select("doc_id", "th", "lo", "hi", "at"), width, least))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return scratch.save(out)


def clean(spark: SparkSession, documents: DataFrame, least: int = LEAST, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary) of every document."""
    scratch = shared.Scratch(spark, "repeats")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    ranges = repeated(spark, texts, scratch, least, crowd)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.in_batches(batches):
            rows = []
            for text, places in zip(b.column("text").to_pylist(), b.column("places").to_pylist(), strict=True):
                raw = text.encode()
                gone = np.zeros(len(raw) + 1, dtype=np.int64)
                if places:
                    at = np.array([(p["lo"], p["hi"] + least) for p in places], dtype=np.int64)
                    np.add.at(gone, at[:, 0], 1)
                    np.add.at(gone, at[:, 1], -1)
                gone = np.cumsum(gone[:-1]) > 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if gone.any() else raw
                rows.append((len(raw), len(raw) - len(kept), len(runs_of(gone)[0]), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    cut = with_places(texts, ranges, ["lo", "hi"], "left").select("doc_id", "text", "places")
    return cut.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op7(spark: SparkSession, documents: DataFrame) -> DataFrame:
    return clean(spark, documents).drop("kept")
