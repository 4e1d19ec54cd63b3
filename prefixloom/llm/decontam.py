"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity.

Words are runs of letters and digits, lower-cased; shingles are five words (all words of a shorter item). A window has as many
words as an item (or all words of a shorter document). Of two bags of a and b shingles with similarity t, t / (1 + t) * (a + b)
are common: every window that has so many places with a shingle of some item of its length is fingerprinted, wherever it
starts, and no other can reach the similarity. Where such windows stand is found for each distinct text, by its hash. Fingerprints of 128
bits are cut into 8 blocks of 16; two that differ in at most `radius` = 31 bits differ in at most 3 on some block, so every item
is listed under all block values that near, and joining on (length, block, bits) finds every pair within the radius. Bags of
similarity 0.8 differ in 19 bits on average. Candidates are verified by weighted Jaccard similarity of their shingles,
weighted by how often they occur: at or above `similarity` an item's passage is reported. Of equally similar windows the first is.

DataFrame functions only. Benchmark shingles are joined in slices of at most SLICE rows, each broadcast, and the starts found
are met with their texts again in slices too, so that texts are never shuffled, however large the benchmark.

Nulls: null or word-free texts and items match nothing; a null doc_id is reported as null. Repeated rows give the same matches
once for each id. An item of one word is found wherever that word stands. Very long texts are read whole. Empty tables give no row. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

SHINGLE, SIMILARITY, SLICE = 5, 0.8, 500_000
#: Bits in which fingerprints of 128 may differ, and the blocks that they are cut into.
RADIUS, BLOCKS = 31, 8
#: Texts with windows to try are met again in slices of at most so many rows.
TEXTS = 100_000


def words(text: Column) -> Column:
    """A hash for each word."""
    return F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != ""), lambda x: F.xxhash64(x))


def grams(w: Column, size: int) -> Column:
    """A hash for every position of an array of words: of the `size` words from there (at the end: of those that are left)."""
    return F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, size)]))


def placed_grams(w: Column, size: int) -> Column:
    return F.transform(grams(w, size), lambda x, i: F.struct(F.lit(size).alias("g"), i.alias("pos"), x.alias("gram")))


def shingles(w: Column, size: int = SHINGLE) -> Column:
    """Hashes of all full shingles, or of all words where there are fewer."""
    return F.when(F.size(w) > 0, F.slice(grams(w, size), 1, F.greatest(F.lit(1), F.size(w) - (size - 1)))).otherwise(F.array().cast("array<long>"))


def simhash(s: Column, most: int) -> Column:
    """Bit b is set where most of the shingles' hashes have it set; at most `most` shingles.

    All 64 counts are kept side by side: bit b of plane k is bit k of the count of bit b, so that adding a hash takes a few bit operations."""
    planes = max(1, most.bit_length())

    def add(acc: Column, h: Column) -> Column:
        carry, out = h, []
        for k in range(planes):
            out.append(F.get(acc, F.lit(k)).bitwiseXOR(carry))
            carry = F.get(acc, F.lit(k)).bitwiseAND(carry)
        return F.array(*out)

    def over_half(acc: Column) -> Column:
        """Bits whose count is at least half the number of shingles and one half: compared from the highest plane down."""
        more, equal = F.lit(0).cast("long"), F.lit(-1).cast("long")
        for k in reversed(range(planes)):
            plane = F.get(acc, F.lit(k))
            bound = -F.shiftright(F.floor(F.size(s) / 2) + 1, k).bitwiseAND(1)
            more = more.bitwiseOR(equal.bitwiseAND(plane).bitwiseAND(F.bitwise_not(bound)))
            equal = equal.bitwiseAND(F.bitwise_not(plane.bitwiseXOR(bound)))
        return more.bitwiseOR(equal)

    return F.aggregate(s, F.array(*[F.lit(0).cast("long")] * planes), add, over_half)


def fingerprint(s: Column, most: int) -> Column:
    """128 bits as two longs."""
    return F.array(simhash(s, most), simhash(F.transform(s, lambda x: F.xxhash64(x, F.lit(1))), most))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def blocks(f: Column, n: int, spread: int = 0) -> Column:
    """n stretches of bits that cover the fingerprint: array of struct(block, bits), with all bits at most `spread` away from each."""
    width = 128 // n
    part = [F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(f[k * width // 64], k * width % 64).bitwiseAND((1 << width) - 1).alias("bits")) for k in range(n)]
    if not spread:
        return F.array(*part)
    masks = [m for m in range(1 << width) if m.bit_count() <= spread]
    near = F.transform(F.split(F.lit(",".join(map(str, masks))), ","), lambda m: m.cast("long"))
    return F.flatten(F.transform(F.array(*part), lambda x: F.transform(near, lambda m: F.struct(x["block"].alias("block"), x["bits"].bitwiseXOR(m).alias("bits")))))


def overlap(a: Column, b: Column) -> Column:
    """Sum over distinct shingles of the smaller of their counts in a and b."""
    both = F.array_intersect(a, b)
    count = lambda s, x: F.size(F.filter(s, lambda y: y == x))
    return F.aggregate(both, F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x)))


def starts(at: Column, size: Column, n: Column, similarity: float) -> Column:
    """Starts of all windows of n words that can have the similarity. at: sorted positions of shared shingles in a text of `size` words."""
    full = lambda x: F.greatest(F.lit(1), x - (SHINGLE - 1))
    own = full(F.least(n, size))
    need = F.greatest(F.lit(1), F.ceil((own + full(n)) * (similarity / (1 + similarity)) - 1e-6).cast("int"))
    # from each position on: the windows that hold it and the need - 1 next ones
    first = F.slice(at, 1, F.greatest(F.lit(0), F.size(at) - need + 1))
    spans = F.transform(first, lambda p, i: F.struct(F.greatest(F.lit(0), F.get(at, i + need - 1) - own + 1).alias("a"), F.least(p, F.greatest(F.lit(0), size - n)).alias("b")))
    spans = F.filter(spans, lambda x: x["a"] <= x["b"])
    return F.array_distinct(F.flatten(F.transform(spans, lambda x: F.sequence(x["a"], x["b"]))))


def matches(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, n_blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, item_id, start, n_words, distance, similarity): each document's best window for each item that it holds."""
    scratch = shared.Scratch(spark, "decontam")
    items = benchmark.select("item_id", F.xxhash64("item_id", F.col("text").cast("string")).alias("item"), words(F.col("text").cast("string")).alias("w")).filter(F.size("w") > 0)
    items = scratch.save(items.dropDuplicates(["item"]).select("item_id", "item", F.size("w").alias("n"), shingles(F.col("w")).alias("s")))
    sizes = items.agg(F.max(F.size("s")), *[F.max((F.least("n", F.lit(SHINGLE)) == g).cast("int")) for g in range(1, SHINGLE + 1)]).first()
    most, lengths = sizes[0] or 1, [g for g in range(1, SHINGLE + 1) if sizes[g]]
    items = scratch.save(items.withColumn("f", fingerprint(F.col("s"), most)))
    anchors = scratch.save(items.select(F.least("n", F.lit(SHINGLE)).alias("g"), "n", F.explode("s").alias("gram")).distinct())
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    docs = texts.select("h", words(F.col("text")).alias("w"))
    # every text is read once for all lengths of shingles
    every = [placed_grams(F.col("w"), g) for g in lengths or [SHINGLE]]
    placed = docs.select("h", F.size("w").alias("size"), F.explode(F.flatten(F.array(*every))).alias("x")).select("h", "size", "x.*")
    slices, found = max(1, -(-anchors.count() // SLICE)), None
    for k in range(slices):
        hits = placed.join(F.broadcast(anchors.filter(F.pmod(F.xxhash64("gram", "n"), F.lit(slices)) == k)), ["g", "gram"]).select("h", "size", "n", "pos")
        found = hits if found is None else found.unionByName(hits)
    runs = found.groupBy("h", "n").agg(F.max("size").alias("size"), F.array_sort(F.collect_set("pos")).alias("at"))
    wanted = runs.select("h", "n", starts(F.col("at"), F.col("size"), F.col("n"), similarity).alias("starts")).filter(F.size("starts") > 0)
    wanted = scratch.save(wanted.groupBy("h").agg(F.collect_list(F.struct("n", "starts")).alias("at")))
    pieces, windows = max(1, -(-wanted.count() // TEXTS)), None
    for k in range(pieces):
        part = F.broadcast(wanted.filter(F.pmod(F.xxhash64("h"), F.lit(pieces)) == k))
        piece = texts.join(part, "h").select("doc_id", "h", words(F.col("text")).alias("w"), F.explode("at").alias("x"))
        piece = piece.select("doc_id", "h", "w", F.col("x.n").alias("n"), F.explode("x.starts").alias("start")).select("doc_id", "h", "n", "start", F.slice("w", F.col("start") + 1, F.col("n")).alias("w"))
        windows = piece if windows is None else windows.unionByName(piece)
    windows = windows.dropDuplicates(["doc_id", "h", "n", "start"]).withColumn("s", shingles(F.col("w"))).drop("w").filter(F.size("s") > 0)
    windows = scratch.save(windows.withColumn("f", fingerprint(F.col("s"), most)))
    # two fingerprints within the radius are at most radius // n_blocks bits apart on some block
    left = windows.select("doc_id", "h", "n", "start", F.explode(blocks(F.col("f"), n_blocks)).alias("x"))
    right = items.join(windows.select("n").distinct(), "n", "left_semi").select("item", "n", F.explode(blocks(F.col("f"), n_blocks, radius // n_blocks)).alias("x"))
    near = left.join(right.hint("merge"), ["n", "x"]).select(F.col("doc_id").alias("doc"), F.col("h").alias("h1"), F.col("n").alias("n1"), F.col("start").alias("start1"), "item").distinct()
    near = windows.join(near, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("h") == F.col("h1")) & (F.col("n") == F.col("n1")) & (F.col("start") == F.col("start1"))).select("doc_id", "n", "start", "s", "f", "item")
    near = near.join(items.select("item", "item_id", F.col("s").alias("s2"), F.col("f").alias("f2")), "item").withColumn("distance", distance(F.col("f"), F.col("f2"))).filter(F.col("distance") <= radius)
    same = overlap(F.col("s"), F.col("s2"))
    near = near.withColumn("same", same).withColumn("similarity", F.col("same") / (F.size("s") + F.size("s2") - F.col("same"))).filter(F.col("similarity") >= similarity)
    best = F.min(F.struct((-F.col("similarity")).alias("k"), "start", "n", "distance")).alias("b")
    out = near.groupBy("doc_id", "item_id").agg(best)
    return out.select("doc_id", "item_id", F.col("b.start").alias("start"), F.col("b.n").alias("n_words"), F.col("b.distance").alias("distance"), (-F.col("b.k")).alias("similarity"))


def op5(spark: SparkSession, documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return matches(spark, documents, benchmark)


def drop_contaminated(spark: SparkSession, documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a benchmark passage, with their columns."""
    bad = matches(spark, documents, benchmark).select(F.col("doc_id").alias("bad__")).distinct()
    return documents.join(bad, documents["doc_id"].eqNullSafe(bad["bad__"]), "left_anti")
