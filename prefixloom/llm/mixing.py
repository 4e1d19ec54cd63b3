"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks, in DataFrame functions only.

Targets: each source's weighted share of the words asked for, at most `most` times its size, the excess shared again
by weight (water-filling, in closed form over the sources sorted by the level at which they fill up). Quotas: blocks
of equal size go to sources by the highest quotients target / (2 seats + 1). Seats are monotone in their number, so
every shard's quota is the difference of two prefixes. Only quotients near the last seat are ranked: about as many
rows as there are sources, however many blocks.

Selection: a source's documents stand end to end in seeded order. Each shard has a stretch of that line, in proportion to
its quota, and takes its quota of blocks from its own stretch: whole rounds of the stretch, then its first blocks. A document
that lies across two stretches has its part in each. So the number of shards changes which documents are taken, and a
source's sum by a few words at most, as stretches end at whole words.

Nulls: a null text has no words; a null source is a source of its own, last in order; a null doc_id is kept. Empty
texts take nothing. Texts of any length are counted whole. Ties in the seeded order fall to doc_id, then size. Repeated
rows count each. Without words every target is 0. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(shared.WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_id, source_size, target) from (source, size)."""
    every = Window.partitionBy()
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("source_id", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("source_id") % len(weights) + 1))
    s = s.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("w"))
    order = Window.orderBy("full_at", "source_id")
    before = F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap")
    left = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(every) - before) / left)
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "source_id", "level"))).over(every)["level"]
    target = F.least(F.col("cap"), F.coalesce(level * F.col("w"), F.col("cap")))
    return s.select("source", "source_id", "source_size", target.alias("target"))


def shard_quotas(targets: DataFrame, block: int, shards: int = 1) -> DataFrame:
    """(source_id, shard, blocks): integer quotas; shard h of `shards` gets the seats between two prefixes of the Sainte-Laguë order."""
    every = Window.partitionBy()
    t = targets.filter("target > 0").withColumn("total", F.sum("target").over(every)).withColumn("n", F.count("*").over(every))
    t = t.withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards))))
    t = t.withColumn("seats", F.round(F.col("total") / block * F.col("shard") / shards))
    part = F.col("target") / F.col("total")
    t = t.withColumn("base", F.greatest(F.lit(0), F.floor(part * F.col("seats") - F.col("n") * part / 2 - 2)))
    t = t.withColumn("open", F.col("seats") - F.sum("base").over(Window.partitionBy("shard")))
    near = t.withColumn("seat", F.explode(F.sequence(F.col("base") + 1, F.col("base") + F.ceil(F.col("n") * part) + 5)))
    by = Window.partitionBy("shard").orderBy((F.col("target") / (2 * F.col("seat") - 1)).desc(), "source_id")
    won = near.withColumn("rank", F.row_number().over(by)).groupBy("source_id", "shard").agg((F.max("base") + F.sum((F.col("rank") <= F.col("open")).cast("long"))).alias("upto"))
    gained = F.col("upto") - F.coalesce(F.lag("upto").over(Window.partitionBy("source_id").orderBy("shard")), F.lit(0))
    return won.select("source_id", "shard", gained.cast("long").alias("blocks"))


def stretches(targets: DataFrame, quotas: DataFrame, block: int, most: float) -> DataFrame:
    """(source_id, parts): for each source the stretches lo .. hi of its line, one a shard at most, how many whole rounds are taken of each and up to where the rest is."""
    by = Window.partitionBy("source_id")
    q = quotas.withColumn("upto", F.sum("blocks").over(by.orderBy("shard"))).withColumn("all", F.sum("blocks").over(by)).filter("blocks > 0")
    q = q.join(targets, "source_id")
    place = lambda n: F.floor(F.col("source_size") * (n / F.col("all")))
    q = q.withColumn("lo", place(F.col("upto") - F.col("blocks"))).withColumn("hi", place(F.col("upto"))).filter("hi > lo")
    q = q.withColumn("words", F.least(F.col("blocks") * block, F.floor(F.lit(float(most)) * (F.col("hi") - F.col("lo")))))
    q = q.withColumn("rounds", F.floor(F.col("words") / (F.col("hi") - F.col("lo"))))
    part = F.struct("lo", "hi", "rounds", (F.col("lo") + F.col("words") - F.col("rounds") * (F.col("hi") - F.col("lo"))).alias("rest"))
    return q.groupBy("source_id").agg(F.collect_list(part).alias("parts"))


def words_taken(parts: str, start: Column, size: Column) -> Column:
    """Words that the stretches take of a document that stands at `start`."""

    def of(part: Column) -> Column:
        a, b = F.greatest(start, part["lo"]), F.least(start + size, part["hi"])
        return part["rounds"] * F.greatest(F.lit(0), b - a) + F.greatest(F.lit(0), F.least(b, part["rest"]) - a)

    return F.coalesce(F.aggregate(parts, F.lit(0).cast("long"), lambda n, part: n + of(part)), F.lit(0))


def mix(spark: SparkSession, documents: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, shards: int = 8, seed: int = 17, most_block: int = 64) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, source_id) of every document.

    A block holds most_block words, or less where the smallest target is under 64 blocks. One row a source, and one a source
    and shard, is all that any single task sees; documents meet in ranges of a seeded hash, some 256 to a range up to 2**28
    documents, beyond that ever more, which Spark sorts with spilling."""
    scratch = shared.Scratch(spark, "mix")
    at = F.xxhash64("doc_id", F.lit(seed))
    sized = scratch.save(documents.select("doc_id", "source", n_words().alias("size"), at.alias("at")))
    targets = scratch.save(source_targets(sized, weights, share, most))
    least = targets.filter("target > 0").agg(F.min("target")).first()[0] or 1.0
    block = int(max(1, min(most_block, least // 64)))
    parts = stretches(targets, shard_quotas(targets, block, shards), block, most)
    plan = targets.join(parts, "source_id", "left")
    ranges = max(1, min(1 << 20, -(-sized.count() // 256)))
    high = F.shiftrightunsigned("at", 32)
    docs = sized.withColumn("bucket", F.shiftright(high * ranges, 32)).withColumn("high", high)
    key = docs["source"].eqNullSafe(plan["source"])
    docs = docs.join(plan, key).drop(plan["source"])
    sums = docs.groupBy("source_id", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.select("source_id", "bucket", (F.sum("n").over(Window.partitionBy("source_id").orderBy("bucket")) - F.col("n")).alias("base"))
    inner = Window.partitionBy("source_id", "bucket").orderBy("high", "at", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = docs.join(sums, ["source_id", "bucket"]).withColumn("start", F.col("base") + F.sum("size").over(inner) - F.col("size"))
    taken = words_taken("parts", F.col("start"), F.col("size"))
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", "source_id")


def op6(spark: SparkSession, documents: DataFrame) -> DataFrame:
    return mix(spark, documents).select("doc_id", "size", "source_size", "target", "taken")
