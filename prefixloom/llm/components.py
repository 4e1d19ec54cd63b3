"""Connected components of a link table: alternating large and small stars, each a join and an aggregate, until nothing moves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def components(scratch: shared.Scratch, links: DataFrame) -> DataFrame:
    """(node, root) of every node in links (a, b): root is the least node that its links reach.

    A node with very many links is one side of a join only, so that its rows can be split over tasks."""
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    pairs, seen = scratch.save(pairs), None
    while True:
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        best = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(best, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        new = scratch.save(small)
        state = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        scratch.drop(pairs)
        pairs = new
        if state == seen or not state[0]:
            break
        seen = state
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
