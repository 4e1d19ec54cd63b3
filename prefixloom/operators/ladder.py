"""Prefix containment as an equi-join.

A prefix lies within another exactly if its network, cut to the other's length, is the other's network. So each row of the
inside side becomes one row for every length that the outside side really has (at most 33), and both sides meet in a hash or
sort-merge join on (length, network). The list of lengths has at most 33 rows, so it may be broadcast whatever the data.

Rows with a column `bits` (functions.ip.prefix_bits: family and network bits as text) may be of both address families: the
network that contains one is then a beginning of its bits, and there are at most 162 lengths.

Pairs of ids can be far more than rows: with many rows of one prefix they grow with the square of these. `pairs` therefore
shuffles and sorts rows only, each as its key and its id, gathers the ids of a key in lists of bounded length, and pairs lists;
single pairs come up in the last step alone, list by list, which is also the order that files compress best. The inside rows of
one prefix are gathered before they climb, so that a list and not each of its rows is dealt to every length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ip

#: Ids of a list at most; where lists are put together, less than twice as many.
LIST = 1024


def rungs(inside: DataFrame, outside: DataFrame, first: str = "ip_first", length: str = "plen") -> DataFrame:
    """inside with (o_len, o_net): every network that would contain it, among the lengths of outside."""
    lengths = outside.select(F.col("plen").alias("o_len")).distinct()
    return inside.join(F.broadcast(lengths), F.col("o_len") <= F.col(length)).withColumn("o_net", ip.network(F.col(first), F.col("o_len")))


def rungs_bits(inside: DataFrame, outside: DataFrame) -> DataFrame:
    """The same for rows with bits: (cut__, begins__), among the lengths of outside's rows of the same family."""
    family = F.substring("bits", 1, 1)
    lengths = outside.select(family.alias("family__"), F.length("bits").alias("cut__")).distinct()
    return inside.join(F.broadcast(lengths), (family == F.col("family__")) & (F.col("cut__") <= F.length("bits"))).drop("family__").withColumn("begins__", F.col("bits").substr(F.lit(1), F.col("cut__")))


def blocks(rows: DataFrame, first: str, last: str, most: Column | int = 32) -> DataFrame:
    """rows with (o_len, o_net): the fewest prefixes that make up the range of addresses, two of a length at most. A prefix lies
    in the range exactly if it lies in one of them. Those longer than `most` are left out."""
    up = rows.withColumn("bits__", F.explode(F.sequence(F.lit(32) - most, F.lit(32))))
    height = F.col("bits__")
    low = F.call_function("shiftright", F.col(first) + ip.power(height) - 1, height)
    high = F.call_function("shiftright", F.col(last) + 1, height)
    up = up.withColumn("low__", low).withColumn("high__", high).filter("low__ < high__")
    ends = F.array_compact(F.array(F.when(F.col("low__") % 2 == 1, F.col("low__")), F.when(F.col("high__") % 2 == 1, F.col("high__") - 1)))
    up = up.withColumn("block__", F.explode(ends))
    return up.select(*rows.columns, (F.lit(32) - height).alias("o_len"), F.call_function("shiftleft", F.col("block__"), height).alias("o_net"))


def containing(inside: DataFrame, outside: DataFrame, how: str = "inner") -> DataFrame:
    """Pairs of a row of inside and a row of outside that contains it; outside's columns get the prefix o_."""
    if "bits" in inside.columns:
        return containing_bits(inside, outside, how)
    up = rungs(inside, outside)
    out = outside.select(*[F.col(c).alias(f"o_{c}") for c in outside.columns])
    return up.join(out, (up["o_len"] == out["o_plen"]) & (up["o_net"] == out["o_ip_first"]), how).drop("o_len", "o_net")


def containing_bits(inside: DataFrame, outside: DataFrame, how: str = "inner") -> DataFrame:
    """The same for rows with bits."""
    up = rungs_bits(inside, outside)
    out = outside.select(*[F.col(c).alias(f"o_{c}") for c in outside.columns])
    return up.join(out, up["begins__"] == out["o_bits"], how).drop("cut__", "begins__")


def lists(rows: DataFrame, key: list[str], of: str, name: str) -> DataFrame:
    """key, a number, and at most LIST values of a column that share the key; rows with a null in either take no part."""
    held = rows.filter(" AND ".join(f"{c} IS NOT NULL" for c in (*key, of)))
    n = (F.row_number().over(Window.partitionBy(*key).orderBy(of)) - 1) / LIST
    return held.withColumn(f"{name}_n", F.floor(n).cast("int")).groupBy(*key, f"{name}_n").agg(F.collect_list(of).alias(name))


def joined(rows: DataFrame, key: list[str], order: list[str], name: str) -> DataFrame:
    """The same from rows that hold lists already and that `order` tells apart: those of a key are put together up to 2 * LIST - 1 values."""
    before = F.sum(F.size(name)).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.size(name)
    return rows.withColumn("at__", F.floor(before / LIST).cast("int")).groupBy(*key, "at__").agg(F.flatten(F.collect_list(name)).alias(name)).withColumnRenamed("at__", f"{name}_n")


def meet(left: DataFrame, right: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """(a, b) of every row of left and every row of right with the same key; rows without an id take no part."""
    return meet_lists(lists(left, key, a, "left__"), lists(right, key, b, "right__"), key, a, b)


def meet_lists(left: DataFrame, right: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """The same for rows that hold lists, left__ and right__, numbered within a key. Pairs of lists are dealt out anew, so that a
    key with very many pairs is not one task's work."""
    both = left.join(right, key)
    n = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(n, *key, "left___n", "right___n").select("left__", "right__")
    # the longer list varies faster, so that the other's ids come in long runs
    turned = F.size("left__") > F.size("right__")
    outer, inner = F.when(turned, F.col("right__")).otherwise(F.col("left__")), F.when(turned, F.col("left__")).otherwise(F.col("right__"))
    # the outer ids come from a function of arrays, which Spark does not compile into one loop with the inner ones: that loop would
    # hold all LIST * LIST pairs of two lists, a copied row each, before it passes the first on; so it holds LIST
    each = F.transform("outer__", lambda x: F.struct(F.col("turned__"), x.alias("outer__")))
    one = dealt.select(turned.alias("turned__"), outer.alias("outer__"), inner.alias("inner__")).select(F.explode(each).alias("each__"), "inner__").select("each__.*", F.explode("inner__").alias("inner__"))
    return one.select(F.when(F.col("turned__"), F.col("inner__")).otherwise(F.col("outer__")).alias(a), F.when(F.col("turned__"), F.col("outer__")).otherwise(F.col("inner__")).alias(b))


def ladders(inside: DataFrame, outside: DataFrame, a: str, b: str, strict: bool = False, also: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, list[str], str]:
    """Rows of inside as (key, a) for every network that contains them, and rows of outside as (key, b); the names of the key's
    columns, and which of inside's tells the length. strict: without the prefix itself. also: columns of inside to keep."""
    if "bits" in inside.columns:
        up = rungs_bits(inside, outside)
        up = up.filter(F.col("cut__") < F.length("bits")) if strict else up
        return up.select("cut__", "begins__", a, *also), outside.select(F.col("bits").alias("begins__"), b), ["begins__"], "cut__"
    up = rungs(inside, outside)
    up = up.filter("o_len < plen") if strict else up
    return up.select("o_len", "o_net", a, *also), outside.select(F.col("plen").alias("o_len"), F.col("ip_first").alias("o_net"), b), ["o_len", "o_net"], "o_len"


def pairs(inside: DataFrame, outside: DataFrame, a: str, b: str, strict: bool = False) -> DataFrame:
    """(a, b): ids of a row of inside and of a row of outside that contains it. Rows of one prefix climb together, in lists."""
    if a == b:
        raise ValueError("the ids need different names")
    own = ["bits"] if "bits" in inside.columns else ["plen", "ip_first"]
    up, out, key, length = ladders(lists(inside, own, a, "left__"), outside, "left__", b, strict, (*own, "left___n"))
    return meet_lists(joined(up, key, [*own, "left___n"], "left__"), lists(out, key, b, "right__"), key, a, b)


def next_less_specific(queries: DataFrame, rows: DataFrame, query: str, row: str = "pk") -> DataFrame:
    """(query, o_<row>): of the rows that contain a query's prefix without being equal to it those of the longest prefix. Which
    prefix that is follows from the prefixes alone; rows of no other are paired."""
    over = f"o_{row}"
    up, out, key, length = ladders(queries, rows.withColumnRenamed(row, over), query, over, strict=True)
    held = up.join(out.select(*key).distinct(), key, "left_semi")
    best = held.withColumn("nth__", F.rank().over(Window.partitionBy(query).orderBy(F.col(length).desc()))).filter("nth__ = 1")
    return meet(best.select(*key, query), out, key, query, over)
