"""The graph of sets and members: first source wins, closure, depth, exclusion, and members by reference.

Closures run level by level over DataFrames: each round joins the frontier to the edges and keeps what was not seen. Rounds are
as many as the graph is deep; each writes what it found to a table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

AS_NUMBER = r"^AS\d+$"


def first_source(edges: DataFrame, sources: list[str]) -> DataFrame:
    """(parent, member) of each set from the first of the sources that has it. One aggregate of a rank, no sort of members."""
    rank = F.create_map(*[x for i, s in enumerate(sources) for x in (F.lit(s), F.lit(i))])[F.col("source")]
    ranked = edges.withColumn("rank", rank).filter("rank is not null and member <> ''")
    best = ranked.groupBy("parent").agg(F.min("rank").alias("rank"))
    return ranked.join(best, ["parent", "rank"]).select("parent", "member")


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a table in the folder that all executors share: computed once, and a lost executor rereads it."""
    sc = df.sparkSession.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if given is None and not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{given or 'file:///tmp/prefixloom-checkpoints'}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def closure(edges: DataFrame, roots: DataFrame, depth: int | None = None, excluded: list[str] | None = None) -> DataFrame:
    """(root, member) reached from (root) over (parent, member): AS numbers, and at the depth cut what the last level holds.

    Sets that no edge expands are leaves and dropped, but at the cut. Excluded sets are not expanded, unless they are the root."""
    seen = cut(roots.select("root", F.col("root").alias("name")))
    front, level = seen, 0
    while True:
        level += 1
        new = front.join(edges, front["name"] == edges["parent"]).select("root", F.col("member").alias("name")).distinct().join(seen, ["root", "name"], "left_anti")
        if excluded:
            new = new.filter(~F.col("name").isin(*excluded))
        new = cut(new)
        if not new.take(1):
            break
        seen = cut(seen.unionByName(new))
        if depth and level >= depth:
            break
        front = new.filter(~F.col("name").rlike(AS_NUMBER))
    out = seen.filter(F.col("name") != F.col("root"))
    if not depth:
        out = out.filter(F.col("name").rlike(AS_NUMBER))
    return out.select("root", F.col("name").alias("member"))


def by_reference(sets: DataFrame, member_of: DataFrame, mnt_by: DataFrame) -> DataFrame:
    """(set_pk, pk): members that name a set which admits any maintainer, or one of theirs."""
    claims = member_of.join(sets, "set_pk")
    free = claims.filter(F.col("mbrs_by_ref") == "ANY").select("set_pk", "pk")
    held = claims.filter(F.col("mbrs_by_ref") != "ANY").join(mnt_by.withColumnRenamed("mntner", "mbrs_by_ref"), ["pk", "mbrs_by_ref"], "left_semi").select("set_pk", "pk")
    return free.unionByName(held).distinct()


def origin_prefixes(routes: DataFrame) -> DataFrame:
    """Distinct prefixes of each (source, origin)."""
    return routes.select("source", "asn", "ip_first", "plen").distinct()


def ordered_unique(names: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """(source, position): requested names with aliases replaced by what they stand for, each source at its first place."""
    table = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    many = names.select(F.col("position"), F.posexplode(F.coalesce(table[F.col("name")], F.array("name"))).alias("inner", "source"))
    first = many.groupBy("source").agg(F.min(F.struct("position", "inner")).alias("at"))
    return first.select("source", F.row_number().over(Window.orderBy("at")).cast("long").alias("position"))
