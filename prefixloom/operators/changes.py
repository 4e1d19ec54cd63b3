"""Batches of change requests: reference checks and the fix-point that drops what depends on a dropped request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sets import cut


def broken_references(refs: DataFrame, targets: DataFrame, ref: str, target: str) -> DataFrame:
    return refs.join(targets.select(F.col(target).alias(ref)), ref, "left_anti")


def inbound_references(objects: DataFrame, refs: DataFrame, pk: str, ref: str) -> DataFrame:
    """Objects that a row of refs names. Each name counts once before the shuffle, so that a name with very many rows costs a task one."""
    return objects.join(refs.select(F.col(ref).alias(pk)).distinct(), pk, "left_semi")


def fixpoint(requests: DataFrame) -> DataFrame:
    """(req, valid): requests (req, batch, refers_to, broken) from which those that are broken go, then those that refer to one
    that went, until nothing changes. A round is a semi-join of what is left to what just went, and drops a request at least."""
    gone = cut(requests.filter("broken").select("req", "batch"))
    front = gone
    left = requests.filter("not broken").select("req", "batch", "refers_to")
    while True:
        lost = front.select(F.col("req").alias("refers_to"), "batch")
        front = cut(left.join(lost, ["refers_to", "batch"], "left_semi").select("req", "batch").join(gone, ["req", "batch"], "left_anti"))
        if not front.take(1):
            break
        gone = cut(gone.unionByName(front))
    return requests.select("req").join(gone.select("req", F.lit(False).alias("kept")), "req", "left").select("req", F.coalesce("kept", F.lit(True)).alias("valid"))


def sole_maintained(mnt_by: DataFrame, suspended: list[str]) -> DataFrame:
    """Objects all of whose maintainers are suspended."""
    held = F.col("mntner").isin(*suspended)
    return mnt_by.groupBy("pk").agg(F.min(held.cast("int")).alias("all")).filter(F.col("all") == 1).select("pk")
