"""Change logs: serials, replay, comparison of snapshots, expiry, and the rules of incremental answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replay(journal: DataFrame, keys: list[str], order: str = "serial_global") -> DataFrame:
    """The last operation of each key decides: rows of keys that an ADD left alive.

    max_by is a plain aggregate, so a key with very many changes is combined before the shuffle."""
    last = journal.groupBy(*keys).agg(F.max(order).alias(order), F.max_by("operation", order).alias("operation"))
    return last.filter("operation <> 'DEL'").drop("operation")


def assign_serials(changes: DataFrame, base: DataFrame) -> DataFrame:
    """Gapless serials of each source, after those it has: base (source, next_serial)."""
    n = F.row_number().over(Window.partitionBy("source").orderBy("serial_global"))
    return changes.join(base, "source").withColumn("serial", F.col("next_serial") + n - 1).drop("next_serial")


def next_serials(status: DataFrame, journal: DataFrame) -> DataFrame:
    """The journal's largest serial, else the largest seen, else 0, plus 1; the journal wins even where it is behind."""
    top = journal.groupBy("source").agg(F.max("serial_nrtm").alias("top"))
    return status.join(top, "source", "left").select("source", (F.coalesce("top", "serial_newest_seen", F.lit(0)) + 1).alias("next_serial"))


def snapshot_diff(new: DataFrame, old: DataFrame, key: str = "pk", body: str = "body") -> DataFrame:
    """(key, change): new, deleted, modified or retained, from one full outer join."""
    a, b = new.select(key, F.col(body).alias("new_body"), F.lit(True).alias("is_new")), old.select(key, F.col(body).alias("old_body"), F.lit(True).alias("is_old"))
    change = F.when(F.col("is_old").isNull(), "new").when(F.col("is_new").isNull(), "deleted").when(~F.col("new_body").eqNullSafe(F.col("old_body")), "modified").otherwise("retained")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def out_of_order(serials: DataFrame, by: str, serial: str, position: str) -> DataFrame:
    """Rows whose serial is below one before them."""
    before = F.max(serial).over(Window.partitionBy(by).orderBy(position).rowsBetween(Window.unboundedPreceding, -1))
    return serials.withColumn("before", before).filter(F.col(serial) < F.col("before"))


def gaps(deltas: DataFrame, version: str = "version") -> DataFrame:
    """Versions that do not follow their predecessor by one."""
    last = F.lag(version).over(Window.partitionBy("source").orderBy(version))
    return deltas.withColumn("last", last).filter(F.col(version) != F.col("last") + 1)


def range_answer(first: int, last: int | None, oldest: int | None, newest: int | None, limit: int | None = None) -> str:
    """What a request for serials first to last (None: the newest) gets: ok, warning or error. The limit compares last - first."""
    if oldest is None or newest is None:
        return "error: no journal"
    if last is None:
        if first == newest + 1:
            return "warning: no newer updates"
        last = newest
    if first < oldest or last > newest:
        return f"error: serials {oldest}-{newest} only"
    if last < first:
        return "error: end before start"
    if limit is not None and last - first > limit:
        return "error: too many serials"
    return "ok"
