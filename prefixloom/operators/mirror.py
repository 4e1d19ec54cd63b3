"""Mirroring decisions and state: which version comes next, whether history was rewritten, what a batch of operations leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import journal

#: Fixed value: seconds after which a notification file or a delta is out of date.
DAY = 86_400


def older(at: Column, now: Column, seconds: int) -> Column:
    return at < now - F.expr(f"INTERVAL '{seconds}' SECOND")


def next_versions(status: DataFrame, notices: DataFrame) -> DataFrame:
    """(source, action, version) for status (source, session_id, version, force_reload) and notices (source, n_session, n_version, min_delta).

    A source without a usable past, or whose next delta is gone, loads the snapshot; a notice behind the local version is an error."""
    s = status.join(notices, "source")
    ahead = F.col("version") + 1
    fresh = F.col("force_reload") | F.col("session_id").isNull() | (F.coalesce("version", F.lit(0)) == 0) | (F.col("n_session") != F.col("session_id"))
    action = F.when(fresh, "snapshot").when(F.col("version") > F.col("n_version"), "error").when(F.col("min_delta") > ahead, "snapshot").otherwise("delta")
    return s.select("source", action.alias("action"), F.when(action == "delta", ahead).alias("version"))


def rewritten(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(source, reference) of files named before with another url or hash; both: (source, reference, url, hash)."""
    old = previous.select("source", "reference", F.col("url").alias("old_url"), F.col("hash").alias("old_hash"))
    return current.join(old, ["source", "reference"]).filter("url <> old_url or hash <> old_hash").select("source", "reference")


def snapshot_due(status: DataFrame, now: str = "now", seconds: int = 4 * 3600) -> DataFrame:
    """(source, due): no snapshot yet, or the version moved on and the last one is older than so many seconds."""
    moved = (F.col("snapshot_version") != F.col("version")) & older(F.col("snapshot_at"), F.col(now), seconds)
    return status.select("source", F.coalesce((F.coalesce("snapshot_version", F.lit(0)) == 0) | moved, F.lit(False)).alias("due"))


def apply_operations(objects: DataFrame, operations: DataFrame, keys: list[str], serial: str = "serial") -> DataFrame:
    """Objects (keys, body) after the operations (keys, serial, operation, body): the last of each key decides, an ADD of a known key replaces it."""
    base = objects.select(*keys, F.lit(-1).cast("long").alias(serial), F.lit("ADD").alias("operation"), "body")
    both = base.unionByName(operations.select(*keys, serial, "operation", "body"))
    last = both.groupBy(*keys).agg(F.max_by(F.struct("operation", "body"), serial).alias("x"))
    return last.filter("x.operation <> 'DEL'").select(*keys, "x.body")


def range_answers(requests: DataFrame, log: DataFrame, limit: int | None = None) -> DataFrame:
    """What requests (source, first, last; last null: the newest) get from log (source, serial_nrtm): ok, warning or error. The limit compares last - first."""
    bounds = log.groupBy("source").agg(F.min("serial_nrtm").alias("oldest"), F.max("serial_nrtm").alias("newest"))
    end = F.coalesce("last", "newest")
    answer = F.when(F.col("newest").isNull(), "error").when(F.col("last").isNull() & (F.col("first") == F.col("newest") + 1), "warning")
    answer = answer.when((F.col("first") < F.col("oldest")) | (end > F.col("newest")) | (end < F.col("first")), "error")
    answer = answer.when(end - F.col("first") > limit, "error") if limit is not None else answer
    return requests.join(bounds, "source", "left").select(*requests.columns, answer.otherwise("ok").alias("answer"))


def server_cycle(log: DataFrame, status: DataFrame, now: str = "now", seconds: int = 4 * 3600) -> DataFrame:
    """One cycle of publishing: (source, version, in_delta, expired, due) for status (source, version, published, snapshot_version, snapshot_at, now).

    Entries beyond the serial `published` make a delta and a new version; entries older than a day are out of date."""
    s = log.join(status, "source")
    found = s.groupBy("source").agg(
        F.sum((F.col("serial_nrtm") > F.col("published")).cast("long")).alias("in_delta"),
        F.sum(older(F.col("ts"), F.col(now), DAY).cast("long")).alias("expired"),
    )
    out = status.join(found, "source", "left").withColumn("in_delta", F.coalesce("in_delta", F.lit(0))).withColumn("expired", F.coalesce("expired", F.lit(0)))
    out = out.withColumn("version", F.col("version") + (F.col("in_delta") > 0).cast("long"))
    return out.select("source", "version", "in_delta", "expired").join(snapshot_due(out, now, seconds), "source")


def full_import(dump: DataFrame, old: DataFrame, key: str = "pk") -> DataFrame:
    """What a full dump changes: (key, change) of objects that are new, gone or other than before."""
    return journal.snapshot_diff(dump, old, key).filter("change <> 'retained'")
