"""Update notification files of mirroring version 4: the manifest of a snapshot and the deltas after it, as JSON. Signatures are left to the transport."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FILE = "struct<version: bigint, url: string, hash: string>"
CONTENT = f"nrtm_version int, type string, source string, session_id string, version bigint, timestamp string, snapshot {_FILE}, deltas array<{_FILE}>"


def write(files: DataFrame) -> DataFrame:
    """(source, content) from a row a file: (source, session_id, version, timestamp, file_version, url, hash, is_snapshot). Deltas stand in order of version."""
    one = F.struct(F.col("file_version").alias("version"), "url", "hash")
    whole = files.groupBy("source", "session_id", "version", "timestamp").agg(F.max(F.when(F.col("is_snapshot"), one)).alias("snapshot"), F.array_sort(F.collect_list(F.when(~F.col("is_snapshot"), one))).alias("deltas"))
    content = F.struct(F.lit(4).alias("nrtm_version"), F.lit("notification").alias("type"), "source", "session_id", "version", "timestamp", "snapshot", "deltas")
    return whole.select("source", F.to_json(content).alias("content"))


def read(files: DataFrame, content: str) -> DataFrame:
    """A row a file that the notifications name; texts that are no notification give none."""
    n = files.select(F.from_json(F.col(content), CONTENT).alias("n")).filter("n.nrtm_version = 4 and n.type = 'notification'")
    mark = lambda x, snapshot: F.struct(x["version"].alias("file_version"), x["url"].alias("url"), x["hash"].alias("hash"), F.lit(snapshot).alias("is_snapshot"))
    named = F.concat(F.array(mark(F.col("n.snapshot"), True)), F.transform(F.coalesce("n.deltas", F.array().cast(f"array<{_FILE}>")), lambda x: mark(x, False)))
    return n.select("n.source", "n.session_id", "n.version", "n.timestamp", F.explode(named).alias("f")).select("source", "session_id", "version", "timestamp", "f.*")
