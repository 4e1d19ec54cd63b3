"""What the corpus operators share: the cluster's shared folder, batches of texts, 64-bit hashes and labelled samples."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that end a word: the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of a batch that Spark hands to Python, so that a worker's memory does not depend on how long the texts are.
BATCH = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir where it is set, else one for a single machine; on a cluster it must be set."""
    sc = spark.sparkContext
    if (given := sc.getConf().get("spark.checkpoint.dir")) is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
    if given is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        given = "file:///tmp/prefixloom-checkpoints"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(given)
    return given


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on bytes of Arrow batches to BATCH."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") != f"{BATCH}b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH}b")


_BASES: list[str] = []


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Removes all scratch tables of this process, once nothing reads the operators' results any more."""
    while _BASES:
        delete(spark, _BASES.pop())


class Scratch:
    """Tables in the shared folder that cut lineage: a lost executor rereads them instead of redoing what led to them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        bound_batches(spark)
        _BASES.append(self.base)

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Frees a table that nothing reads any more."""
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            if f.split("://")[-1].lstrip("/").startswith(self.base.split("://")[-1].lstrip("/")) or self.base.split(":", 1)[-1].lstrip("/") in f:
                delete(self.spark, f)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(key: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % n


def partitions(spark: SparkSession, least: int = 0) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


# ---- 64-bit hashing in numpy ----

_M1, _M2, GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


#: One odd random-looking word for each byte value.
BYTE_WORDS = mix((np.arange(1, 257, dtype=np.uint64)) * GOLD) | np.uint64(1)
_R = 0xD6E8FEB86659FD93
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i modulo 2**64 for i < n."""
    if len(_POWERS.get("up", ())) < n:
        size = (n + (1 << 18) - 1) >> 18 << 18
        for k, r in (("up", _R), ("down", pow(_R, -1, 1 << 64))):
            f = np.full(size, r, dtype=np.uint64)
            f[0] = 1
            _POWERS[k] = np.cumprod(f, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """n + 1 sums of byte words times powers: with span_hash, the hash of any stretch of bytes."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_WORDS[data] * powers(len(data))[0] if len(data) else data.astype(np.uint64), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of bytes [start, end), the same wherever they stand."""
    down = powers(len(sums))[1]
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * GOLD)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a batch of texts on end, and the n + 1 bounds between them (null: empty)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, (bounds - bounds[0]).astype(np.int64) if len(column) else np.zeros(1, np.int64)


def in_batches(batches: Iterator[pa.RecordBatch], most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of a bounded number of bytes; a text beyond the bound is a batch of its own."""
    for b in batches:
        n = max(1, -(-b.nbytes // most_bytes))
        step = max(1, -(-b.num_rows // n))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the ASCII-white-space-free words of a batch, and the number of words before each text."""
    n = len(data)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = bounds[1:-1][bounds[1:-1] < n]
    first[cut] = inside[cut]
    back = cut[cut > 0] - 1
    last[back] = inside[back]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)
