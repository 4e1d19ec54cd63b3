"""Token-ID / binary output: a concatenated id array whose document boundaries are Elias-Fano encoded.

The file format is a Parquet data set of blocks (Spark's writer, so that any store works and a task that is
lost and run again leaves no half file). A block holds consecutive documents in ascending doc_id order:

    shard, block    place in the order of the whole set
    n_docs, n_ids   documents and ids in the block
    doc_ids         their doc_id, null where it is null
    ids             all ids on end, little endian, `width` bytes each (2 while the vocabulary allows it, else 4)
    low, high       Elias-Fano form of the n_docs end positions: low bits packed, high bits in unary
    low_bits        bits of each low part
    samples         for every 64th one-bit of `high` its position: select() scans from the nearest one

End positions take about 2 + log2(n_ids / n_docs) bits each, where a table of 64-bit offsets takes 64.

Nulls: a null text counts as empty, a null doc_id sorts first. Empty texts hold the end id alone. Ties of doc_id
are ordered by the text's hash, so reruns agree; repeated rows are all kept. An empty table gives no block and no row.
Texts are encoded whole: one longer than a block is a block of its own.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

SAMPLE = 64
#: Ids in a block, and bytes of text in a shard, about.
BLOCK_IDS, SHARD_BYTES = 1 << 18, 1 << 27
#: Where the k-th one-bit of a byte stands.
_IN_BYTE = np.array([([b for b in range(8) if x >> b & 1] + [0] * 8)[:8] for x in range(256)], dtype=np.int64)
BLOCK_SCHEMA = "shard int, block int, n_docs long, n_ids long, doc_ids array<long>, width int, ids binary, low_bits int, low binary, high binary, samples binary"


class EliasFano:
    """A non-decreasing sequence in about 2 + log2(bound / n) bits an element, with select() in constant time."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits = n, low_bits
        self.low, self.high, self.samples = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8), np.frombuffer(samples, "<u4")

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.int64)
        n, bound = len(v), int(v[-1]) if len(v) else 0
        bits = max(0, (bound // n).bit_length() - 1) if n else 0
        low = (v[:, None] >> np.arange(bits)[None, :] & 1).astype(np.uint8).ravel() if bits else np.zeros(0, np.uint8)
        at = (v >> bits) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1 if n else 0, dtype=np.uint8)
        high[at] = 1
        return cls(n, bits, np.packbits(low, bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), at[::SAMPLE].astype("<u4").tobytes())

    def select(self, i: np.ndarray | int) -> np.ndarray:
        """Elements i, in any order: each is sought in the bytes between the samples around it."""
        i = np.atleast_1d(np.asarray(i, dtype=np.int64))
        if not len(i):
            return i
        a, z = i.min() // SAMPLE, i.max() // SAMPLE
        begin, end = int(self.samples[a]) >> 3, (int(self.samples[z + 1]) >> 3) + 1 if z + 1 < len(self.samples) else len(self.high)
        part = self.high[begin:end].copy()
        part[0] &= 0xFF << (int(self.samples[a]) & 7) & 0xFF
        ones = np.cumsum(np.bitwise_count(part), dtype=np.int64)
        nth = i - a * SAMPLE
        byte = np.searchsorted(ones, nth, side="right")
        top = ((begin + byte) << 3) + _IN_BYTE[part[byte], nth - ones[byte] + np.bitwise_count(part[byte])] - i
        bit = i[:, None] * self.low_bits + np.arange(self.low_bits)[None, :]
        low = (self.low[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(np.int64)
        return (top << self.low_bits) | (low << np.arange(self.low_bits)).sum(axis=1)

    def all(self) -> np.ndarray:
        """The whole sequence."""
        return self.select(np.arange(self.n))


def spans(values: np.ndarray, bounds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches values[bounds[i] : bounds[i + 1]] for each i of at, on end, and the bounds between them."""
    size = np.diff(bounds)[at]
    out = np.concatenate([[0], np.cumsum(size)])
    kind = np.int32 if max(len(values), out[-1]) < 1 << 31 else np.int64
    take = np.repeat((bounds[at] - out[:-1]).astype(kind), size)
    take += np.arange(out[-1], dtype=kind)
    return values[take], out


def word_like(data: np.ndarray) -> np.ndarray:
    """For each byte of UTF-8 whether it belongs to a character that is neither white space nor a control character."""
    lead = (data > 32) & (data != 127)
    at = np.flatnonzero((data == 0xC2) | (data >= 0xE1) & (data <= 0xE3))
    if len(at):
        a, b = data[np.minimum(at + 1, len(data) - 1)], data[np.minimum(at + 2, len(data) - 1)]
        two, wide = data[at] == 0xC2, data[at].astype(np.int64) << 16 | a.astype(np.int64) << 8 | b
        spaces = [0xE19A80, 0xE1A08E, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080]
        lead[at[two & (a <= 0xA0)]] = False
        lead[at[~two & np.isin(wide, spaces)]] = False
    if (data >= 0x80).any():
        goes_on = (data & 0xC0) == 0x80
        for _ in range(3):
            lead[1:] = np.where(goes_on[1:], lead[:-1], lead[1:])
    return lead


class Encoder:
    """Encodes whole texts with one tokenizer, remembering the ids of the pieces that texts are cut into.

    A byte-level BPE never joins across a space that stands between two word-like characters: the space opens the next
    piece. Nor does it across a line end between two such characters, or between a letter or digit of Latin-1 and a stop or
    comma. Cutting there and encoding each piece by itself gives the same ids as encoding the text in one go. Arrow tells
    the different pieces of a batch apart and finds those remembered; the others go to the tokenizer in one call.
    """

    #: The byte-level pre-tokenizer's pattern, for pieces of printable ASCII and Latin-1 letters; a null stands between pieces.
    PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\x00\n A-Za-zÀ-ÖØ-öø-ÿ0-9]+|\n")
    LATIN = re.compile(rb" ?(?:[!-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|\n")
    #: Between words that are handed to the model together; stands in no word.
    BETWEEN = "\u2028"
    #: Words in one call, so that what the library holds of them stays small.
    TOGETHER = 4096
    #: Pieces remembered by a worker, in Arrow about 30 bytes each, and twice that while they are looked up.
    MOST = 250_000

    def __init__(self, path: str, end_id: int):
        # Spark's tasks are the parallel work
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.code = "H" if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "I"
        self.end = array(self.code, [end_id]).tobytes()
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = dict(zip(visible, map(chr, visible), strict=True)) | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in visible)}
        self.letters = {c: "".join(shown[b] for b in chr(c).encode()) for c in range(256)}
        vocabulary, model, pre = self.tokenizer.get_vocab(), self.tokenizer.model, self.tokenizer.pre_tokenizer
        #: Other tokenizers, and texts that hold an added token, go through the tokenizer whole.
        self.bytewise = not self.tokenizer.normalizer and isinstance(pre, pre_tokenizers.ByteLevel) and not pre.add_prefix_space and pre.use_regex
        self.bytewise &= isinstance(model, models.BPE) and not (model.dropout or model.continuing_subword_prefix or model.end_of_word_suffix) and vocabulary.keys() >= set(shown.values())
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: The same model for words that are cut and spelled in the model's letters already, and the letters of each of its tokens.
        self.words = Tokenizer(model)
        self.words.pre_tokenizer = pre_tokenizers.Split(self.BETWEEN, "removed")
        self.sizes = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=np.int64)
        self.sizes[list(vocabulary.values())] = list(map(len, vocabulary))
        #: Pieces remembered, their ids on end and the bounds of these, and which pieces were met again since some were last forgotten.
        self.pieces, self.ids, self.bounds, self.again = pa.array([], pa.binary()), np.zeros(0, self.code), np.zeros(1, np.int64), np.zeros(0, bool)

    def plain(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    @staticmethod
    def cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where pieces of the texts data[bounds[i] : bounds[i + 1]] begin."""
        n = len(data)
        if not n:
            return np.zeros(0, dtype=np.int64)
        ok = word_like(data)
        start = np.zeros(n + 1, dtype=bool)
        inner = np.zeros(n, dtype=bool)
        inner[1:-1] = ok[:-2] & ok[2:]
        edge = np.concatenate([bounds[:-1], bounds[1:] - 1])
        inner[edge[(edge >= 0) & (edge < n)]] = False
        line = inner & (data == 10)
        start[:n] = line | inner & (data == 32)
        start[1:] |= line
        at = np.flatnonzero((data == 46) | (data == 44))
        at = at[at > 0]
        left, more = data[at - 1], data[np.maximum(at - 2, 0)]
        folded = left | 32
        start[at[(folded >= 97) & (folded <= 122) & (left < 128) | (left >= 48) & (left <= 57) | (more == 0xC3) & (left >= 0x80) & (left != 0x97) & (left != 0xB7)]] = True
        start[bounds] = True
        return np.flatnonzero(start[:n])

    def learn(self, pieces: pa.Array) -> np.ndarray:
        """Adds new pieces to those remembered and tells their places. Plain Latin ones are split by the tokenizer's own pattern and go to its model in one call, others through the whole tokenizer."""
        data, bounds = shared.text_bytes(pieces)
        raw, b = data.tobytes(), bounds.tolist()
        is_latin = np.array([self.LATIN.fullmatch(raw, x, y) is not None for x, y in zip(b, b[1:], strict=False)])
        order = np.argsort(~is_latin, kind="stable")
        n, size = int(is_latin.sum()), np.diff(bounds)
        words = self.PARTS.findall(b"\x00".join([raw[b[i] : b[i + 1]] for i in order[:n].tolist()]).decode())
        calls = [self.BETWEEN.join(words[i : i + self.TOGETHER]).translate(self.letters) for i in range(0, len(words), self.TOGETHER)]
        ids = np.concatenate([np.zeros(0, self.code), *[np.array(self.words.encode_batch_fast([c], add_special_tokens=False)[0].ids, dtype=self.code) for c in calls]])
        # the tokens of a piece have as many letters as it has bytes
        ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(size[order[:n]])) + 1
        other = [np.array(self.tokenizer.encode_batch_fast([raw[b[i] : b[i + 1]].decode()], add_special_tokens=False)[0].ids, dtype=self.code) for i in order[n:].tolist()]
        ends = np.concatenate([ends, len(ids) + np.cumsum([len(x) for x in other], dtype=np.int64)])
        at = np.empty(len(order), dtype=np.int64)
        at[order] = len(self.pieces) + np.arange(len(order))
        self.pieces = pa.concat_arrays([self.pieces, pieces.take(pa.array(order))])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + ends])
        self.ids = np.concatenate([self.ids, ids, *other])
        self.again = np.concatenate([self.again, np.zeros(len(order), dtype=bool)])
        return at

    def forget(self) -> None:
        """Beyond MOST pieces only those stay that were met again since the last time, the newest half of MOST at most."""
        if len(self.pieces) > self.MOST:
            stay = np.flatnonzero(self.again)[-(self.MOST // 2) :]
            self.ids, self.bounds = spans(self.ids, self.bounds, stay)
            self.pieces, self.again = self.pieces.take(pa.array(stay)), np.zeros(len(stay), dtype=bool)

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Little-endian ids of each text, the end id included."""
        if not self.bytewise:
            return [self.plain(t) + self.end for t in texts.to_pylist()]
        data, bounds = shared.text_bytes(texts)
        begin = self.cuts(data, bounds)
        found = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(data)).astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        place = pc.index_in(found.dictionary, value_set=self.pieces)
        is_new = place.is_null().to_numpy(zero_copy_only=False)
        at = place.fill_null(0).to_numpy().astype(np.int64)
        self.again[at[~is_new]] = True
        if is_new.any():
            at[is_new] = self.learn(found.dictionary.filter(pa.array(is_new)))
        ids, ends = spans(self.ids, self.bounds, at[found.indices.to_numpy()])
        self.forget()
        # Arrow would keep what it needed for the look-up
        pa.default_memory_pool().release_unused()
        raw, stop = ids.tobytes(), (ends[np.searchsorted(begin, bounds)] * ids.itemsize).tolist()
        out = [raw[a:z] + self.end for a, z in zip(stop, stop[1:], strict=False)]
        for token in self.added:
            for i in np.flatnonzero(pc.match_substring(texts, token).fill_null(False).to_numpy(zero_copy_only=False)).tolist():
                out[i] = self.plain(texts[i].as_py()) + self.end
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text]))[0]


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def encode_blocks(documents: DataFrame, tokenizer: str, end_id: int, shards: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks of the format from (doc_id, text): shards are ranges of doc_id, blocks hold about block_ids ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        e, shard, block = encoder(tokenizer, end_id), TaskContext.get().partitionId(), 0
        w = array(e.code).itemsize
        names: list = []
        parts: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            ends = np.cumsum([len(p) // w for p in parts])
            ef = EliasFano.encode(ends)
            row = {"shard": shard, "block": block, "n_docs": len(parts), "n_ids": int(ends[-1]), "doc_ids": names, "width": w, "ids": b"".join(parts), "low_bits": ef.low_bits, "low": ef.low.tobytes(), "high": ef.high.tobytes(), "samples": ef.samples.tobytes()}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("width", pa.int32()), ("ids", pa.binary()), ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("samples", pa.binary())]))

        for b in shared.in_batches(batches):
            for name, ids in zip(b.column("doc_id").to_pylist(), e.encode_all(b.column("text")), strict=True):
                names.append(name)
                parts.append(ids)
                held += len(ids) // w
                if held >= block_ids:
                    yield flush()
                    names, parts, held, block = [], [], 0, block + 1
        if parts:
            yield flush()

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ordered = docs.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), F.crc32("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.crc32("text"))
    return ordered.mapInArrow(run, BLOCK_SCHEMA)


def shards_for(documents: DataFrame) -> int:
    """As many shards as shuffle partitions, or more where a shard would hold over SHARD_BYTES of text."""
    size = documents.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return shared.partitions(documents.sparkSession, -(-size // SHARD_BYTES))


def write(documents: DataFrame, path: str, tokenizer: str, end_id: int, shards: int, block_ids: int = BLOCK_IDS) -> None:
    """Encodes documents and writes the format's files at path."""
    encode_blocks(documents, tokenizer, end_id, shards, block_ids).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK_SCHEMA).parquet(path)


def block_starts(blocks: DataFrame) -> DataFrame:
    """(shard, block, base): ids before each block. Sums within a shard first, so that one task sees a row a shard."""
    sizes = blocks.select("shard", "block", "n_ids")
    shard = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_base"))
    within = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_ids")
    return sizes.withColumn("within", within).join(shard, "shard").select("shard", "block", (F.col("shard_base") + F.col("within")).alias("base"))


def digests(blocks: DataFrame) -> DataFrame:
    """One row a document read back from the files: doc_id, start, n_tokens, ids_crc32 (of 32-bit little-endian ids), shard and block."""
    schema = "doc_id long, shard int, block int, local long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ends = EliasFano(r["n_docs"], r["low_bits"], r["low"], r["high"], r["samples"]).all()
                starts = np.concatenate([[0], ends[:-1]])
                ids = np.frombuffer(r["ids"], dtype=f"<u{r['width']}").astype("<u4").tobytes()
                crc = [zlib.crc32(ids[4 * a : 4 * z]) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array([r["shard"]] * n, pa.int32()), pa.array([r["block"]] * n, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "shard", "block", "local", "n_tokens", "ids_crc32"],
                )

    rows = blocks.mapInArrow(run, schema)
    return rows.join(block_starts(blocks), ["shard", "block"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "shard", "block")


def op1(spark: SparkSession, documents: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Writes the id files of documents to the shared folder and returns their digests, read back from the files."""
    import public_tokenizers

    scratch = shared.Scratch(spark, "tokens")
    path = f"{scratch.base}/ids"
    write(documents, path, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), end_id, shards_for(documents))
    return digests(read(spark, path))
