"""N-gram Jaccard join: a size-aware heavy-light join over sets of word shingles, then connected components.

Equal sets become one class first. Two sets of Jaccard similarity t or more then share a key:

* small sets are enumerated: a set of n shingles can lose at most n // 10 of them (at t = 0.9) in such a pair, so two of them
  have an equal subset among those with at most so many left out. A subset's key is its sum of hashes and its size.
* large sets are indexed by inverted lists of their n - ceil(t * n) + 3 rarest shingles: two similar sets meet in 3 of these
  lists at least (or one, for 1 more than n - ceil(t * n)).

The boundary is where the estimated number of rows is least; sets just above it are also enumerated, so pairs across it meet.
Rarity is a table of counts of hashed shingles over all rows, of fixed size; any table gives right results, as only one order
for all sets matters.

Short lists give all their pairs, and a pair is followed up if it meets in 3 lists, as chance rarely brings two texts together
so often. A pair that meets in a long list is followed up there: such a list links by pivots first, its least and its greatest
class, then by drawn ones: strays against a member of the list's largest component, and a stray against all. Members of one
component need no pairs among themselves; of the strays that are left all pairs across components are tested that meet in 3
lists, long or short. So a large
group of near copies costs a few pairs a copy, and no link between components is lost. Parity bitmaps of the sets prune pairs
without loss: the bits in which they differ never outnumber the shingles in which the sets differ. What is left is verified
on the sets themselves, made from the texts again: keeping every set would take more disk than making the few that are needed.

Nulls: a null text has an empty set and no link. A null doc_id never names a component (null if all its ids are). Rows that
share a doc_id are judged each by their own text. Empty texts and ties of ids need no rule beyond these; an empty table gives
no row. Texts of any length are read whole. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .components import components
from .features import FOLD

PERCENT, WORDS, BITS = 90, 3, 20
#: Similar large sets share so many keys at least. Lists of up to SHORT classes give all their pairs.
SHARED, SHORT = 3, 8
#: Rounds of drawn pivots before all pairs of strays are tried.
ROUNDS = 2
#: Tables of ids are broadcast up to so many rows (16 bytes each), else joined.
FEW = 500_000
#: Columns of the parity bitmap, 64 bits each: so many that near misses of sets of some hundred shingles seldom pass.
SIGN = [f"s{i}" for i in range(16)]


def shingle_sets(data: np.ndarray, bounds: np.ndarray, k: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of k words; all words where there are fewer."""
    low = FOLD[data]
    starts, ends, at = shared.words_of(low, bounds)
    h = shared.span_hash(shared.prefix_sums(low), starts, ends)
    g = h.copy()
    for i in range(1, k):
        g[: len(h) - i] = shared.mix(g[: len(h) - i] + shared.GOLD) + h[i:] if len(h) > i else g[: len(h) - i]
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(shared.mix(g[a : b - k + 1])))
        elif b > a:
            x = h[a : a + 1]
            for i in range(a + 1, b):
                x = shared.mix(x + shared.GOLD) + h[i : i + 1]
            out.append(shared.mix(x ^ np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def class_ids(sets: list[np.ndarray], salt: int) -> pa.Array:
    """A 64-bit name for each set; equal sets have equal names."""
    return pa.array([int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8, salt=salt.to_bytes(8, "little")).digest(), "little", signed=True) for h in sets], pa.int64())


def bucket_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def id_and_text(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def text_hash(text: str | Column) -> Column:
    """A name for a text (null too) that tells apart the rows of a repeated doc_id."""
    return F.xxhash64(F.col(text).cast("string") if isinstance(text, str) else text.cast("string"))


def statistics(documents: DataFrame, k: int, bits: int = BITS, small: int = 128) -> tuple[np.ndarray, dict[int, int]]:
    """Counts of shingles over all rows by the top bits of their hashes, and how many sets there are of each size below
    `small`: tables of fixed size, whatever the input."""
    slices = 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sizes = np.zeros(1 << bits, dtype=np.int64), np.zeros(small, dtype=np.int64)
        for b in shared.in_batches(batches):
            sets = shingle_sets(*shared.text_bytes(b.column("text")), k)
            np.add.at(total, bucket_of(np.concatenate(sets), bits), 1)
            sizes += np.bincount([min(len(h), small) for h in sets], minlength=small + 1)[:small]
        part = [p.tobytes() for p in np.minimum(total, 65535).astype("<u2").reshape(slices, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(slices + 1), pa.int32()), pa.array([*part, sizes.tobytes()], pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for s, raw in zip(b.column("slice").to_pylist(), b.column("counts").to_pylist(), strict=True):
                total[s] = total.get(s, 0) + np.frombuffer(raw, "<u2" if s < slices else "<i8").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["slice", "counts"])

    rows = id_and_text(documents).select("text").mapInArrow(count, "slice int, counts binary").repartition(16, "slice").mapInArrow(add, "slice int, counts binary").collect()
    out, sizes = np.zeros((slices, (1 << bits) // slices), dtype=np.int64), {}
    for r in rows:
        if r["slice"] < slices:
            out[r["slice"]] = np.frombuffer(r["counts"], np.int64)
        else:
            sizes = {n: int(c) for n, c in enumerate(np.frombuffer(r["counts"], np.int64)) if c and n}
    return np.minimum(out.ravel(), 2**31 - 1).astype(np.int32), sizes


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def left_out(n: int, percent: int) -> int:
    """Most shingles that a set of n can lack in common with a similar one."""
    return n * (100 - percent) // 100


def boundary(sizes: dict[int, int], percent: int, list_rows: float = 4.0, most: int = 40) -> int:
    """Sets of fewer shingles are enumerated: the bound with the fewest rows, of subsets below it and of list entries above,
    where an entry also costs `list_rows` rows met in its list."""

    def subsets(n: int) -> int:
        out, one = 0, 1
        for k in range(left_out(n, percent) + 1):
            out += one
            one = one * (n - k) // (k + 1)
        return out

    def cost(bound: int) -> float:
        return sum(c * (subsets(n) if n * percent < bound * 100 else 0) + c * (prefix_length(n, percent) * (1 + list_rows) if n >= bound else 0) for n, c in sizes.items() if n <= 2 * most)

    return min(range(1, most + 1), key=cost)


def keyed(documents: DataFrame, k: int, counts: np.ndarray, bound: int, percent: int, salt: int, bits: int = BITS) -> DataFrame:
    """(doc_id, th, n, cid, keys, s0 .. s15) of every row: a hash of its text, the keys by which its set meets similar ones, and its parity bitmap."""
    table = documents.sparkSession.sparkContext.broadcast(counts)
    names = ["doc_id", "th", "n", "cid", "keys", *SIGN]

    def keys_of(h: np.ndarray) -> np.ndarray:
        n, out = len(h), []
        if n and n >= bound:
            order = np.lexsort((h, table.value[bucket_of(h, bits)]))
            out.append(shared.mix(h[order[: prefix_length(n, percent) + SHARED - 1]] + shared.GOLD) & ~np.uint64(1))
        if n and n * percent < bound * 100:
            total = h.sum(dtype=np.uint64, keepdims=True)
            sums = []
            for r in range(left_out(n, percent) + 1):
                pick = np.array(list(itertools.combinations(range(n), r)), dtype=int)
                sums.append(total - h[pick].sum(axis=1, dtype=np.uint64) + np.array([n - r], dtype=np.uint64) * shared.GOLD)
            out.append(shared.mix(np.concatenate(sums)) | np.uint64(1))
        return np.concatenate(out) if out else h

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.in_batches(batches):
            sets = shingle_sets(*shared.text_bytes(b.column("text")), k)
            sign = np.zeros((len(sets), len(SIGN)), dtype=np.int64)
            for i, h in enumerate(sets):
                if len(h):
                    sign[i] = np.packbits((np.bincount((h & np.uint64(64 * len(SIGN) - 1)).astype(np.int64), minlength=64 * len(SIGN)) & 1).astype(np.uint8)).view(np.int64)
            keys = [keys_of(h) for h in sets]
            at = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array([len(h) for h in sets], pa.int64()), class_ids(sets, salt), lists, *[pa.array(sign[:, i]) for i in range(len(SIGN))]], names=names)

    return id_and_text(documents).withColumn("th", text_hash("text")).mapInArrow(run, "doc_id long, th long, n long, cid long, keys array<long>, " + ", ".join(f"{x} long" for x in SIGN))


def may_link(a: str, b: str, percent: int) -> Column:
    """False only where sizes or parity bitmaps rule out the similarity."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = sum((F.bit_count(F.col(f"{a}.{x}").bitwiseXOR(F.col(f"{b}.{x}"))) for x in SIGN[1:]), F.bit_count(F.col(f"{a}.{SIGN[0]}").bitwiseXOR(F.col(f"{b}.{SIGN[0]}"))))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (differ * (100 + percent) <= (100 - percent) * (na + nb))


def sets_of(documents: DataFrame, wanted: DataFrame, k: int, salt: int) -> DataFrame:
    """(cid, shingles) of the classes (cid, doc_id) wanted, from the texts again; shingles by the low 6 bytes of their hashes."""
    ids = wanted.filter("doc_id is not null").select(F.col("doc_id").alias("id__"), F.col("cid").alias("cid__"))
    texts = id_and_text(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.in_batches(batches):
            sets = shingle_sets(*shared.text_bytes(b.column("text")), k)
            raw = [h.view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for h in sets]
            yield pa.RecordBatch.from_arrays([b.column("cid__"), class_ids(sets, salt), pa.array(raw, pa.binary())], names=["cid__", "cid", "shingles"])

    schema = "cid__ long, cid long, shingles binary"
    found = texts.join(few(ids), texts["doc_id"] == ids["id__"]).select("cid__", "text").mapInArrow(run, schema).filter("cid = cid__").select("cid", "shingles")
    # classes that only rows without doc_id have; any number of rows may have one
    rest = texts.filter("doc_id is null").select(F.lit(None).cast("long").alias("cid__"), "text").mapInArrow(run, schema).join(wanted.filter("doc_id is null").select("cid"), "cid", "left_semi")
    return found.unionByName(rest.select("cid", "shingles").dropDuplicates(["cid"]))


def few(rows: DataFrame) -> DataFrame:
    """A table of ids, broadcast if it has at most FEW rows."""
    return F.broadcast(rows) if rows.limit(FEW + 1).count() <= FEW else rows


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity."""

    def set_of(raw: bytes) -> np.ndarray:
        out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
        out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
        return out.view(np.uint64).ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.in_batches(batches):
            keep = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                both = np.sort(np.concatenate([set_of(x), set_of(y)]))
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(both) - same))
            keep = np.array(keep, dtype=bool)
            yield pa.RecordBatch.from_arrays([pa.array(b.column(c).to_numpy()[keep]) for c in ("a", "b")], names=["a", "b"])

    one = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y"))
    return one.join(few(pairs), "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def with_strays(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, cid, root, stray) of the lists whose members are in several components; strays are not in the list's largest one."""
    at = members.join(roots, members["cid"] == roots["node"], "left").select("key", "cid", F.coalesce("root", "cid").alias("root"))
    share = at.groupBy("key", "root").agg(F.count("*").alias("n"))
    home = share.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("home"), F.count("*").alias("roots")).filter("roots > 1")
    return at.join(home, "key").select("key", "cid", "root", (F.col("root") != F.col("home")).alias("stray"))


def pivot_pairs(scratch: shared.Scratch, mixed: DataFrame, seed: int) -> DataFrame:
    """Distinct pairs (a, b): in each list the strays with a drawn member of the largest component, and a drawn stray with all of other components."""
    drawn = F.xxhash64("key", "cid", F.lit(seed))
    at = [F.min_by(F.when(c, F.struct("cid", "root")), F.when(c, drawn)).alias(name) for name, c in (("h", ~F.col("stray")), ("s", F.col("stray")))]
    pivots = scratch.save(mixed.groupBy("key").agg(*at))
    with_home = F.when(F.col("stray"), F.col("h.cid"))
    with_stray = F.when(F.col("root") != F.col("s.root"), F.col("s.cid"))
    pair = mixed.join(pivots, "key").select("cid", F.explode(F.array(with_home, with_stray)).alias("pivot")).filter("pivot is not null")
    return pair.select(F.least("cid", "pivot").alias("a"), F.greatest("cid", "pivot").alias("b")).distinct()


def linked(spark: SparkSession, documents: DataFrame, percent: int = PERCENT, k: int = WORDS) -> DataFrame:
    """(doc_id, th, n_shingles, root, component_id) of every row; th is the text's hash, root the least class of the component."""
    scratch = shared.Scratch(spark, "jaccard")
    counts, sizes = statistics(documents, k)
    salt = 0
    whole = scratch.save(keyed(documents, k, counts, boundary(sizes, percent), percent, salt))
    rows = scratch.save(whole.select("doc_id", "th", "n", "cid"))
    # one row for each class: equal sets have equal keys and bitmaps
    sign = scratch.save(whole.filter("n > 0").groupBy("cid").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("keys").alias("keys"), *[F.first(x).alias(x) for x in SIGN]))
    scratch.drop(whole)
    posts = sign.select(F.explode("keys").alias("key"), "cid")
    lists = posts.groupBy("key").agg(F.count("*").alias("c"), F.min("cid").alias("first"), F.max("cid").alias("last")).filter("first < last")
    lists = scratch.save(lists)
    members = scratch.save(posts.join(few(lists.filter("c > 2")), "key"))

    keys, sign = sign, scratch.save(sign.drop("keys"))
    scratch.drop(keys)

    def check(pairs: DataFrame) -> DataFrame:
        names = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
        texts = scratch.save(sets_of(documents, names.join(sign, "cid").select("cid", "doc_id"), k, salt))
        links = scratch.save(verified(pairs, texts, percent).distinct())
        scratch.drop(texts)
        return links

    def similar_signs(pairs: DataFrame) -> DataFrame:
        return pairs.join(sign.alias("m"), F.col("a") == F.col("m.cid")).join(sign.alias("p"), (F.col("b") == F.col("p.cid")) & may_link("m", "p", percent)).select("a", "b")

    # short lists: all pairs, of which similar sets have SHARED keys or one equal subset
    weight = F.when(F.col("key").bitwiseAND(1) == 1, SHARED).otherwise(1).alias("w")
    pairs = lists.filter("c = 2").select(F.col("first").alias("a"), F.col("last").alias("b"), weight)
    short = members.filter(F.col("c") <= SHORT).select("key", "cid")
    met = short.select("key", F.col("cid").alias("a")).join(short.select("key", F.col("cid").alias("b")), "key").filter("a < b").select("a", "b", weight)
    short = scratch.save(pairs.unionByName(met).groupBy("a", "b").agg(F.sum("w").alias("w")))
    often = short.filter(F.col("w") >= SHARED).select("a", "b")
    # long lists: members against the pivots
    members = members.filter(F.col("c") > SHORT)
    star = members.select(F.explode(F.array(F.struct(F.col("first").alias("a"), F.col("cid").alias("b")), F.struct(F.col("cid").alias("a"), F.col("last").alias("b")))).alias("e")).select("e.*").filter("a < b")
    tried = similar_signs(star.unionByName(often).distinct())
    links = check(scratch.save(tried))
    roots = scratch.save(components(scratch, links))
    for r in range(ROUNDS + 1):
        mixed = scratch.save(with_strays(members, roots))
        if not mixed.take(1):
            break
        if r < ROUNDS:
            pairs = pivot_pairs(scratch, mixed, r)
        else:
            # all pairs across components that are left; long lists that hold both are all in `mixed`, so their meetings can be counted
            own = scratch.save(mixed.join(sign.drop("doc_id"), "cid").select("key", "cid", "root", "stray", "n", *SIGN))
            m, p = own.filter("stray").alias("m"), own.alias("p")
            cross = m.join(p, (F.col("m.key") == F.col("p.key")) & (F.col("m.root") != F.col("p.root")) & (~F.col("p.stray") | (F.col("m.cid") < F.col("p.cid"))) & may_link("m", "p", percent))
            often = cross.select(F.col("m.key").alias("key"), F.least("m.cid", "p.cid").alias("a"), F.greatest("m.cid", "p.cid").alias("b")).select("a", "b", weight).groupBy("a", "b").agg(F.sum("w").alias("w"))
            often = often.join(short.withColumnRenamed("w", "more"), ["a", "b"], "left")
            pairs = often.filter(F.col("w") + F.coalesce("more", F.lit(0)) >= SHARED).select("a", "b")
        more = check(scratch.save(similar_signs(pairs) if r < ROUNDS else pairs))
        scratch.drop(mixed)
        if more.take(1):
            roots = scratch.save(components(scratch, roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)))
    named = rows.join(roots, rows["cid"] == roots["node"], "left").select("doc_id", "th", "n", F.when(F.col("n") > 0, F.coalesce("root", "cid")).alias("root"))
    least = named.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = named.join(least, "root", "left")
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), "root", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op10(spark: SparkSession, documents: DataFrame) -> DataFrame:
    return linked(spark, documents).select("doc_id", "n_shingles", "component_id")


def keep_one(spark: SparkSession, documents: DataFrame, percent: int = PERCENT, k: int = WORDS) -> DataFrame:
    """One document of each component, with its columns: the one with the least doc_id (rows without come last), of those that
    share it the one whose text has the least hash. Rows are told apart by doc_id and text, so another text under a repeated
    doc_id is judged by itself. Of rows equal in every column one stays; rows equal in doc_id and text only, all; documents
    without shingles stay."""
    scratch = shared.Scratch(spark, "keep")
    named = scratch.save(linked(spark, documents, percent, k).select("root", "doc_id", "th"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    groups = scratch.save(named.filter("root is not null").groupBy("root").agg(F.min(order).alias("first"), F.max(order).alias("last")).filter("first < last"))
    at = named.join(groups, "root")
    gone = at.filter(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th")))).select(F.col("doc_id").alias("gone__"), F.col("th").alias("th__")).distinct()
    kept = documents.join(gone, documents["doc_id"].cast("long").eqNullSafe(gone["gone__"]) & (text_hash(documents["text"]) == gone["th__"]), "left_anti")
    twice = named.groupBy("doc_id", "th").count().filter("count > 1").limit(1).count()
    return kept.dropDuplicates() if twice else kept
