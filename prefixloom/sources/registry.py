"""Registry files as DataFrames: RPSL text, authorisations and local overrides in JSON, JSON sequences, mirroring streams.

Each source has a reader of files and a function over a column of text, so that bodies that come from elsewhere parse alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ip, text

ROAS = "roas array<struct<asn: string, prefix: string, maxLength: int, ta: string>>"
SLURM = """slurmVersion int, validationOutputFilters struct<prefixFilters: array<struct<prefix: string, asn: long>>>,
 locallyAddedAssertions struct<prefixAssertions: array<struct<asn: long, prefix: string, maxPrefixLength: int>>>"""
#: Fixed value: the trust anchor of local assertions.
LOCAL_ANCHOR = "SLURM file"


def paragraphs_of(body: Column, strip_comments: bool = True) -> Column:
    """Array of the paragraphs of a text: lines between empty ones, each ended by a newline. Lines that begin with # always go,
    those with % if strip_comments; neither ends a paragraph. A line of other white space is not empty."""
    mark = "[%#]" if strip_comments else "#"
    plain = F.regexp_replace(body, r"\r*\n\r*", "\n")
    kept = F.filter(F.split(plain, "\n"), lambda x: ~x.rlike(f"^{mark}"))
    blocks = F.split(F.array_join(kept, "\n"), r"\n{2,}")
    return F.filter(F.transform(blocks, lambda x: F.concat(F.regexp_replace(x, r"^\n+|\n+$", ""), F.lit("\n"))), lambda x: x != "\n")


def read_paragraphs(spark: SparkSession, path: str, strip_comments: bool = True, newline: str = "\n") -> DataFrame:
    """(text) of every paragraph of a dump. Empty lines are the record separator, so that a large file splits over tasks."""
    raw = spark.read.option("lineSep", newline * 2).text(path)
    return raw.select(F.explode(paragraphs_of(F.col("value"), strip_comments)).alias("text"))


def attributes_of(paragraph: Column) -> Column:
    """Array of struct(name, value): attributes in order, continuation lines joined to theirs by newlines; lines without a colon have a null name."""
    folded = F.filter(text.fold_continuations(paragraph), lambda x: x != "")
    ok = lambda x: x.rlike(r"^[A-Za-z][A-Za-z0-9_-]*:")
    name = lambda x: F.when(ok(x), F.lower(F.split_part(x, F.lit(":"), F.lit(1))))
    value = lambda x: F.trim(F.when(ok(x), F.regexp_replace(x, "^[^:]*:", "")).otherwise(x))
    return F.transform(folded, lambda x: F.struct(name(x).alias("name"), F.translate(value(x), "\u0001", "\n").alias("value")))


def roas_of(bodies: DataFrame, body: str = "body") -> DataFrame:
    """(prefix, asn, max_length, trust_anchor) from JSON texts; a malformed number gives null."""
    return _roas(bodies.select(F.from_json(F.translate(body, "\r\n", "  "), ROAS)["roas"].alias("roas")))


def _roas(lists: DataFrame) -> DataFrame:
    rows = lists.select(F.explode("roas").alias("r"))
    return rows.select(F.col("r.prefix").alias("prefix"), ip.as_number(F.col("r.asn"), plain=True, dots=False).alias("asn"), F.col("r.maxLength").alias("max_length"), F.col("r.ta").alias("trust_anchor"))


def read_roas(spark: SparkSession, path: str) -> DataFrame:
    return _roas(spark.read.schema(ROAS).option("multiLine", "true").json(path))


def slurm_of(bodies: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Filters (prefix, asn) and assertions (prefix, asn, max_length, trust_anchor). Versions other than 1 are an error."""
    s = bodies.select(F.from_json(F.translate(body, "\r\n", "  "), SLURM).alias("s")).select("s.*")
    s = s.withColumn("ok", F.when(F.col("slurmVersion") == 1, True).otherwise(F.raise_error(F.lit("SLURM data has an invalid version"))))
    filters = s.filter("ok").select(F.explode("validationOutputFilters.prefixFilters").alias("f")).select("f.*")
    added = s.filter("ok").select(F.explode("locallyAddedAssertions.prefixAssertions").alias("a"))
    own = F.split_part("a.prefix", F.lit("/"), F.lit(2)).try_cast("int")
    length = F.coalesce("a.maxPrefixLength", own, F.when(F.col("a.prefix").contains(":"), 128).otherwise(32))
    return filters, added.select(F.col("a.prefix").alias("prefix"), F.col("a.asn").alias("asn"), length.alias("max_length"), F.lit(LOCAL_ANCHOR).alias("trust_anchor"))


def apply_slurm(roas: DataFrame, filters: DataFrame, assertions: DataFrame) -> DataFrame:
    """Authorisations without those that a filter's origin, prefix or both cover, and with the assertions.

    A prefix is covered if one of its leading bit strings is the filter's: an equi-join on at most 130 lengths, not a range join."""
    roas = roas.withColumn("bits", ip.prefix_bits(F.col("prefix")))
    filters = filters.withColumn("bits", ip.prefix_bits(F.col("prefix")))
    left = roas.join(filters.filter("asn is not null and prefix is null").select("asn").distinct(), "asn", "left_anti")
    spans = filters.filter("bits is not null").select(F.col("bits").alias("f_bits"), F.col("asn").alias("f_asn")).distinct()
    lengths = spans.select(F.length("f_bits").alias("n")).distinct()
    under = left.select("bits", "asn").distinct().join(F.broadcast(lengths), F.col("n") <= F.length("bits"))
    under = under.withColumn("f_bits", F.col("bits").substr(F.lit(1), F.col("n")))
    hit = under.join(spans, "f_bits").filter("f_asn is null or f_asn = asn").select("bits", "asn").distinct()
    return left.join(hit, ["bits", "asn"], "left_anti").select("prefix", "asn", "max_length", "trust_anchor").unionByName(assertions)


def jsonseq_of(body: Column, schema: str) -> Column:
    """Array of the records of a JSON sequence."""
    return F.transform(F.filter(F.split(body, "\u001e"), lambda x: F.trim(F.translate(x, "\r\n\t", "")) != ""), lambda x: F.from_json(x, schema))


def read_jsonseq(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-sequence file. The record separator is the line separator, so that a large file splits over tasks."""
    rows = spark.read.option("lineSep", "\x1e").text(path)
    return rows.filter(F.trim(F.translate("value", "\r\n\t", "")) != "").select(F.from_json("value", schema).alias("r")).select("r.*")


def mirror_operations(streams: DataFrame, body: str = "body") -> DataFrame:
    """(source, version, problem, serial, operation, text): operations of mirroring streams, versions 1 and 3, and what is wrong with a stream.

    Version 3 names a serial for each operation; in version 1 they count from the first. A stream with a problem has one row without operation."""
    s = streams.select(F.regexp_replace(body, "\r", "").alias("b"))
    start = r"(?m)^%START Version: (\d+) (\S+) (\d+)-(\d+|LAST)"
    ops = r"(?ms)^(ADD|DEL)[ ]?(\d*)[ ]*\n\n(.+?\n)(?=\n|\z)"
    part = lambda i: F.regexp_extract_all("b", F.lit(ops), F.lit(i))
    s = s.select("b", *[F.regexp_extract("b", start, i).alias(n) for i, n in enumerate(("version", "source", "first", "last"), 1)], F.regexp_count("b", F.lit(r"(?m)^%START")).alias("starts"), part(1).alias("op"), part(2).alias("serials"), part(3).alias("texts"))
    first, last = F.col("first").try_cast("long"), F.col("last").try_cast("long")
    own = F.transform("serials", lambda x, i: F.when(F.col("version") == "3", x.try_cast("long")).otherwise(first + i))
    s = s.withColumn("serials", own)
    ordered = F.aggregate("serials", F.struct(F.lit(True).alias("ok"), F.lit(-1).cast("long").alias("at")), lambda a, x: F.struct((a["ok"] & x.isNotNull() & (x >= a["at"])).alias("ok"), F.coalesce(x, a["at"]).alias("at")))["ok"]
    problem = (
        F.when(F.col("starts") == 0, "no start").when(F.col("starts") > 1, "more than one start").when(F.col("version") == "", "malformed start").when(~F.col("version").isin("1", "3"), "bad version")
        .when(~F.coalesce(F.col("b").rlike(r"(?m)^%END"), F.lit(False)), "no end").when((F.col("version") == "1") & (F.size("op") > last - first + 1), "too many operations").when(~ordered, "serials out of order")
    )
    s = s.withColumn("problem", problem).withColumn("rows", F.when(problem.isNull(), F.arrays_zip("op", "serials", "texts")))
    return s.select("source", "version", "problem", F.explode_outer("rows").alias("r")).select("source", "version", "problem", F.col("r.serials").alias("serial"), F.col("r.op").alias("operation"), F.col("r.texts").alias("text"))
