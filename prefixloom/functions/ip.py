"""Address prefixes and AS numbers as Column expressions. IPv4 addresses are longs, IPv6 addresses 16 bytes, big-endian."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType


def power(bits: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits.cast("int"))


def network(address: Column, length: Column) -> Column:
    """The first address of the prefix of that length around an address."""
    host = (F.lit(32) - length).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", address.cast("long"), host), host)


def last_of(first: Column, length: Column) -> Column:
    return first + power(F.lit(32) - length) - 1


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often use names it: as nested expressions it would be copied each time."""
    return F.get(F.transform(F.array(value), use), 0)


def address(text: Column) -> Column:
    """Dotted quad to long; null unless it is four numbers of at most 255. Leading zeros are allowed."""
    octet = lambda so_far, x: let(x.cast("long"), lambda n: F.when(n <= 255, so_far * 256 + n))
    return F.when(text.rlike(r"^\s*\d{1,3}(\.\d{1,3}){3}\s*$"), F.aggregate(F.split(F.trim(text), r"\."), F.lit(0).cast("long"), octet))


def dotted(a: Column) -> Column:
    return F.concat_ws(".", *[F.call_function("shiftright", a, F.lit(s)).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])


def prefix_pair(text: Column) -> Column:
    """struct(first, length) of a.b.c.d/n; a bare address is a /32; null for host bits or bad numbers."""
    n = F.when(text.contains("/"), F.split_part(F.trim(text), F.lit("/"), F.lit(2)).try_cast("int")).otherwise(F.lit(32))
    both = F.struct(address(F.split_part(F.trim(text), F.lit("/"), F.lit(1))).alias("first"), let(n, lambda n: F.when(n.between(0, 32), n)).alias("length"))
    return let(both, lambda x: F.when(network(x["first"], x["length"]) == x["first"], x))


def prefix(text: Column) -> tuple[Column, Column]:
    """The two of prefix_pair, as columns of their own."""
    pair = prefix_pair(text)
    return pair["first"], pair["length"]


def address_range(text: Column) -> tuple[Column, Column]:
    """(first, last) of `a - b` with commas ignored, or of one address; nulls where the first exceeds the last."""
    t = F.translate(text, ",", "")
    a = address(F.split_part(t, F.lit("-"), F.lit(1)))
    b = F.when(t.contains("-"), address(F.split_part(t, F.lit("-"), F.lit(2)))).otherwise(a)
    return F.when(a <= b, a), F.when(a <= b, b)


def as_number(text: Column, plain: bool = False, dots: bool = True) -> Column:
    """ASn or ASh.l to a long; null if malformed or beyond 32 bits. plain: the letters may be missing."""
    lead = "^(?:AS)?" if plain else "^AS"

    # digits are cast only where they stand: a cast that fails costs an exception
    whole, halves = lead + r"(\d{1,10})$", lead + r"(\d{1,5})\.(\d{1,5})$"

    def read(t: Column) -> Column:
        value = F.when(t.rlike(whole), F.regexp_extract(t, whole, 1).cast("long"))
        if dots:
            both = F.struct(*[F.regexp_extract(t, halves, i).cast("long").alias(n) for i, n in ((1, "high"), (2, "low"))])
            value = value.when(t.rlike(halves), let(both, lambda h: F.when((h["high"] < 65536) & (h["low"] < 65536), h["high"] * 65536 + h["low"])))
        return let(value, lambda v: F.when(v <= 4294967295, v))

    return let(F.upper(F.trim(text)), read)


def overlaps(a_first: Column, a_last: Column, b_first: Column, b_last: Column) -> Column:
    return (a_first <= b_last) & (b_first <= a_last)


def covers(a_first: Column, a_last: Column, b_first: Column, b_last: Column) -> Column:
    """a is b or less specific than b."""
    return (a_first <= b_first) & (a_last >= b_last)


#: Types as objects: a schema in text could only be read with a session at hand, and this module is imported without one.
V6 = StructType([StructField("first", BinaryType()), StructField("last", BinaryType()), StructField("length", IntegerType())])


@F.pandas_udf(V6)
def ipv6_prefix(text: pd.Series) -> pd.DataFrame:
    """First and last address and length of an IPv6 prefix; nulls where it is none. 128-bit numbers have no SQL type."""
    rows = []
    for t in text:
        try:
            net = ipaddress.IPv6Network((t or "").strip())
            rows.append((net.network_address.packed, net.broadcast_address.packed, net.prefixlen))
        except ValueError:
            rows.append((None, None, None))
    return pd.DataFrame(rows, columns=["first", "last", "length"]).astype({"length": "Int32"})


def prefix_bits(text: Column) -> Column:
    """The version and the network bits of an IPv4 or IPv6 prefix as text, like 4:00001010: a prefix lies in another whose bits begin its own."""
    first, length = prefix(text)
    four = F.concat(F.lit("4:"), F.lpad(F.conv(first.cast("string"), 10, 2), 32, "0").substr(F.lit(1), length))
    v6 = ipv6_prefix(text)
    h = F.hex(v6["first"])
    half = lambda at: F.lpad(F.conv(F.substring(h, at, 16), 16, 2), 64, "0")
    six = F.concat(F.lit("6:"), F.concat(half(1), half(17)).substr(F.lit(1), v6["length"]))
    return F.when(text.contains(":"), six).otherwise(four)
