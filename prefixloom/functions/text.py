"""Registry text as Column expressions: masking, normalising, validating and rendering attribute values."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Password schemes whose hashes are masked, and what stands for them.
HASH_SCHEMES = ("CRYPT-PW", "MD5-PW", "BCRYPT-PW")
HASH_MASK = "DummyValue  # Filtered for security"
#: Words that no object may be named after, and how no name may begin.
RESERVED_WORDS = ("ANY", "AS-ANY", "RS_ANY", "PEERAS", "AND", "OR", "NOT", "ATOMIC", "FROM", "TO", "AT", "ACTION", "ACCEPT", "ANNOUNCE", "EXCEPT", "REFINE", "NETWORKS", "INTO", "INBOUND", "OUTBOUND")
RESERVED_PREFIXES = ("AS-", "RS-", "RTRS-", "FLTR-", "PRNG-")


def mask_hashes(s: Column) -> Column:
    return F.regexp_replace(s, rf"(?i)({'|'.join(HASH_SCHEMES)})[^\n]+", f"$1 {HASH_MASK}")


def strip_last_modified(s: Column) -> Column:
    return F.regexp_replace(s, r"(?m)^last-modified: [^\n]+\n", "")


def lines(s: Column) -> Column:
    """Lines at newlines only, those around the text left out, without carriage returns around them; an empty text has none."""
    inner = F.regexp_replace(s, r"^\n+|\n+\z", "")
    return F.when(F.length(s) > 0, F.transform(F.split(inner, "\n"), lambda x: F.regexp_replace(x, r"^\r+|\r+\z", ""))).otherwise(F.array().cast("array<string>"))


def camel(s: Column) -> Column:
    p = F.split(s, "[_-]")
    return F.concat(F.get(p, 0), F.array_join(F.transform(F.slice(p, 2, F.greatest(F.lit(0), F.size(p) - 1)), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(x.substr(F.lit(2), F.length(x))))), ""))


def normalise_value(s: Column) -> Column:
    """Comments from # on cut, lines trimmed, empty ones dropped, the rest joined by commas."""
    cut = F.transform(F.split(s, "\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")))
    return F.array_join(F.filter(cut, lambda x: x != ""), ",")


def fold_continuations(s: Column) -> Column:
    """Attribute lines: those that begin with a space, tab or plus join the line before."""
    return F.split(F.regexp_replace(s, r"\n[ \t+]\s*", "\u0001"), "\n")


def route_key(s: Column) -> Column:
    return F.translate(F.upper(s), " -", "")


def list_values(s: Column) -> Column:
    return F.filter(F.transform(F.split(s, ","), lambda x: F.trim(x)), lambda x: x != "")


def set_name_ok(s: Column, *prefixes: str) -> Column:
    """One to five parts at colons, each an AS number or a set name, and at least one set name."""
    p = F.split(F.upper(F.trim(s)), ":")
    name = rf"^(?:{'|'.join(map(re.escape, prefixes or ('AS-',)))})[A-Z0-9_-]*[A-Z0-9]$"
    return (F.size(p) <= 5) & F.forall(p, lambda x: x.rlike(r"^AS\d+$") | x.rlike(name)) & F.exists(p, lambda x: x.rlike(name))


def generic_name_ok(s: Column) -> Column:
    u = F.upper(F.trim(s))
    return u.rlike(r"^[A-Z][A-Z0-9_-]*[A-Z0-9]$") & ~u.isin(*RESERVED_WORDS) & ~F.coalesce(_starts(u), F.lit(False))


def _starts(u: Column) -> Column:
    out = F.lit(False)
    for p in RESERVED_PREFIXES:
        out = out | u.startswith(p)
    return out


def email_ok(s: Column) -> Column:
    """A local part, and a domain of letters, digits, dots and dashes or an address in brackets."""
    local, domain = r"[a-z0-9$!#%&\"*+/=?^_`{|}~\\.-]+", r"(?:[a-z0-9\\.-]+|\[\d+\.\d+\.\d+\.\d+\]|\[[a-f\d:]+\])"
    return s.rlike(f"(?i)^{local}@{domain}$")


def fingerprint(s: Column) -> Column:
    """Groups of four, with a wider gap after the fifth."""
    four = F.trim(F.regexp_replace(s, "(.{4})", "$1 "))
    return F.concat(F.substring(four, 1, 24), F.lit("  "), F.substring(four, 26, 100))


def canonical_answer(s: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(s, r"\s+"), lambda x: x != ""))), " ")


def iso_utc(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def render(names_and_values: list[tuple[str, Column]]) -> Column:
    """Attribute lines with names padded to 16 characters; further lines of a value are indented as far."""
    out = [F.concat(F.rpad(F.lit(f"{n}:"), 16, " "), F.regexp_replace(v, "\n", "\n" + " " * 16), F.lit("\n")) for n, v in names_and_values]
    return F.concat(*out)


def wire(s: Column) -> Column:
    """An answer framed by its length in bytes; nothing to say is C alone."""
    return F.when(s.isNull() | (s == ""), F.lit("C\n")).otherwise(F.concat(F.lit("A"), (F.octet_length(s) + 1).cast("string"), F.lit("\n"), s, F.lit("\nC\n")))


def render_lines(attributes: Column, last_modified: Column | None = None) -> Column:
    """Text of an array of struct(name, value): names padded to 16 characters, empty values after the bare name, further
    lines after 16 places, which begin with a plus where the line is empty. With a time, older last-modified lines give way to one of it."""
    pad = " " * 15

    def one(x: Column) -> Column:
        further = lambda v: F.concat(F.when(v == "", "+").otherwise(" "), F.lit(pad), v)
        rows = lines(x["value"])
        rest = F.transform(F.slice(rows, 2, F.greatest(F.lit(0), F.size(rows) - 1)), further)
        first = F.concat(F.rpad(F.concat(x["name"], F.lit(":")), F.greatest(F.lit(16), F.length(x["name"]) + 1), " "), F.get(rows, 0))
        return F.when(F.size(rows) == 0, F.concat(x["name"], F.lit(":"))).otherwise(F.concat_ws("\n", first, rest))

    if last_modified is not None:
        attributes = F.concat(F.filter(attributes, lambda x: x["name"] != "last-modified"), F.array(F.struct(F.lit("last-modified").alias("name"), iso_utc(last_modified).alias("value"))))
    return F.concat(F.array_join(F.transform(attributes, one), "\n"), F.lit("\n"))


def template_line(name: Column, width: Column, optional: Column, multiple: Column, primary: Column, lookup: Column, strong: Column, referring: Column) -> Column:
    """A line of a class's template: name, need, number, keys and references."""
    key = F.when(primary & lookup, "primary/look-up key").when(primary, "primary key").when(lookup, "look-up key")
    refers = F.when(F.size(referring) > 0, F.concat(F.when(strong, "strong").otherwise("weak"), F.lit(" references "), F.array_join(referring, "/")))
    need, number = F.when(optional, "[optional] ").otherwise("[mandatory]"), F.when(multiple, "[multiple]").otherwise("[single]  ")
    return F.concat(name, F.lit(": "), F.repeat(F.lit(" "), (width - F.length(name)).cast("int")), F.lit("  "), need, F.lit("  "), number, F.lit("  ["), F.concat_ws(", ", key, refers), F.lit("]"))


@F.pandas_udf(StringType())
def unified_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """Unified difference of two texts, without the lines of file names; null where either is null."""
    told = lambda a, b: None if a is None or b is None else "\n".join([*difflib.unified_diff(a.strip("\n").split("\n"), b.strip("\n").split("\n"), lineterm="")][2:])
    return pd.Series([told(a, b) for a, b in zip(old, new, strict=True)], dtype=object)
