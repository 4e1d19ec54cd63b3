"""Attribute values as Column expressions: placeholders, members, dates, names, status lines and submissions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import ip, text

#: Widths, schemes and patterns of attribute values.
WIDTH = 16
STRICT_SCHEMES = ("BCRYPT-PW",)
DNS_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
META = ("password", "override", "api-key", "delete", "suspension")


def clean_address_error(s: Column) -> Column:
    return F.regexp_replace(s, r"(?i)IP\('[A-F0-9:./]+'\) has ", "")


def with_placeholders(body: Column, pk: Column, values: dict[str, str], remarks: str | None = None) -> Column:
    """An object's text with some attributes' values replaced (%s: its key) and, if that changed it, remarks at its end."""

    def line(x: Column) -> Column:
        out = x
        for name, value in values.items():
            out = F.when(x.startswith(f"{name}:"), F.concat(F.lit(f"{name}:".ljust(WIDTH)), F.replace(F.lit(value), F.lit("%s"), pk))).otherwise(out)
        return out

    plain = F.regexp_replace(body, r"\n$", "")
    new = F.concat(F.array_join(F.transform(F.split(plain, "\n"), line), "\n"), F.lit("\n"))
    if remarks:
        new = F.when(new != body, F.concat(new, F.lit("".join("remarks:".ljust(WIDTH) + r + "\n" for r in remarks.split("\n"))))).otherwise(new)
    return F.when(body == "", body).otherwise(new)


def printable(s: Column) -> Column:
    """Control, format, unassigned and separator characters go; space, newline, return, tab and the zero-width joiner stay."""
    return F.regexp_replace(s, r"[\p{C}\p{Zs}\p{Zl}\p{Zp}&&[^ \n\r\t\x{200D}]]", "")


def changed_ok(s: Column) -> Column:
    """An address, and a date of eight digits where one follows."""
    p = F.split(s, " ")
    date = F.get(p, 1)
    day = date.rlike(r"^\d{8}$") & F.try_to_timestamp(date, F.lit("yyyyMMdd")).isNotNull()
    return (F.size(p) <= 2) & text.email_ok(F.get(p, 0)) & (date.isNull() | (date == "") | day)


def dns_ok(s: Column) -> Column:
    return s.rlike(rf"^(?:{DNS_LABEL}\.)*{DNS_LABEL}$")


def url_ok(s: Column) -> Column:
    return s.rlike(r"(?i)^https?://[^/?#]+")


def auth_ok(s: Column, schemes: tuple[str, ...] = STRICT_SCHEMES) -> Column:
    """A known scheme and one word, or the short name of a key."""
    return s.rlike(rf"(?i)^(?:{'|'.join(schemes)}) [^ ,]*$") | F.upper(s).rlike("^PGPKEY-[A-F0-9]{8}$")


def as_block(s: Column) -> tuple[Column, Column]:
    """(first, last) of `ASa - ASb`; nulls where one is malformed or the first is the higher one."""
    at = F.instr(s, "-")
    a, b = ip.as_number(F.trim(s.substr(F.lit(1), at - 1))), ip.as_number(F.trim(s.substr(at + 1, F.length(s))))
    ok = (at > 0) & (a <= b)
    return F.when(ok, a), F.when(ok, b)


def route_set_member(s: Column) -> Column:
    """The member as it is stored, or null: a set's name, an AS number or an IPv4 prefix, each with a range operator or none."""
    at = F.instr(s, "^")
    parts = F.struct(at.alias("at"), F.when(at > 0, s.substr(F.lit(1), at - 1)).otherwise(s).alias("base"), F.when(at > 0, s.substr(at + 1, F.length(s))).alias("op"))

    def of_parts(p: Column) -> Column:
        read = F.struct(ip.prefix_pair(p["base"]).alias("prefix"), ip.as_number(p["base"]).alias("number"))
        return ip.let(read, lambda x: stored(p["at"], p["base"], p["op"], x["prefix"]["first"], x["prefix"]["length"], x["number"]))

    def stored(at: Column, base: Column, op: Column, first: Column, length: Column, number: Column) -> Column:
        one = F.when(op.rlike(r"^\d{1,3}$"), op.cast("int"))
        span = r"^(\d{1,3})-(\d{1,3})$"
        low, high = (F.when(op.rlike(span), F.regexp_extract(op, span, i).cast("int")) for i in (1, 2))
        ranged = op.isNull() | op.isin("-", "+") | F.coalesce(one >= length, F.lit(False)) | F.coalesce((low >= length) & (high >= low), F.lit(False))
        name = F.when(text.set_name_ok(base, "RS-", "AS-"), F.upper(F.trim(base)))
        name = name.when(number.isNotNull(), F.concat(F.lit("AS"), number.cast("string")))
        name = name.when(first.isNotNull() & ranged, F.concat(ip.dotted(first), F.lit("/"), length.cast("string")))
        return F.when((at == 0) | (op != ""), F.concat(name, F.when(op.isNull(), "").otherwise(F.concat(F.lit("^"), op))))

    return ip.let(parts, of_parts)


def status_line(s: Column) -> Column:
    """Struct of what a server says of a source: source, mirrorable (null: neither Y nor N), oldest, newest, exported (null: never)."""
    p = F.split(s, ":")
    serials = F.split(F.get(p, 2), "-")
    flag = F.upper(F.get(p, 1))
    return F.struct(
        F.upper(F.get(p, 0)).alias("source"), F.when(flag == "Y", True).when(flag == "N", False).alias("mirrorable"),
        F.get(serials, 0).try_cast("long").alias("oldest"), F.get(serials, 1).try_cast("long").alias("newest"), F.get(p, 3).try_cast("long").alias("exported"),
    )


def hierarchical(s: Column) -> Column:
    """Does a set's name begin with an AS number?"""
    return ip.as_number(F.split_part(s, F.lit(":"), F.lit(1))).isNotNull()


def submitted(body: Column) -> Column:
    """Array of struct(text, delete_reason, suspension, meta): the objects of a submission, in order. Lines of META are no part of an
    object's text; meta holds all of the block's as struct(name, value). Blocks of such lines alone have an empty text."""
    blocks = F.filter(F.transform(F.split(F.translate(body, "\r", ""), "\n\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    is_meta = lambda x: x.rlike(f"^(?:{'|'.join(META)}):")

    def block(b: Column) -> Column:
        lines = F.split(b, "\n")
        meta = F.transform(F.filter(lines, is_meta), lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)).alias("name"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))
        last = lambda name: F.try_element_at(F.filter(meta, lambda m: m["name"] == name), F.lit(-1))["value"]
        kept = F.array_join(F.transform(F.filter(lines, lambda x: ~is_meta(x)), lambda x: F.concat(x, F.lit("\n"))), "")
        return F.struct(kept.alias("text"), last("delete").alias("delete_reason"), last("suspension").alias("suspension"), meta.alias("meta"))

    return F.transform(blocks, block)
