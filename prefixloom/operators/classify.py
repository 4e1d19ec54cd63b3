"""The three bulk classifications: origin validation, scope, and source preference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ip
from .ladder import containing


def _place(rows: DataFrame) -> list[str]:
    """The columns that make up a prefix, its length among them."""
    return ["bits", "plen"] if "bits" in rows.columns else ["ip_first", "plen"]


def origin_validity(routes: DataFrame, roas: DataFrame, skip_sources: tuple[str, ...] = ()) -> DataFrame:
    """pk, rpki_status: valid if a covering authorisation has the route's origin (never AS 0) and allows its length, invalid if
    one covers it and none fits, else not_found. Authorisations of one prefix and origin count by their largest max_length, so
    that a short prefix with many authorisations costs a row an origin."""
    roas = roas.groupBy(*_place(roas), "asn").agg(F.max("max_length").alias("max_length"))
    pairs = containing(routes.filter(~F.col("source").isin(*skip_sources)) if skip_sources else routes, roas)
    fits = (F.col("o_asn") != 0) & (F.col("o_asn") == F.col("asn")) & (F.col("plen") <= F.col("o_max_length"))
    judged = pairs.groupBy("pk").agg(F.max(fits.cast("int")).alias("fits"))
    status = F.when(F.col("fits") == 1, "valid").when(F.col("fits") == 0, "invalid").otherwise("not_found")
    return routes.select("pk", "source").join(judged, "pk", "left").select("pk", status.alias("rpki_status"))


def scope(objects: DataFrame, prefixes: list[tuple[int, int]], as_ranges: list[tuple[int, int]], skip_sources: tuple[str, ...] = ()) -> Column:
    """Status of rows with (ip_first, ip_last, asn, source): a short configured list becomes one literal predicate; prefixes go first."""
    hit = lambda parts: F.coalesce(_any(parts), F.lit(False))
    by_prefix = hit([ip.overlaps(F.col("ip_first"), F.col("ip_last"), F.lit(a), F.lit(b)) for a, b in prefixes])
    by_as = hit([F.col("asn").between(a, b) for a, b in as_ranges])
    free = F.col("source").isin(*skip_sources) if skip_sources else F.lit(False)
    return F.when(free, "in_scope").when(by_prefix, "out_scope_prefix").when(by_as, "out_scope_as").otherwise("in_scope")


def _any(parts: list[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def preference(routes: DataFrame, preferences: DataFrame) -> DataFrame:
    """pk, status: a route is suppressed if any route that covers it, is covered by it, or has its prefix stands in a source of
    strictly higher preference; routes of sources without preference are visible and count for nobody.

    Prefixes are reduced to their highest preference first; each covering pair of prefixes is found once and used both ways."""
    place = _place(routes)
    rated = routes.join(F.broadcast(preferences), "source", "left")
    best = rated.filter("pref is not null").groupBy(*place).agg(F.max("pref").alias("pref"))
    pairs = containing(best, best)
    both = pairs.select(*place, F.col("o_pref").alias("other")).unionByName(pairs.select(*[F.col(f"o_{c}").alias(c) for c in place], F.col("pref").alias("other")))
    top = both.groupBy(*place).agg(F.max("other").alias("top"))
    status = F.when(F.col("top") > F.col("pref"), "suppressed").otherwise("visible")
    return rated.join(top, place, "left").select("pk", status.alias("status"))


def permitted(addresses: DataFrame, entries: DataFrame, address: str = "ip_first") -> DataFrame:
    """addresses with `permitted`: whether any entry (ip_first, ip_last) holds the address. A configured list, so a semi-join by range is cheap."""
    held = entries.select(F.col("ip_first").alias("a_first"), F.col("ip_last").alias("a_last"))
    inside = F.col(address).between(F.col("a_first"), F.col("a_last"))
    return addresses.join(held, inside, "left_semi").withColumn("permitted", F.lit(True)).unionByName(addresses.join(held, inside, "left_anti").withColumn("permitted", F.lit(False)))


def visible(rpki: str = "rpki_status", scoped: str = "scopefilter_status", preferred: str = "route_preference_status") -> Column:
    return F.col(rpki).isin("valid", "not_found") & (F.col(scoped) == "in_scope") & (F.col(preferred) == "visible")


def transitions(objects: DataFrame, new_status: DataFrame, column: str = "rpki_status") -> DataFrame:
    """(k, operation): journal entries of objects whose visibility a new status turns: ADD where it appears, DEL where it goes."""
    both = objects.join(new_status.withColumnRenamed(column, "new_status"), "k")
    now = visible().alias("was")
    then = visible(rpki="new_status")
    out = both.withColumn("was", now).withColumn("is", then).filter(F.col("was") != F.col("is"))
    return out.select("k", F.when(F.col("is"), "ADD").otherwise("DEL").alias("operation"))
