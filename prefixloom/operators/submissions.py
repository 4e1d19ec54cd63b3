"""Checks of submitted changes and queries that look at one request alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Filters that do not narrow a query enough by themselves.
WIDE_FILTERS = ("object_class", "rpki_status", "scope_filter_status", "route_preference_status", "sources", "sql_trace")


def described_once(has_text: Column, has_attributes: Column) -> Column:
    """An object is given by its text or by its attributes, never both or neither."""
    return F.coalesce(has_text, F.lit(False)) != F.coalesce(has_attributes, F.lit(False))


def suspension_status(kind: Column, object_class: Column, enabled: Column) -> Column:
    """The first check that a request to suspend or reactivate fails, else processing: known kind, source that allows it, a mntner."""
    known = F.coalesce(F.upper(kind).isin("SUSPEND", "REACTIVATE"), F.lit(False))
    allowed, fits = F.coalesce(enabled, F.lit(False)), F.coalesce(object_class == "mntner", F.lit(False))
    return F.when(~known, "error: parsing").when(~allowed, "error: non-authoritative source").when(~fits, "error: parsing").otherwise("processing")


def specific_enough(filters: Column, rpki_status: Column) -> Column:
    """Whether a query has a filter beyond the wide ones, or asks for valid or for invalid objects alone."""
    other = F.size(F.array_except(filters, F.array(*map(F.lit, WIDE_FILTERS)))) > 0
    alone = (F.size(rpki_status) == 1) & F.get(rpki_status, 0).isin("valid", "invalid")
    return other | F.coalesce(alone, F.lit(False))
