"""Rules as data: alert rules and watchlists compiled to column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def condition(slot: Column, operator: str, value: str | None = None, values: Sequence[str] = (), *, as_of: Column | None = None) -> Column:
    """One condition; a null slot and an unknown operator are false. within_days: from as_of, 0 to that many days ahead."""
    if operator == "in":
        test = slot.isin(*values)
    elif operator == "eq":
        test = slot == value
    elif operator in ("gt", "lt"):
        number = slot.try_cast("double")
        test = number > float(value) if operator == "gt" else number < float(value)
    elif operator == "within_days":
        gap = F.datediff(F.to_date(F.try_to_timestamp(slot)), as_of)
        test = gap.between(0, int(value))
    else:
        return F.lit(False)
    return F.coalesce(test, F.lit(False))


def rule(conditions: Sequence[Column], logic: str = "AND", *, event_type: Column | None = None, event_types: Sequence[str] = (), topics: Column | None = None, wanted: Sequence[str] = (), body: Column | None = None, keywords: Sequence[str] = ()) -> Column:
    """Pre-filters, then the conditions: AND needs one at least, OR of none is true."""
    out = F.lit(True)
    if event_types:
        out = out & event_type.isin(*event_types)
    if wanted:
        out = out & F.arrays_overlap(topics, F.array(*map(F.lit, wanted)))
    if keywords:
        hit = F.lit(False)
        for k in keywords:
            hit = hit | F.lower(body).contains(k.lower())
        out = out & hit
    if logic == "AND":
        if not conditions:
            return F.lit(False)
        for c in conditions:
            out = out & c
        return out
    if conditions:
        any_of = F.lit(False)
        for c in conditions:
            any_of = any_of | c
        out = out & any_of
    return out


def watchlist(entities: Column, publisher: Column, event_type: Column, topics: Column, spec: dict[str, Sequence[str]]) -> Column:
    """(entity or publisher) and event type and topic; without entities and publishers nothing is watched."""
    primary = F.lit(False)
    if spec.get("entities"):
        primary = primary | F.arrays_overlap(entities, F.array(*map(F.lit, spec["entities"])))
    if spec.get("publishers"):
        primary = primary | publisher.isin(*spec["publishers"])
    out = primary
    if spec.get("event_types"):
        out = out & event_type.isin(*spec["event_types"])
    if spec.get("topics"):
        out = out & F.arrays_overlap(topics, F.array(*map(F.lit, spec["topics"])))
    return out
