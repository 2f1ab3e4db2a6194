"""What an extract of map objects keeps: ids, promoted tags and row conditions, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def at_id(way_id: Column, osm_id: Column) -> Column:
    """``way/n`` or ``relation/n``: a way's id if there is one, else a relation's; ids without their sign."""
    whole = lambda c: F.abs(F.nullif(F.trim(c.cast("string")), F.lit("")).try_cast("bigint"))
    named = lambda kind, c: F.concat(F.lit(f"{kind}/"), whole(c).cast("string"))
    return F.when(whole(way_id) > 0, named("way", way_id)).when(whole(osm_id) != 0, named("relation", osm_id))


def promoted(tags: Column, names: list[str]) -> list[Column]:
    """Tags as columns of their own."""
    return [F.try_element_at(tags, F.lit(n)).alias(n) for n in names]


def has_text(value: Column) -> Column:
    return F.coalesce(value != "", F.lit(False))


def admin_rows(properties: list[str], relation_ids: list[int], more: list[str] = ()) -> Column:
    """Administrative boundaries with one of the properties or relation ids; ``more`` are SQL conditions. Nothing to look for raises."""
    wanted = [has_text(F.col(f"`{p}`")) for p in properties]
    if relation_ids:
        wanted.append(F.coalesce((-F.col("osm_id")).isin(relation_ids), F.lit(False)))
    if not wanted:
        raise ValueError("an extract needs properties or relation ids")
    return reduce(lambda a, b: a & b, [F.expr(m) for m in more], (F.col("boundary") == "administrative") & reduce(lambda a, b: a | b, wanted))


def admin_candidates(levels: list[str]) -> Column:
    return (F.col("boundary") == "administrative") & F.col("admin_level").isin(levels)


def postal_rows() -> Column:
    return (F.col("boundary") == "postal_code") & has_text(F.col("postal_code"))


def postal_candidates() -> Column:
    """Any postal boundary, with a code or without."""
    return F.coalesce(F.col("boundary") == "postal_code", F.lit(False))
