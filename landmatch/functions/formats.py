"""Numbers and places as the report shows them. German digits: points between thousands, a comma before decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GAP = " "
DASH = "—"


def number(value: Column, decimals: int = 0) -> Column:
    """At most so many decimals, halves away from zero, no trailing zeros."""
    text = F.format_number(F.round(value, decimals), decimals)
    short = F.regexp_replace(text, r"(\.\d*?)0+$", "$1") if decimals else text
    return F.translate(F.regexp_replace(short, r"\.$", ""), ",.", ".,")


def unit(text: Column, name: str) -> Column:
    return F.concat(text, F.lit(GAP + name))


def percent_points(value: Column) -> Column:
    """No decimals above 10, two below, three where two would show nothing."""
    size = F.abs(value)
    tiny = F.round(size, 2) == 0
    return unit(F.when(value == 0, "0").when(size > 10, number(value)).when(tiny, number(value, 3)).otherwise(number(value, 2)), "%")


def metres(value: Column) -> Column:
    size = F.abs(value)
    return unit(F.when(size < 1, number(value, 2)).when(size < 10, number(value, 1)).otherwise(number(value)), "m")


def area(m2: Column) -> Column:
    """Square metres below a tenth of a square kilometre, else square kilometres with two, one or no decimals."""
    km2 = m2 / 1_000_000
    size = F.abs(km2)
    return F.when(size < 0.1, unit(number(m2), "m²")).when(size < 1, unit(number(km2, 2), "km²")).when(size < 10, unit(number(km2, 1), "km²")).otherwise(unit(number(km2), "km²"))


def or_dash(value: Column, text: Column) -> Column:
    return F.when(value.isNull() | F.isnan(value), DASH).otherwise(text)


def step_duration(ms: Column) -> Column:
    """Milliseconds below a second, seconds with one decimal below a minute, else minutes and seconds."""
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(ms < 60_000, F.format_string("%.1fs", ms / 1000.0)).otherwise(F.format_string("%dm %.1fs", F.floor(ms / 60_000).cast("bigint"), (ms % 60_000) / 1000.0))


def mebibytes(n: Column) -> Column:
    return F.format_string("%.2f MiB", n / (1024.0 * 1024.0))
