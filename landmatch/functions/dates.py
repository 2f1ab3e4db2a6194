"""Calendar rules. Instants are TIMESTAMP_NTZ in UTC, days are DATE; nothing depends on the session's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Europe/Berlin"


def local(ts: Column, zone: str = ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz"))


def local_day(ts: Column, zone: str = ZONE) -> Column:
    return F.to_date(local(ts, zone))


def window_key(ts: Column, not_before: int = 1, zone: str = ZONE) -> Column:
    """The local day, or the one before until the given hour."""
    here = local(ts, zone)
    return F.when(F.hour(here) >= not_before, F.to_date(here)).otherwise(F.date_sub(F.to_date(here), 1))


def timeline(center: Column, days: int = 10) -> Column:
    return F.sequence(F.date_sub(center, days), F.date_add(center, days))


def day_range(first: Column, last: Column, guard: int = 400) -> Column:
    """All days from first to last, cut after the guard's number; empty if they are the wrong way round."""
    return F.when(first <= last, F.sequence(first, F.least(last, F.date_add(first, guard - 1)))).otherwise(F.array().cast("array<date>"))


def schedule_slot(day: Column, hour: int = 4, zone: str = ZONE) -> Column:
    """UTC instant of the slot on Sundays, Wednesdays, Fridays and Saturdays, else null."""
    at = day.cast("timestamp_ntz") + F.expr(f"INTERVAL {hour} HOURS")
    return F.when(F.dayofweek(day).isin(1, 4, 6, 7), F.convert_timezone(F.lit(zone), F.lit("UTC"), at))


def iso_week(day: Column) -> Column:
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), day), F.weekofyear(day))


def strict_date(text: Column) -> Column:
    """DDMMYYYY, or DDMMYY with the century turning at 50; days that do not exist are null."""
    year = F.substring(text, 5, 2).try_cast("int")
    six = F.concat(F.substring(text, 1, 4), F.when(year >= 50, "19").otherwise("20"), F.substring(text, 5, 2))
    whole = F.when(text.rlike("^[0-9]{8}$"), text).when(text.rlike("^[0-9]{6}$"), six)
    return F.try_to_date(whole, "ddMMyyyy")


def snapshot_date(text: Column) -> Column:
    """YYYYMMDD if the year lies in 1900 to 2100, else DDMMYYYY."""
    t = F.trim(text)
    year = F.substring(t, 1, 4).try_cast("int")
    return F.when(~t.rlike("^[0-9]{8}$"), F.lit(None).cast("date")).when(year.between(1900, 2100), F.try_to_date(t, "yyyyMMdd")).otherwise(F.try_to_date(t, "ddMMyyyy"))


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once."""
    return F.transform(F.array(value), body)[0]


def utc_text(ts: Column) -> Column:
    """A UTC instant as YYYY-MM-DDThh:mm:ss.mmmZ, made of the zoneless value's text so that the session's zone plays no part."""
    fraction = lambda s: F.when(F.contains(s, F.lit(".")), F.substring_index(s, ".", -1)).otherwise("")
    whole = lambda s: F.replace(F.substring_index(s, ".", 1), F.lit(" "), F.lit("T"))
    return let(ts.cast("timestamp_ntz").cast("string"), lambda s: F.concat(whole(s), F.lit("."), F.rpad(fraction(s), 3, "0"), F.lit("Z")))


def iso_instant(text: Column) -> Column:
    """The instant, normalised to UTC with milliseconds; a date alone is its midnight; what names no zone is UTC; anything else is null."""
    form = r"^(\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)?)(?:Z|([+-])(\d{2}):?(\d{2}))?$"

    def instant(p: Column) -> Column:
        minutes = F.coalesce(p[2].try_cast("int") * 60 + p[3].try_cast("int"), F.lit(0)) * F.when(p[1] == "-", -1).otherwise(1)
        return p[0].try_cast("timestamp_ntz") - F.make_dt_interval(mins=minutes)

    parts = lambda x: F.when(x.rlike(form), F.split(F.regexp_replace(x, form, "$1|$2|$3|$4"), r"\|"))
    return utc_text(let(let(F.trim(text), parts), instant))


def refresh_decision(force: Column, exists: Column, cached_at: Column, now: Column, not_before: int = 1, zone: str = ZONE) -> Column:
    """Why a cached download is used or renewed."""
    cached = F.nullif(F.trim(cached_at), F.lit(""))
    at = cached.try_cast("timestamp_ntz")
    reason = (
        F.when(force, "force")
        .when(~exists, "cache_missing")
        .when(cached.isNull(), "cache_used_missing_cached_at")
        .when(at.isNull(), "cache_used_invalid_cached_at")
        .when(window_key(at, not_before, zone) == window_key(now, not_before, zone), "cache_used_current_window")
        .otherwise("cache_stale_previous_window")
    )
    return F.struct(reason.isin("force", "cache_missing", "cache_stale_previous_window").alias("should_download"), reason.alias("reason"))


def age(ts: Column, now: Column) -> Column:
    """The interval between two UTC instants. The difference of zoneless values knows no summer time."""
    return now.cast("timestamp_ntz") - ts.cast("timestamp_ntz")


def stale(ts: Column, now: Column, days: int) -> Column:
    """Older than the given days, by strict comparison."""
    return age(ts, now) > F.make_dt_interval(F.lit(days))


def age_bucket(ts: Column, now: Column) -> Column:
    """(unit, n): hours from 1 to 25, months from 12 to 13 full ones, years beyond; else the distance, in minutes below an hour or ahead of now, in days otherwise.

    On the last day of a month, months that began on a later day than it has are full too, at their time of day.
    """
    gap = age(ts, now)
    part = lambda unit: F.extract(F.lit(unit), gap)
    minutes = (part("DAY") * 24 + part("HOUR")) * 60 + part("MINUTE")
    hours = F.floor(minutes / 60)
    t, n = ts.cast("timestamp_ntz"), now.cast("timestamp_ntz")
    day = F.dayofmonth(n)
    begun = F.when(F.last_day(n) == F.to_date(n), F.least(F.dayofmonth(t), day)).otherwise(F.dayofmonth(t))
    clock = lambda d, c: F.struct(d, F.hour(c), F.minute(c), F.extract(F.lit("SECOND"), c))
    months = (F.year(n) - F.year(t)) * 12 + F.month(n) - F.month(t) - F.when(clock(day, n) < clock(begun, t), 1).otherwise(0)
    pick = lambda unit, v: F.struct(F.lit(unit).alias("unit"), v.cast("long").alias("n"))
    ahead = t > n
    return (
        F.when(ahead | (hours < 1), pick("minutes", F.abs(minutes)))
        .when(hours < 26, pick("hours", hours))
        .when(months > 13, pick("years", F.floor(months / 12)))
        .when(months >= 12, pick("months", months))
        .otherwise(pick("days", F.floor(hours / 24)))
    )


def extract_name(text: Column) -> Column:
    """The dated name of a country extract from its replication timestamp, in UTC."""
    return let(iso_instant(text), lambda at: F.concat(F.lit("germany-"), F.substring(at, 3, 2), F.substring(at, 6, 2), F.substring(at, 9, 2), F.lit(".osm.pbf")))


def named_date(name: Column, pattern: str) -> Column:
    """The date in the first group of a pattern: DDMMYYYY or DDMMYY, with years to 50 in this century; null if it is no day of the calendar."""
    raw = F.regexp_extract(name, pattern, 1)
    digits = F.when(raw.rlike(r"^(\d{8}|\d{6})$"), raw)
    century = F.when(F.length(digits) == 8, F.lit("")).when(F.substring(digits, 5, 2) <= "50", F.lit("20")).otherwise(F.lit("19"))
    return F.try_to_date(F.concat(century, F.substring(digits, 5, 4), F.lit("-"), F.substring(digits, 3, 2), F.lit("-"), F.substring(digits, 1, 2)), "yyyy-MM-dd")
