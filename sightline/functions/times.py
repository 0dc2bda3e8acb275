"""Clip names, day labels and times of day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_SECONDS = 86400.0


def time_seconds(text: Column) -> Column:
    """Seconds of ``hhmmss[cc]``; shorter or non-numeric texts give 0."""
    take = lambda a: F.substring(text, a, 2).try_cast("int")
    whole = take(1) * 3600 + take(3) * 60 + take(5)
    hundredths = F.when(F.length(text) >= 8, take(7)).otherwise(F.lit(0))
    return F.when(F.length(text) >= 6, F.coalesce(whole + hundredths / F.lit(100.0), F.lit(0.0))).otherwise(F.lit(0.0))


def day_label(name: Column) -> Column:
    """``DAYn`` of a name in upper case, else null."""
    return F.nullif(F.upper(F.regexp_extract(name, r"(?i)day\d+", 0)), F.lit(""))


def day_number(name: Column) -> Column:
    return F.regexp_extract(name, r"(?i)day(\d+)", 1).try_cast("int")


def clip_start(name: Column) -> Column:
    """Start in seconds from a name that ends in ``_hhmmsscc``, else null."""
    digits = F.regexp_extract(name, r"_(\d{8})$", 1)
    return F.when(digits != "", time_seconds(digits))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"[^/]+$", 0), r"\.[^.]*$", "")


def clip_parts(name: Column) -> Column:
    """day, person, name and time of ``DAYx_An_NAME_hhmmsscc``; the name may contain underscores."""
    parts = F.split(name, "_")
    n = F.size(parts)
    full = n >= 4
    return F.struct(
        F.when(full, F.get(parts, F.lit(0))).alias("day"),
        F.when(full, F.get(parts, F.lit(1))).alias("person"),
        F.when(full, F.array_join(F.slice(parts, F.lit(3), F.greatest(n - 3, F.lit(0))), "_")).alias("who"),
        F.when(full, F.get(parts, n - 1)).alias("time"),
    )


def shifted_day(day: Column, by: int) -> Column:
    """[DAYn+by] for n+by within 1 to 7, else an empty array."""
    n = day_number(day) + by
    return F.when(n.between(1, 7), F.array(F.concat(F.lit("DAY"), n.cast("string")))).otherwise(F.array().cast("array<string>"))


def scaled_ranges(ranges: Column) -> Column:
    """Ranges [(s, e)] in seconds: values under 24 are hours, under 1440 minutes; clipped to a day, empty ones dropped."""

    def scale(r: Column) -> Column:
        top = F.greatest(F.abs(r["s"]), F.abs(r["e"]))
        unit = F.when(top < 24, 3600.0).when(top < 1440, 60.0).otherwise(1.0)
        return F.struct(F.greatest(F.lit(0.0), r["s"] * unit).alias("s"), F.least(F.lit(DAY_SECONDS), r["e"] * unit).alias("e"))

    return F.filter(F.transform(F.filter(ranges, lambda r: r["e"] > r["s"]), scale), lambda r: r["e"] > r["s"])


def overlaps(start: Column, end: Column, ranges: Column) -> Column:
    """Whether [start, end] meets any of the closed ranges."""
    return F.exists(ranges, lambda r: (end >= r["s"]) & (start <= r["e"]))


def interval_iou(s1: Column, e1: Column, s2: Column, e2: Column, by_truth: bool = False) -> Column:
    """Intersection over union of two intervals (or over the second's length); 0 if either is empty."""
    shared = F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))
    whole = (e2 - s2) if by_truth else (e1 - s1) + (e2 - s2) - shared
    return F.when((e1 > s1) & (e2 > s2), F.coalesce(F.try_divide(shared, whole), F.lit(0.0))).otherwise(F.lit(0.0))
