"""Row filters by day type, hour, date, demography, viewport; several at once by explosion."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import c

# Half-open hours of the times of day, and ages with both ends.
TIMES = {"morning": (6, 12), "afternoon": (12, 18), "evening": (18, 24), "night": (0, 6)}
AGES = {"16-24": (16, 24), "25-34": (25, 34), "35-44": (35, 44), "45-59": (45, 59), "60-80": (60, 80)}


def weekday(ts) -> Column:
    """Monday to Friday; a null time is false."""
    return F.coalesce(F.weekday(c(ts)) < 5, F.lit(False))


def weekend(ts) -> Column:
    return F.coalesce(F.weekday(c(ts)) >= 5, F.lit(False))


def time_of_day(ts, name: str) -> Column:
    low, high = TIMES[name]
    return F.coalesce((F.hour(c(ts)) >= low) & (F.hour(c(ts)) < high), F.lit(False))


def date_range(ts, first: date, last: date) -> Column:
    """Days from first to last, both included."""
    return F.coalesce(F.to_date(c(ts)).between(F.lit(first), F.lit(last)), F.lit(False))


def predicates(ts, special: dict[str, tuple[date, date]] | None = None, times: bool = True) -> dict[str, Column]:
    """All filters of a time column by key."""
    out = {"all": F.lit(True), "weekday": weekday(ts), "weekend": weekend(ts)}
    out |= {k: date_range(ts, *v) for k, v in (special or {}).items()}
    return out | ({k: time_of_day(ts, k) for k in TIMES} if times else {})


def by_filter(df: DataFrame, ts: str = "datetime", special: dict[str, tuple[date, date]] | None = None, times: bool = True) -> DataFrame:
    """Each row once for every filter that it passes, with ``filter_key``: one scan and one
    aggregation serve all filters."""
    keys = F.array_compact(F.array(*[F.when(p, F.lit(k)) for k, p in predicates(ts, special, times).items()]))
    return df.withColumn("filter_key", F.explode(keys))


def demographic(gender: str | None = None, age: str | None = None, job: str | None = None) -> Column:
    out = F.lit(True)
    if gender:
        out = out & (F.lower(F.trim("gender")) == gender.lower())
    if age:
        out = out & F.col("age").between(*AGES[age])
    if job:
        out = out & (F.col("job") == job)
    return out


def overlaps(since, until, start: str = "t_start", end: str = "t_end") -> Column:
    return (F.col(start) <= F.lit(until)) & (F.col(end) >= F.lit(since))


def in_viewport(lat, lng, box: tuple[float, float, float, float]) -> Column:
    """Within (west, south, east, north), edges included."""
    return c(lng).between(box[0], box[2]) & c(lat).between(box[1], box[3])


def envelope_meets(box: tuple[float, float, float, float], names: tuple[str, ...] = ("o_lat", "o_lng", "d_lat", "d_lng")) -> Column:
    """The bounding box of origin and destination meets the viewport."""
    o_lat, o_lng, d_lat, d_lng = (F.col(n) for n in names)
    whole = o_lat.isNotNull() & o_lng.isNotNull() & d_lat.isNotNull() & d_lng.isNotNull()
    return whole & (F.least(o_lng, d_lng) <= box[2]) & (F.greatest(o_lng, d_lng) >= box[0]) & (F.least(o_lat, d_lat) <= box[3]) & (F.greatest(o_lat, d_lat) >= box[1])
