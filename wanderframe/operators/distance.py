"""Distances between distributions, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import finite
from .quantiles import in_parts, matched, quantiles

QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)


def wasserstein(a: DataFrame, b: DataFrame, value: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """W1 of two samples, per group of ``by``: the area between their distribution functions.
    With a ``weight`` a row counts as so many.

    Values are counted first and the functions are integer running counts over the distinct
    values, so the sum does not drift.  A group that one side lacks has no distance (null)."""
    by = by or []
    number = F.count("*") if weight is None else F.sum(weight)
    tag = lambda df, x, y: df.where(finite(value)).groupBy(*by, F.col(value).cast("double").alias("v")).agg(number.alias("n")).select(*by, "v", (F.col("n") * x).alias("na"), (F.col("n") * y).alias("nb"))
    both = tag(a, 1, 0).unionByName(tag(b, 0, 1)).groupBy(*by, "v").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    return _distances(both, by)


def _distances(both: DataFrame, by: list[str]) -> DataFrame:
    """W1 per group without a window over all of a group: values are put into parts of like
    numbers of values, each with its own running counts; the parts' totals are summed up
    before.  However far a few values lie, no part holds more than a small share."""
    totals = both.groupBy(*by).agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    placed = matched(in_parts(both, by), totals, by)
    order = Window.partitionBy(*by).orderBy("part")  # a row for each part
    sums = placed.groupBy(*by, "part").agg(F.sum("na").alias("sa"), F.sum("nb").alias("sb"), F.min("v").alias("first"))
    sums = sums.select(*by, "part", (F.sum("sa").over(order) - F.col("sa")).alias("ba"), (F.sum("sb").over(order) - F.col("sb")).alias("bb"), F.lead("first").over(order).alias("next"))
    w = Window.partitionBy(*by, "part").orderBy("v")
    run = matched(placed, sums, [*by, "part"])
    width = F.coalesce(F.lead("v").over(w), F.col("next")) - F.col("v")
    gap = F.abs((F.col("ba") + F.sum("na").over(w)) / F.nullif("ta", F.lit(0)) - (F.col("bb") + F.sum("nb").over(w)) / F.nullif("tb", F.lit(0)))
    return run.select(*by, (gap * F.coalesce(width, F.lit(0.0))).alias("x")).groupBy(*by).agg(F.sum("x").alias("w1"))


def jensen_shannon(a: DataFrame, b: DataFrame, keys: list[str], weight: str, by: list[str] | None = None) -> DataFrame:
    """Jensen-Shannon divergence (natural log) of two weighted category tables, per group.

    Weights that are not finite count as zero; both sides empty is zero."""
    by = by or []
    clean = F.when(finite(weight), F.col(weight).cast("double")).otherwise(0.0)
    one = lambda df, n: df.groupBy(*by, *keys).agg(F.sum(clean).alias(n))
    both = one(a, "p").withColumn("q", F.lit(0.0)).unionByName(one(b, "q").withColumn("p", F.lit(0.0)))
    both = both.groupBy(*by, *keys).agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    totals = both.groupBy(*by).agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))
    joined = both.join(totals, by) if by else both.join(F.broadcast(totals))
    norm = joined.select(*by, F.coalesce(F.try_divide("p", "tp"), F.lit(0.0)).alias("p"), F.coalesce(F.try_divide("q", "tq"), F.lit(0.0)).alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    kl = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / F.col("m"))).otherwise(0.0)
    return norm.groupBy(*by).agg(F.greatest(F.sum(kl("p") + kl("q")) / 2, F.lit(0.0)).alias("jsd")) if by else norm.agg(F.greatest(F.coalesce(F.sum(kl("p") + kl("q")) / 2, F.lit(0.0)), F.lit(0.0)).alias("jsd"))


def shares(df: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """Counts of a key and their share of the group's total."""
    by = by or []
    return df.groupBy(*by, key).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def summary(df: DataFrame, value: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """count, mean, median, population deviation, p10 and p90 of the finite values; the
    quantiles are exact in groups of any size.  With a ``weight`` a row counts as so many."""
    by = by or []
    known = df.where(finite(value))
    if weight is None:
        stats = known.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    else:
        mean = known.groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"))
        off = F.col(value) - F.col("mean")
        stats = matched(known, mean, by).groupBy(*by, "mean").agg(F.sqrt(F.sum(off * off * F.col(weight)) / F.sum(weight)).alias("std"))
    joined = matched(stats, quantiles(df, value, [0.5, 0.1, 0.9], by, weight=weight), by)
    at = lambda i: F.get("q", F.lit(i))
    return joined.select(*by, "n", "mean", at(0).alias("median"), "std", at(1).alias("p10"), at(2).alias("p90"))


def box(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Minimum, quartiles and maximum, exact in groups of any size."""
    names = ("least", "q1", "median", "q3", "most")
    got = quantiles(df, value, [0.0, 0.25, 0.5, 0.75, 1.0], by)
    return got.select(*(by or []), *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(names)])


def ecdf(df: DataFrame, value: str, cutoff: float = 0.98, points: int = 400) -> DataFrame:
    """(x, p): the empirical distribution at distinct values up to the cutoff, thinned to
    evenly spaced points.  If no value lies on the cutoff one point at it closes the curve.

    The running counts go part by part of like numbers of values, so that no window holds
    more than a small share of them."""
    counts = df.where(finite(value)).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    placed = in_parts(counts, []).join(F.broadcast(counts.agg(F.sum("n").alias("total"))))
    before = placed.groupBy("part").agg(F.sum("n").alias("s"), F.count("*").alias("k"))
    o = Window.orderBy("part")  # a row for each range
    before = before.select("part", (F.sum("s").over(o) - F.col("s")).alias("before"), (F.sum("k").over(o) - F.col("k")).alias("rank0"))
    w = Window.partitionBy("part").orderBy("v")
    curve = placed.join(F.broadcast(before), "part").select(F.col("v").alias("x"), ((F.col("before") + F.sum("n").over(w)) / F.col("total")).alias("p"), (F.col("rank0") + F.row_number().over(w) - 1).alias("i"))
    held = curve.where(F.col("p") <= cutoff)
    over = curve.where(F.col("p") > cutoff).agg(F.min(F.struct("x", "i")).alias("f"), F.max(F.lit(1)).alias("some")).where("some = 1")
    top = held.agg(F.max("p").alias("top"))
    closing = over.join(F.broadcast(top)).where(F.col("top").isNull() | (F.col("top") < cutoff)).select(F.col("f.x").alias("x"), F.lit(cutoff).alias("p"), F.col("f.i").alias("i"))
    full = held.unionByName(closing)
    n = full.agg(F.count("*").alias("m"))
    # Row i is kept if it is the rounded place of one of the points.
    spaced = full.join(F.broadcast(n)).where((F.col("m") <= points) | (F.col("i") == F.round(F.round(F.col("i") * (points - 1) / F.greatest(F.col("m") - 1, F.lit(1))) * (F.col("m") - 1) / (points - 1))))
    return spaced.select("x", "p")


def ecdf_at(curve: DataFrame, x: float) -> DataFrame:
    """The step function's value at x: that of the last point not beyond it, or zero."""
    return curve.where(F.col("x") <= x).agg(F.coalesce(F.max_by("p", "x"), F.lit(0.0)).alias("p"))


def metric_rows(values: DataFrame, name: str, value: str, unit: str | None = None) -> DataFrame:
    """Rows (filter_key, metric_name, value, unit) of the finite values."""
    key = F.col("filter_key") if "filter_key" in values.columns else F.lit("all")
    return values.where(finite(value)).select(key.alias("filter_key"), F.lit(name).alias("metric_name"), F.col(value).cast("double").alias("value"), F.lit(unit).cast("string").alias("unit"))


def directions(n: int, dimensions: int, seed: int = 42) -> list[list[float]]:
    """Seeded random unit vectors."""
    import numpy as np

    d = np.random.default_rng(seed).normal(size=(n, dimensions))
    return (d / np.linalg.norm(d, axis=1, keepdims=True)).tolist()


def sliced_wasserstein(a: DataFrame, b: DataFrame, coords: list[str], slices: int = 16, seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """Mean W1 over seeded random directions in the space of ``coords``, per group of ``by``."""
    by = by or []
    d = directions(slices, len(coords), seed)
    spun = lambda df: df.select(*by, F.posexplode(F.array(*[sum((F.col(c) * float(x) for c, x in zip(coords, row, strict=True)), F.lit(0.0)) for row in d])).alias("slice", "v"))
    return wasserstein(spun(a), spun(b), "v", [*by, "slice"]).groupBy(*by).agg(F.avg("w1").alias("sliced_w1"))
