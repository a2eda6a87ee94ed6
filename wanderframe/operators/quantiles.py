"""Exact quantiles of groups of any size, by selection with refined histograms.

Each round cuts the ranges that still hold a wanted rank at their own approximate quantiles,
counts the parts exactly and keeps the rows of the parts that hold a wanted rank, a few
hundredths of them.  Once these are few, or all alike, a running count over them gives the
values.  What a task keeps is bounded by the number of parts, not by a group's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import finite
from ..sources.work import forget, stored

#: Parts that a range is cut into in a round, and rows that a part may have to be sorted.
PARTS, FEW = 256, 1 << 20
_STEP = 16


def matched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with the columns of the row of ``right`` that has its keys, null for null."""
    if not keys:
        return left.join(F.broadcast(right))  # one row
    named = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    return left.join(named, [left[k].eqNullSafe(named[f"__{k}"]) for k in keys]).drop(*[f"__{k}" for k in keys])


def in_parts(rows: DataFrame, by: list[str], value: str = "v", parts: int = PARTS) -> DataFrame:
    """``rows`` with ``part``: how many of the group's approximate quantiles lie below the
    value, so that parts hold like numbers of rows however far some values lie; equal values
    have one part.  ``parts`` is a multiple of 16."""
    probs = [i / parts for i in range(1, parts)]
    cuts = rows.groupBy(*by).agg(F.percentile_approx(value, probs, 40 * parts).alias("__cuts"))
    coarse = F.array(*[F.get("__cuts", F.lit(i)) for i in range(_STEP - 1, parts - 1, _STEP)]).cast("array<double>")
    return matched(rows, cuts.withColumn("__coarse", coarse), by).withColumn("part", _below(F.col("__cuts"), F.col("__coarse"), F.col(value))).drop("__cuts", "__coarse")


def _below(cuts: Column, coarse: Column, v: Column) -> Column:
    """How many of the sorted cuts are below a value, in two steps."""
    first = F.size(F.filter(coarse, lambda x: x < v)) * _STEP
    return F.transform(F.array(first), lambda k: k + F.size(F.filter(F.slice(cuts, k + 1, F.lit(_STEP)), lambda x: x < v)))[0]


def quantiles(df: DataFrame, value: str, probs: list[float], by: list[str] | None = None, few: int = FEW, parts: int = PARTS, weight: str | None = None) -> DataFrame:
    """(by..., n, q): the number of finite values of each group and an array of their
    quantiles, between the two ranks around each by straight lines.  With a ``weight`` a row
    counts as so many.

    Null groups are a group; groups without a finite value have no row, except that without
    ``by`` the one row has n = 0 and null quantiles."""
    by = by or []
    rows = stored(df.where(finite(value)).select(*by, F.col(value).cast("double").alias("v"), (F.lit(1) if weight is None else F.col(weight)).cast("long").alias("w"), F.lit(0).alias("seg"), F.lit(0).cast("long").alias("base")), "quantiles")
    sizes = stored(rows.groupBy(*by).agg(F.coalesce(F.sum("w"), F.lit(0)).alias("n")), "sizes")
    at = F.array(*[F.lit(float(p)) * (F.col("n") - 1) for p in probs])
    ranks = F.array_distinct(F.flatten(F.transform(at, lambda x: F.array(F.floor(x), F.ceil(x)))))
    wanted = sizes.where("n > 0").select(*by, F.explode(ranks).alias("rank"))
    found: list[DataFrame] = []
    level = 0
    tables = [rows]
    while True:
        size = rows.groupBy(*by, "seg").agg(F.count("*").alias("c"))
        if size.where(F.col("c") > few).isEmpty():
            break
        level += 1
        placed = in_parts(rows, [*by, "seg"], parts=parts)
        count = placed.groupBy(*by, "seg", "base", "part").agg(F.sum("w").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        w = Window.partitionBy(*by, "seg").orderBy("part")  # a row for each part
        count = stored(count.withColumn("start", F.col("base") + F.sum("c").over(w) - F.col("c")), "parts")
        hit = stored(_at_ranks(count, wanted, by), "hits")
        found.append(hit.where("low = high").select(*by, "rank", F.col("low").alias("v")))
        order = F.row_number().over(Window.partitionBy(*by).orderBy("start"))
        still = hit.where("low < high").select(*by, "seg", "part", "start").distinct().withColumn("next", order)
        kept = matched(placed, still, [*by, "seg", "part"]).select(*by, "v", "w", F.col("next").alias("seg"), F.col("start").alias("base"))
        rows = stored(kept, "quantiles")
        tables += [count, hit, rows]
    w = Window.partitionBy(*by, "seg").orderBy("v")
    values = rows.groupBy(*by, "seg", "base", "v").agg(F.sum("w").alias("c")).withColumn("start", F.col("base") + F.sum("c").over(w) - F.col("c"))
    found.append(_at_ranks(values, wanted, by).select(*by, "rank", "v"))
    known = found[0]
    for f in found[1:]:
        known = known.unionByName(f)
    lists = known.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("m"))  # two ranks a quantile at most
    joined = matched(sizes, lists, by) if by else sizes.join(F.broadcast(lists))
    value_at = lambda x: F.try_element_at("m", F.floor(x)) + (x - F.floor(x)) * (F.try_element_at("m", F.ceil(x)) - F.try_element_at("m", F.floor(x)))
    out = stored(joined.select(*by, "n", F.transform(at, value_at).alias("q")), "quantile-values")
    forget(*tables, sizes)
    return out


def _at_ranks(parts: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """The parts, from ``start`` on with ``c`` rows, that hold a wanted rank, once for each."""
    if not by:
        ranks = wanted.agg(F.collect_list("rank").alias("ranks"))  # one row
    else:
        ranks = wanted.groupBy(*by).agg(F.collect_list("rank").alias("ranks"))
    inside = F.filter("ranks", lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("c")))
    return matched(parts, ranks, by).withColumn("rank", F.explode(inside)).drop("ranks")
