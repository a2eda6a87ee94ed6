"""Deterministic samples, allocations and thinning."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import c
from ..functions.scalar import uniform


def hashed_rows(df: DataFrame, key: str, n: int, seed: str = "") -> DataFrame:
    """n rows in the order of the md5 of seed and key: the same in any engine."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def gumbel(weight, seed: int, *cols):
    """A draw whose order takes rows without replacement with chances by weight."""
    return F.log(weight) - F.log(-F.log(uniform(seed, *cols)))


def weighted(df: DataFrame, by: list[str], key: str, weight: str, n: int, seed: int = 42) -> DataFrame:
    """n rows per group without replacement with chances by weight (Gumbel top-n)."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(gumbel(F.col(weight), seed, *by, key)), key))
    return df.where(F.col(weight) > 0).withColumn("draw", rank).where(F.col("draw") <= n)


def scaled(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """``df`` with ``scaled``: value from 0 to 1; not finite is zero, and so is a constant."""
    by = by or []
    x = F.when(c(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value)).otherwise(0.0)
    clean = df.withColumn("__x", x)
    span = clean.groupBy(*by).agg(F.min("__x").alias("__a"), F.max("__x").alias("__b"))
    joined = clean.join(F.broadcast(span), by) if by else clean.join(F.broadcast(span))
    return joined.withColumn("scaled", F.when(F.col("__b") > F.col("__a"), (F.col("__x") - F.col("__a")) / (F.col("__b") - F.col("__a"))).otherwise(0.0)).drop("__x", "__a", "__b")


def spaced(arr, n: int):
    """At most n evenly spaced elements of an array, the ends included."""
    a = c(arr)
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.round(i * (F.size(a) - 1) / (n - 1)).cast("int"))
    return F.when(F.size(a) <= n, a).otherwise(F.transform(at, lambda i: F.get(a, i)))


def log_normal_pmf(mu: float, sigma: float, most: int) -> list[float]:
    """Chances of 1 to ``most`` by the log-normal's mass within half a unit, normalised."""
    cdf = lambda x: 0.5 * (1 + math.erf((math.log(x) - mu) / (sigma * math.sqrt(2)))) if x > 0 else 0.0
    p = [cdf(k + 0.5) - cdf(k - 0.5) for k in range(1, most + 1)]
    total = sum(p)
    return [x / total for x in p] if total else [1 / most] * most


def allocated(shares: list[float], total: int, cap: int | None = None) -> list[int]:
    """Whole numbers near shares of a total by largest remainders, none over the cap."""
    cap = total if cap is None else cap
    if cap * len(shares) < total:
        raise ValueError("the cap leaves no room for the total")
    whole = sum(shares) or 1.0
    want = [total * s / whole for s in shares]
    got = [min(int(x), cap) for x in want]
    order = sorted(range(len(shares)), key=lambda i: (int(want[i]) - want[i], i))
    while sum(got) < total:
        for i in order:
            if sum(got) < total and got[i] < cap:
                got[i] += 1
    return got


def stratified_pairs(df: DataFrame, n: int, strata: str = "day_type", key: str = "diary_id", variation: str = "variation", seed: int = 42) -> DataFrame:
    """(draw, stratum, key): strata in turn; of every four draws of a stratum the first takes
    the least variation left, the second the most, and two follow a seeded order."""
    w = Window.partitionBy(strata)
    r = df.withColumns({"lo": F.row_number().over(w.orderBy(variation, key)) - 1, "hi": F.row_number().over(w.orderBy(F.desc(variation), key)) - 1, "rnd": F.row_number().over(w.orderBy(uniform(seed, key))) - 1, "m": F.count("*").over(w)})
    per = -(-n // 4)
    first = lambda o: F.collect_list(F.when(F.col(o) < 4 * per, F.struct(o, key)))  # noqa: E731  as many as draws, not the stratum
    lists = r.groupBy(strata).agg(*[F.transform(F.sort_array(first(o)), lambda x: x[key]).alias(o) for o in ("lo", "hi", "rnd")])
    order = F.row_number().over(Window.orderBy(strata)) - 1
    s = lists.withColumn("turn", order).withColumn("k", F.count("*").over(Window.partitionBy()))
    draws = s.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).where(F.col("draw") % F.col("k") == F.col("turn")).withColumn("i", F.expr("cast(draw div k as int)"))
    q = F.expr("cast(i div 4 as int)")
    item = lambda a, i: F.get(a, i % F.size(a))
    pick = F.when(F.col("i") % 4 == 0, item(F.col("lo"), q)).when(F.col("i") % 4 == 1, item(F.col("hi"), q)).otherwise(item(F.col("rnd"), 2 * q + F.col("i") % 4 - 2))
    return draws.select("draw", strata, pick.alias(key))
