"""Mobility laws: daily places, truncated power laws and the visitation law."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine
from ..functions.scalar import finite
from .traj import located, modal, place


def law_visits(df: DataFrame, location: str | None = None, res: int = 10) -> DataFrame:
    """(uid, datetime, lat, lng, location_id, purpose) with the cell where no location is set."""
    own = F.col("purpose") if "purpose" in df.columns else F.lit(None).cast("string")
    return located(df).select("uid", "datetime", "lat", "lng", place(df, res, location).alias("location_id"), own.alias("purpose"))


def daily_locations(v: DataFrame) -> DataFrame:
    """(n_locations, n, p): how many user-days have so many distinct places."""
    per = v.groupBy("uid", F.to_date("datetime").alias("day")).agg(F.countDistinct("location_id").alias("n_locations"))
    n = per.groupBy("n_locations").agg(F.count("*").alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))


def log_normal(counts: DataFrame, value: str = "n_locations", weight: str = "n") -> DataFrame:
    """(mu, sigma) of the log of weighted values, population deviation; null without spread."""
    x, w = F.log(value), F.col(weight)
    mean = F.sum(w * x) / F.sum(w)
    var = F.greatest(F.sum(w * x * x) / F.sum(w) - F.pow(F.sum(w * x) / F.sum(w), 2), F.lit(0.0))
    return counts.agg(mean.alias("mu"), F.sqrt(var).alias("sigma"), F.sum(w).alias("n")).select("mu", F.when((F.col("sigma") > 1e-12) & (F.col("n") > 1), F.col("sigma")).alias("sigma"))


def log_bins(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """(bin, low, high, n, density) of positive values in log-spaced bins, the last one closed."""
    v = df.where(finite(value) & (F.col(value) > 0)).select(F.log10(value).alias("x"))
    span = v.agg(F.min("x").alias("a"), F.max("x").alias("b"), F.count("*").alias("all"))
    wide = F.greatest(F.col("b") - F.col("a"), F.lit(1e-12))
    at = F.least(F.floor((F.col("x") - F.col("a")) / wide * bins), F.lit(bins - 1))
    n = v.join(F.broadcast(span)).groupBy(at.alias("bin"), "a", "b", "all").agg(F.count("*").alias("n"))
    edge = lambda i: F.pow(F.lit(10.0), F.col("a") + i * wide / bins)
    out = n.withColumn("low", edge(F.col("bin"))).withColumn("high", edge(F.col("bin") + 1))
    return out.select("bin", "low", "high", "n", F.try_divide(F.col("n").cast("double"), F.col("all") * (F.col("high") - F.col("low"))).alias("density"))


def power_law(histogram: DataFrame) -> dict[str, float] | None:
    """c, r0, beta, kappa of (x + r0) ** -beta exp(-x / kappa) by a coarse then finer grid on
    the logs of at most some tens of bins."""
    rows = [(math.sqrt(r.low * r.high), r.density) for r in histogram.collect() if r.density and r.density > 0]
    if len(rows) < 4:
        return None
    x, y = (np.array(c) for c in zip(*rows, strict=True))
    logs = np.log(y)

    def fit(r0: np.ndarray, beta: np.ndarray, kappa: np.ndarray) -> tuple[float, float, float, float, float]:
        a, b, k = np.meshgrid(r0, beta, kappa, indexing="ij")
        model = -b[..., None] * np.log(x + a[..., None]) - x / k[..., None]
        c = (logs - model).mean(axis=-1)
        loss = ((logs - model - c[..., None]) ** 2).sum(axis=-1)
        i = np.unravel_index(loss.argmin(), loss.shape)
        return float(a[i]), float(b[i]), float(k[i]), float(c[i]), float(loss[i])

    r0, beta, kappa = np.geomspace(1e-2, 10, 12), np.linspace(0.2, 4, 20), np.geomspace(x.min(), 10 * x.max(), 20)
    for _ in range(4):
        a, b, k, c, _ = fit(r0, beta, kappa)
        r0, beta, kappa = np.geomspace(a / 1.6, a * 1.6, 9), np.linspace(max(0.05, b - 0.15), b + 0.15, 9), np.geomspace(k / 1.4, k * 1.4, 9)
    return {"c": math.exp(c), "r0": a, "beta": b, "kappa": k}


def visitation(v: DataFrame) -> DataFrame:
    """(uid, location_id, n_visits, f, r_km, rf): f is the number of days, r the distance from
    home, which is the modal HOME place or else the modal place."""
    per = v.groupBy("uid", "location_id").agg(F.count("*").alias("n_visits"), F.countDistinct(F.to_date("datetime")).alias("f"), F.avg("lat").alias("lat"), F.avg("lng").alias("lng"))
    own = modal(v.where(F.upper(F.trim("purpose")) == "HOME"), ["uid"], "location_id", "home")
    any_ = modal(v, ["uid"], "location_id", "most")
    home = any_.join(own, "uid", "left").select("uid", F.coalesce("home", "most").alias("location_id"))
    at = per.join(home, ["uid", "location_id"]).select("uid", F.col("lat").alias("h_lat"), F.col("lng").alias("h_lng"))
    out = per.join(at, "uid").withColumn("r_km", haversine("h_lat", "h_lng", "lat", "lng"))
    return out.select("uid", "location_id", "n_visits", "f", "r_km", (F.col("r_km") * F.col("f")).alias("rf"))


def visitation_density(d: DataFrame, width: float = 1.0) -> DataFrame:
    """(location_id, ring, f, users, rf, rho): distinct visitors per area of a distance ring."""
    rings = d.where("r_km > 0").withColumn("ring", F.floor(F.col("r_km") / width))
    n = rings.groupBy("location_id", "ring", "f").agg(F.countDistinct("uid").alias("users"))
    r = (F.col("ring") + 0.5) * width
    return n.withColumn("rf", r * F.col("f")).withColumn("rho", F.col("users") / (2 * math.pi * r * width))


def visitation_bins(d: DataFrame, bins: int = 30) -> DataFrame:
    """(bin, rf, rho): mean density in log bins of rf."""
    x = d.where("rf > 0 AND rho > 0").select(F.log10("rf").alias("x"), "rho")
    span = x.agg(F.min("x").alias("a"), F.max("x").alias("b"))
    wide = F.greatest(F.col("b") - F.col("a"), F.lit(1e-12))
    at = F.least(F.floor((F.col("x") - F.col("a")) / wide * bins), F.lit(bins - 1))
    return x.join(F.broadcast(span)).groupBy(at.alias("bin")).agg(F.pow(F.lit(10.0), F.avg("x")).alias("rf"), F.avg("rho").alias("rho"))


def visitation_fit(b: DataFrame) -> DataFrame:
    """(eta, mu, r2) of ln rho on ln rf by least squares."""
    x = b.where("rf > 0 AND rho > 0").select(F.log("rf").alias("x"), F.log("rho").alias("y"))
    return x.agg((-F.regr_slope("y", "x")).alias("eta"), F.exp(F.regr_intercept("y", "x")).alias("mu"), F.regr_r2("y", "x").alias("r2"))


def grid(spark, low: float, high: float, n: int = 200, log: bool = True) -> DataFrame:
    """(i, x): n points evenly spaced, in logs or not."""
    i = F.col("id") / float(max(1, n - 1))
    x = F.exp(math.log(low) + i * (math.log(high) - math.log(low))) if log else low + i * (high - low)
    return spark.range(n).select(F.col("id").alias("i"), x.alias("x"))


# Published parameters (r0, beta, kappa) of the truncated power laws, the
# log-normal (mu, sigma) of daily places and the exponent of the visitation law.
REFERENCE = {"jumps": (1.5, 1.75, 400.0), "gyration": (5.8, 1.65, 350.0), "daily": (1.0, 0.5), "visitation": -2.0}


def reference_curve(points: DataFrame, law: str) -> DataFrame:
    """``points`` with the unscaled reference ``y``."""
    x = F.col("x")
    if law in ("jumps", "gyration"):
        r0, beta, kappa = REFERENCE[law]
        y = F.pow(x + r0, F.lit(-beta)) * F.exp(-x / kappa)
    elif law == "daily":
        mu, sigma = REFERENCE[law]
        y = F.exp(-F.pow(F.log(x) - mu, 2) / (2 * sigma**2)) / (x * sigma * math.sqrt(2 * math.pi))
    else:
        y = F.pow(x, F.lit(REFERENCE[law]))
    return points.withColumn("y", y)


def scaled(curve: DataFrame, data: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y, reference): the reference at the data's points times exp(mean(ln y - ln ref))."""
    both = data.select(F.col(x).alias("x"), F.col(y).alias("y")).where("x > 0 AND y > 0").join(curve.select("x", F.col("y").alias("ref")), "x")
    factor = both.agg(F.exp(F.avg(F.log("y") - F.log("ref"))).alias("k"))
    return both.join(F.broadcast(factor)).select("x", "y", (F.col("ref") * F.col("k")).alias("reference"))
