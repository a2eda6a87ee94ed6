"""Generated populations, diary choice and movement; draws depend on seeds and ids alone."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import deterrence, haversine
from ..functions.scalar import content_key, normal, uniform
from .sampling import weighted

# Shares of the default population.
EDUCATION = {"primary": 0.2, "secondary": 0.45, "tertiary": 0.35}
HOUSEHOLD = {"single": 0.3, "couple": 0.3, "family": 0.4}
JOBS = {"employee": 0.5, "student": 0.2, "retired": 0.15, "self-employed": 0.1, "unemployed": 0.05}


def drawn(shares: dict[str, float], u: Column) -> Column:
    """The category in whose part of 0 to 1 the draw falls."""
    out, edge, names = None, 0.0, list(shares)
    total = sum(shares.values())
    for name in names[:-1]:
        edge += shares[name] / total
        out = F.when(u < edge, name) if out is None else out.when(u < edge, name)
    return out.otherwise(names[-1]) if out is not None else F.lit(names[0])


def population(spark: SparkSession, n: int, seed: int = 42, car: float = 0.55, bike: float = 0.4) -> DataFrame:
    """Profiles of n agents: every attribute is a draw of its own seed."""
    u = lambda k: uniform(seed + k, "uid")
    ages = 16 + F.floor(64 * F.pow(u(2), F.lit(0.9)) * (1 - 0.25 * u(3)))
    return spark.range(n).select((F.col("id") + 1).alias("uid")).select(
        "uid", F.when(u(1) < 0.5, "female").otherwise("male").alias("gender"), ages.cast("long").alias("age"), drawn(EDUCATION, u(4)).alias("education"), (1 + F.floor(u(5) * 5)).cast("long").alias("health"),
        drawn(HOUSEHOLD, u(6)).alias("household"), drawn(JOBS, u(7)).alias("job"), (u(8) < car).alias("has_car"), (u(9) < bike).alias("has_bike"),
    )


def owned(profiles: DataFrame, scores: DataFrame, seed: int = 43) -> DataFrame:
    """Vehicles by a Bernoulli draw of each agent's score; agents without a score keep theirs."""
    j = profiles.join(scores.select("uid", "car_score", "bike_score"), "uid", "left")
    own = lambda k, name: F.when(F.col(f"{name}_score").isNotNull(), uniform(seed + k, "uid") < F.col(f"{name}_score")).otherwise(F.col(f"has_{name}"))
    return j.withColumn("has_car", own(0, "car")).withColumn("has_bike", own(1, "bike")).drop("car_score", "bike_score")


def repaired(profiles: DataFrame, scores: DataFrame, threshold: float = 0.2, seed: int = 44) -> DataFrame:
    """Agents whose coherence is low, or fails a Bernoulli draw of it, get new attributes."""
    j = profiles.join(scores.select("uid", "coherence"), "uid", "left")
    again = (F.col("coherence") < threshold) | (uniform(seed, "uid") < 1 - F.col("coherence"))
    u = lambda k: uniform(seed + k, "uid")
    for k, (name, shares) in enumerate((("education", EDUCATION), ("household", HOUSEHOLD), ("job", JOBS)), 1):
        j = j.withColumn(name, F.when(F.coalesce(again, F.lit(False)), drawn(shares, u(k))).otherwise(F.col(name)))
    return j.drop("coherence")


def within(points: DataFrame, places: DataFrame, km: float) -> DataFrame:
    """(uid, place, relevance, d): the places within the distance of each agent's point.

    Points and places meet in squares of a grid as wide as the distance."""
    step = km / 111.0
    at = lambda lat, lng: (F.floor(F.col(lat) / step), F.floor(F.col(lng) / (2 * step)))
    hy, hx = at("lat", "lng")
    around = F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    h = points.withColumn("s", F.explode(around)).select("uid", "lat", "lng", (hy + F.col("s.dy")).alias("gy"), (hx + F.col("s.dx")).alias("gx"))
    py, px = at("lat", "lng")
    p = places.select(F.col("place"), F.col("lat").alias("plat"), F.col("lng").alias("plng"), "relevance", py.alias("gy"), px.alias("gx"))
    near = h.join(p, ["gy", "gx"]).withColumn("d", haversine("lat", "lng", "plat", "plng")).where(F.col("d") <= km)
    return near.select("uid", "place", "relevance", "d")


def workplaces(homes: DataFrame, places: DataFrame, km: float = 30.0, rate: float = -2.0, seed: int = 45) -> DataFrame:
    """(uid, work): a place by gravity among those within the distance of home."""
    near = within(homes, places, km)
    w = near.withColumn("w", deterrence("d", F.lit(1.0), "relevance", rate))
    return weighted(w, ["uid"], "place", "w", 1, seed).select("uid", F.col("place").alias("work"))


def drawn_number(seed: int, *values) -> float:
    """What :func:`uniform` gives for these values, outside of Spark."""
    return (int(hashlib.md5("|".join(map(str, (seed, *values))).encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)


def fallen(weights: np.ndarray, u: float) -> int:
    """The place at which a share of the whole falls into the running sum of the weights."""
    run = np.cumsum(weights)
    return min(int(np.searchsorted(run, u * run[-1], "right")), int(np.flatnonzero(weights)[-1]))


def choose_diaries(bank: DataFrame, days: int, seed: int = 42) -> DataFrame:
    """(agent, day, day_type, diary_id): a day's diary is one used before, by its count, or a
    new one, by alpha, each times exp(similarity / T): a restaurant process in days.

    A day's draw falls into the weights' running sum in order of the diaries.  The days of an
    agent depend on each other; agents are groups of their own."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        agent = int(pdf["agent"].iloc[0])
        used = dict.fromkeys(pdf["diary_id"], 0)
        rows = []
        for day in range(days):
            kind = "we" if day % 7 >= 5 else "wd"
            pool = pdf[pdf["day_type"] == kind].sort_values("diary_id")
            if pool.empty:
                continue
            s = pool["sim"].to_numpy()
            n = np.array([used[d] for d in pool["diary_id"]], float)
            fresh = max(1, int((n == 0).sum()))
            w = np.where(n > 0, n, pool["alpha_a"].to_numpy() / fresh) * np.exp((s - s.max()) / pool["T_a"].to_numpy())
            pick = pool["diary_id"].iloc[fallen(w, drawn_number(seed, agent, day))]
            used[pick] += 1
            rows.append((agent, day, kind, pick))
        return pd.DataFrame(rows, columns=["agent", "day", "day_type", "diary_id"])

    return bank.groupBy("agent").applyInPandas(run, "agent long, day long, day_type string, diary_id string")


def explore_and_return(spark: SparkSession, places: DataFrame, agents: int, steps: int, rho: float = 0.6, gamma: float = 0.21, power: float = -2.0, limit: int = 200_000, seed: int = 42) -> DataFrame:
    """(uid, step, place, lat, lng): exploration and preferential return on a gravity field.

    With chance rho S ** -gamma an agent of S known places explores, by relevance and
    distance from where it is; else it returns by how often it has been there.  A draw falls
    into the weights' running sum in order of the places.  The places are a bounded table (``limit``) that every task holds; agents are independent."""
    table = places.select("loc", "lat", "lng", "relevance").orderBy("loc").limit(limit + 1).toPandas()
    if len(table) > limit:
        raise ValueError(f"more than {limit} places: coarsen the tessellation first")
    lat, lng, mass, ids = (table[c].to_numpy() for c in ("lat", "lng", "relevance", "loc"))
    shared = spark.sparkContext.broadcast((lat, lng, mass, ids))

    def run(batches):
        lat, lng, mass, ids = shared.value
        for pdf in batches:
            rows = []
            for uid in pdf["uid"]:
                here = fallen(mass, drawn_number(seed, uid, -1))
                count = {here: 1}
                for step in range(steps):
                    rows.append((int(uid), step, int(ids[here]), lat[here], lng[here]))
                    u = drawn_number(seed, uid, step, 1)
                    if drawn_number(seed, uid, step, 0) < rho * len(count) ** -gamma and len(count) < len(ids):
                        p, q = np.radians(lat), np.radians(lat[here])
                        a = np.sin((p - q) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(lng - lng[here]) / 2) ** 2
                        d = np.maximum(2 * 6371.0088 * np.arcsin(np.sqrt(a)), 0.001)
                        w = mass * d**power
                        w[list(count)] = 0
                        here = fallen(w, u)
                    else:
                        known = sorted(count)
                        w = np.array([count[k] for k in known], float)
                        here = known[fallen(w, u)]
                    count[here] = count.get(here, 0) + 1
            yield pd.DataFrame(rows, columns=["uid", "step", "place", "lat", "lng"])

    return spark.range(1, agents + 1).select(F.col("id").alias("uid")).mapInPandas(run, "uid long, step long, place long, lat double, lng double")


def choose_modes(legs: DataFrame, profiles: DataFrame, walk_km: float = 1.0, bike_km: float = 4.0, spread: float = 0.4, seed: int = 46) -> DataFrame:
    """``legs`` with a mode: walk up to the agent's own threshold, else a car if it has one,
    else a bike up to another threshold, else rail."""
    mine = lambda base, k: base * F.exp(spread * normal(seed + k, "uid"))
    p = profiles.select("uid", *[c for c in ("has_car", "has_bike") if c in profiles.columns])
    for k, c in enumerate(("has_car", "has_bike")):
        if c not in p.columns:
            p = p.withColumn(c, uniform(seed + 10 + k, "uid") < 0.5)
    j = legs.join(p, "uid", "left")
    mode = F.when(F.col("km") <= mine(walk_km, 1), "walk").when(F.col("has_car"), "car").when(F.col("has_bike") & (F.col("km") <= mine(bike_km, 2)), "bike").otherwise("rail")
    return j.withColumn("mode", mode).drop("has_car", "has_bike")


def stop_times(moves: DataFrame, uid: str, order: list[str], at: str, duration: str, buffer: int = 0) -> DataFrame:
    """``moves`` with departure and arrival in seconds: a move leaves as late as its moment
    ``at`` allows, its duration and the buffer before, but not before the arrival of the last.

    arrival = max(ready, last arrival) + duration is a running maximum over what is ready less
    the durations before it, plus the running sum of durations: two windows, no loop."""
    w = Window.partitionBy(uid).orderBy(*order)
    total = F.sum(duration).over(w)
    ready = F.col(at) - F.col(duration) - buffer
    run = moves.withColumn("__total", total).withColumn("__lead", ready - (F.col("__total") - F.col(duration)))
    arrival = F.col("__total") + F.max("__lead").over(w)
    return run.withColumn("arrival", arrival).withColumn("departure", F.col("arrival") - F.col(duration)).drop("__total", "__lead")


def calibrated(answers: DataFrame, defaults: DataFrame) -> DataFrame:
    """(field, label, weight, calibrated): a field's weights from ``answers`` (field, label,
    weight), normalised, if they are of use: a weight for each of the field's labels, none
    negative and not all zero; else the defaults, normalised."""
    a = answers.groupBy("field", "label").agg(F.sum(F.col("weight").cast("double")).alias("answer"))
    both = defaults.select("field", "label", F.col("weight").cast("double").alias("weight")).join(a, ["field", "label"], "left")
    of = Window.partitionBy("field")
    good = F.min(F.coalesce(F.col("answer") >= 0, F.lit(False))).over(of) & (F.sum("answer").over(of) > 0)
    used = both.withColumn("calibrated", F.coalesce(good, F.lit(False))).withColumn("w", F.when(F.col("calibrated"), F.col("answer")).otherwise(F.col("weight")))
    return used.select("field", "label", (F.col("w") / F.sum("w").over(of)).alias("weight"), "calibrated")


def aligned(pairs: DataFrame, cached: DataFrame, model: str, texts: list[str], default: float = 0.5) -> DataFrame:
    """``pairs`` with ``score`` from 0 to 1 and ``missing``: scores of a model for texts, looked
    up by the content key of model and texts; where the cache (cache_key, score) has none the
    default stands in, and the rows that miss are what is left to score."""
    key = content_key(F.lit(model), *texts)
    scores = cached.groupBy("cache_key").agg(F.max("score").alias("score"))
    out = pairs.withColumn("cache_key", key).join(scores, "cache_key", "left").withColumn("missing", F.col("score").isNull())
    # greatest and least pass over nulls: a score that is missing must not become a bound.
    return out.withColumn("score", F.when(F.col("missing"), default).otherwise(F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0)))).drop("cache_key")


def waypoint_times(legs: DataFrame) -> DataFrame:
    """(uid, stop_id, seq, t): the times of a leg's points, in proportion to their weights.

    ``legs`` has departure and arrival (timestamps) and weights, one per step."""
    total = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
    steps = F.transform(F.sequence(F.lit(0), F.size("weights")), lambda i: F.aggregate(F.slice("weights", F.lit(1), i), F.lit(0.0), lambda a, x: a + x))
    span = F.unix_seconds(F.col("arrival").cast("timestamp")) - F.unix_seconds(F.col("departure").cast("timestamp"))
    out = legs.withColumn("total", total).select("uid", "stop_id", "departure", "total", span.alias("span"), F.posexplode(steps).alias("seq", "w"))
    part = F.round(F.col("span") * F.try_divide("w", F.nullif("total", F.lit(0.0))))
    return out.select("uid", "stop_id", "seq", (F.col("departure") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), part.cast("decimal(18,6)"))).alias("t"))


def ablation_summary(metrics: DataFrame, value: str, by: tuple[str, ...] = ("dataset", "variant")) -> DataFrame:
    """Mean, sample deviation and number of a metric per data set and variant."""
    return metrics.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count("*").alias("n"))


# Activities with the mean and deviation of the log of their hours and the
# purposes that allow them (0 home, 1 work, 2 other).
ACTIVITIES = (
    ("sleep", 2.08, 0.30, (0,)),
    ("eatdrink", -0.35, 0.45, (0, 1, 2)),
    ("selfcare", -0.69, 0.50, (0, 2)),
    ("paidwork", 2.08, 0.30, (1,)),
    ("educatn", 1.10, 0.50, (2,)),
    ("foodprep", 0.00, 0.60, (0,)),
    ("cleanetc", 0.00, 0.60, (0,)),
    ("maintain", 0.00, 0.60, (0,)),
    ("shopserv", -0.29, 0.50, (2,)),
    ("garden", 0.41, 0.60, (0,)),
    ("petcare", -0.69, 0.50, (0,)),
    ("eldcare", 0.41, 0.70, (0, 2)),
    ("pkidcare", 0.41, 0.70, (0, 2)),
    ("ikidcare", 0.41, 0.70, (0, 2)),
    ("religion", 0.69, 0.60, (2,)),
    ("volorgwk", 0.69, 0.60, (2,)),
    ("commute", -0.29, 0.50, (1, 2)),
    ("travel", -0.29, 0.50, (2,)),
    ("sportex", 0.41, 0.40, (2,)),
    ("tvradio", 0.92, 0.60, (0, 2)),
    ("read", 0.41, 0.50, (0, 2)),
    ("compint", 0.41, 0.50, (0, 2)),
    ("goout", 0.92, 0.50, (2,)),
    ("leisure", 0.92, 0.60, (0, 2)),
    ("missing", 0.00, 0.50, ()),
)
PURPOSES = ("HOME", "WORK", "OTHER")


def micro_activities(stops: DataFrame, kappa: float = 1.0, seed: int = 47) -> DataFrame:
    """(uid, stop_id, seq, activity, arrival, departure): a chain of activities fills each stop.

    An agent's next activity is one it has done before, by its count, or a new one by kappa;
    durations are log-normal, at least a minute, and the last one ends with the stop."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        uid = int(pdf["uid"].iloc[0])
        done = np.zeros(len(ACTIVITIES))
        rows = []
        for r in pdf.sort_values(["arrival", "stop_id"]).itertuples():
            kind = PURPOSES.index(r.purpose) if r.purpose in PURPOSES else 2
            fits = np.array([i for i, a in enumerate(ACTIVITIES) if kind in a[3] and a[0] not in ("commute", "travel")])
            at, seq = r.arrival, 0
            while at < r.departure:
                w = done[fits] + kappa / len(fits)
                u = [drawn_number(seed, uid, r.stop_id, seq, k) for k in range(3)]
                i = int(fits[fallen(w, u[0])])
                z = np.sqrt(-2 * np.log(u[1])) * np.cos(6.283185307179586 * u[2])
                hours = max(float(np.exp(ACTIVITIES[i][1] + ACTIVITIES[i][2] * z)), 1 / 60)
                end = min(r.departure, at + pd.Timedelta(seconds=round(hours * 3600)))
                rows.append((uid, int(r.stop_id), seq, ACTIVITIES[i][0], at, end))
                done[i] += 1
                at, seq = end, seq + 1
        return pd.DataFrame(rows, columns=["uid", "stop_id", "seq", "activity", "arrival", "departure"])

    return stops.select("uid", "stop_id", "arrival", "departure", "purpose").groupBy("uid").applyInPandas(run, "uid long, stop_id long, seq int, activity string, arrival timestamp_ntz, departure timestamp_ntz")


def updated_friendships(edges: DataFrame, contacts: DataFrame, gain: float = 0.2, decay: float = 0.05, regularity: float = 0.3, days: int = 7) -> DataFrame:
    """(u, v, strength): ties grow with each day of a window on which the pair met and fade
    otherwise; pairs that meet on a share of days of at least ``regularity`` become ties."""
    met = contacts.where("u < v").groupBy("u", "v").agg(F.countDistinct("day").alias("met"))
    all_ = edges.select("u", "v", "strength").join(met, ["u", "v"], "full_outer").fillna(0)
    new = F.col("strength") == 0
    grown = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("strength") + gain * F.col("met") / days - F.when(F.col("met") == 0, decay).otherwise(0.0)))
    kept = F.when(new, F.when(F.col("met") / days >= regularity, gain * F.col("met") / days)).otherwise(grown)
    return all_.select("u", "v", kept.alias("strength")).where("strength > 0")
