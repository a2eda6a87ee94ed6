"""Movement in windows, with ties between agents that movement makes and unmakes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import deterrence
from ..functions.scalar import explore_probability, uniform
from ..sources.work import forget, stored
from .sampling import weighted
from .simulate import updated_friendships, within

#: How an agent came to a place: by a friend, by gravity, or back.
SOCIAL, GRAVITY, RETURN = 0, 1, 2


def options(visits: DataFrame, here: DataFrame, ties: DataFrame, places: DataFrame, w: int, rho: float, gamma: float, alpha: float, power: float, km: float, seed: int) -> DataFrame:
    """(uid, place, w, kind): where each agent may go next, with weights.

    An agent explores by the number of places it knows.  An explorer goes where friends have
    been, with chance alpha, by their visits and the ties' strength, else to a place near by
    gravity; places it knows are no discoveries.  All may return, by their own visits, which
    is also what is left where there is nothing to discover."""
    known = visits.select("uid", "place")
    agents = visits.groupBy("uid").agg(F.count("*").alias("s"))
    explorers = agents.where(uniform(seed + 10 * w, "uid") < explore_probability("s", rho, gamma)).select("uid", (uniform(seed + 10 * w + 1, "uid") < alpha).alias("social"))
    back = visits.select("uid", "place", F.col("n").cast("double").alias("w"), F.lit(RETURN).alias("kind"))
    friends = ties.select(F.col("u").alias("uid"), F.col("v").alias("friend"), "strength").unionByName(ties.select(F.col("v").alias("uid"), F.col("u").alias("friend"), "strength"))
    told = explorers.where("social").join(friends, "uid").join(visits.withColumnRenamed("uid", "friend"), "friend").groupBy("uid", "place").agg(F.sum(F.col("strength") * F.col("n")).alias("w"))
    told = told.join(known, ["uid", "place"], "left_anti").withColumn("kind", F.lit(SOCIAL))
    at = here.select("uid", "place").join(places.select("place", "lat", "lng"), "place").join(explorers.select("uid"), "uid")
    near = within(at, places, km).select("uid", "place", deterrence("d", F.lit(1.0), "relevance", power).alias("w"))
    near = near.join(known, ["uid", "place"], "left_anti").withColumn("kind", F.lit(GRAVITY))
    return back.unionByName(told).unionByName(near)


def move_in_windows(homes: DataFrame, places: DataFrame, ties: DataFrame, windows: int, rho: float = 0.6, gamma: float = 0.21, alpha: float = 0.3, power: float = -2.0, km: float = 30.0, crowd: int = 50, memory: int = 3, seed: int = 50, **bonds: float) -> tuple[DataFrame, DataFrame]:
    """Moves (window, uid, place, kind) of so many windows, and the ties (u, v, strength) after.

    ``homes`` (uid, place) is where agents start, ``places`` (place, lat, lng, relevance) where
    they can go, ``ties`` has u < v.  In a window every agent moves once, by what it and its
    friends knew before; then all moves are committed at once, who meets is counted, and ties
    grow with the share of the last ``memory`` windows in which a pair met or fade
    (:func:`simulate.updated_friendships`).  Places with more than ``crowd`` agents make no
    contacts: a parameter of the model, which bounds the pairs.  Only the number of windows is
    a loop on the driver; each stores its tables and drops those before."""
    places = stored(places.select("place", "lat", "lng", "relevance"), "places")
    here = stored(homes.select("uid", "place"), "here")
    visits = stored(here.withColumn("n", F.lit(1).cast("long")), "visits")
    ties = stored(ties.select("u", "v", "strength"), "ties")
    moves, contacts = [], []
    for w in range(windows):
        drawn = weighted(options(visits, here, ties, places, w, rho, gamma, alpha, power, km, seed), ["uid", "kind"], "place", "w", 1, seed + 10 * w + 2)
        best = drawn.groupBy("uid").agg(F.min(F.struct("kind", "place")).alias("b"))
        here = stored(best.select(F.lit(w).alias("window"), "uid", "b.place", "b.kind"), "here")
        moves.append(here)
        seen = stored(visits.unionByName(here.select("uid", "place", F.lit(1).cast("long").alias("n"))).groupBy("uid", "place").agg(F.sum("n").alias("n")), "visits")
        quiet = here.groupBy("place").agg(F.count("*").alias("k")).where(F.col("k").between(2, crowd)).select("place")
        present = here.join(quiet, "place", "left_semi").select("place", "uid")
        pairs = present.withColumnRenamed("uid", "u").join(present.withColumnRenamed("uid", "v"), "place").where("u < v")
        contacts = [*contacts, stored(pairs.select("u", "v", F.lit(w).alias("day")), "contacts")][-memory:]
        bound = stored(updated_friendships(ties, reduce(DataFrame.unionByName, contacts), days=len(contacts), **bonds), "ties")
        forget(visits, ties)
        visits, ties = seen, bound
    return reduce(DataFrame.unionByName, moves), ties
