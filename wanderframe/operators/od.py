"""Flows between cells, hourly histograms of cells, and where people live and work."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hexagons
from ..functions.geo import haversine
from ..functions.scalar import bivariate_class, finite, purpose, searchsorted
from ..sources.work import stored
from . import quantiles as q
from .traj import anchors, located, modal


def flows(df: DataFrame, res: int, index=hexagons) -> DataFrame:
    """(origin, destination, flow): moves between different cells, in long form.

    ``index`` is the kind of cells: ``functions.hexagons``, or ``functions.geo`` for a grid of
    equal angles."""
    w = Window.partitionBy("uid").orderBy("datetime")
    moves = index.with_cell(located(df), "origin", "lat", "lng", res).withColumn("destination", F.lead("origin").over(w))
    return moves.where("origin <> destination").groupBy("origin", "destination").agg(F.count("*").alias("flow"))


def flow_matrix(f: DataFrame, destinations: list) -> DataFrame:
    """The dense matrix, a column for each of the given destinations, gaps as zero."""
    return f.groupBy("origin").pivot("destination", destinations).agg(F.sum("flow")).fillna(0)


def common_part(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("origin", "destination"), value: str = "flow") -> DataFrame:
    """Common part of commuters: twice the shared flow over all flow."""
    both = a.select(*keys, F.col(value).alias("x"), F.lit(0).cast("long").alias("y")).unionByName(b.select(*keys, F.lit(0).cast("long").alias("x"), F.col(value).alias("y")))
    per = both.groupBy(*keys).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    return per.agg(F.coalesce(2.0 * F.sum(F.least("x", "y")) / F.nullif(F.sum(F.col("x") + F.col("y")), F.lit(0)), F.lit(0.0)).alias("cpc"))


def hourly(df: DataFrame, res: int, index=hexagons) -> DataFrame:
    """(cell, hour, n): rows per cell and hour of the day."""
    return index.with_cell(located(df), "cell", "lat", "lng", res).groupBy("cell", F.hour("datetime").alias("hour")).agg(F.count("*").alias("n"))


def hourly_wide(h: DataFrame) -> DataFrame:
    return h.groupBy("cell").pivot("hour", list(range(24))).agg(F.sum("n")).fillna(0)


def hourly_difference(synthetic: DataFrame, observed: DataFrame, circular: bool = False) -> DataFrame:
    """Per cell: volumes, their difference in percent of the observed, peak hours (the first
    of equals) and their shift; shifts beyond twelve wrap only if ``circular``."""
    side = lambda h, n: h.groupBy("cell").agg(F.sum("n").alias(f"{n}_volume"), F.min_by("hour", F.struct(-F.col("n"), F.col("hour"))).alias(f"{n}_peak"))
    both = side(synthetic, "syn").join(side(observed, "obs"), "cell", "full_outer").fillna(0)
    raw = F.abs(F.col("syn_peak") - F.col("obs_peak"))
    shift = F.least(raw, 24 - raw) if circular else F.least(F.least(raw, F.when(raw <= 12, 12 - raw).otherwise(raw)), F.lit(12))
    diff = (F.col("syn_volume") - F.col("obs_volume")) / F.greatest(F.col("obs_volume"), F.lit(1)) * 100
    return both.withColumn("volume_diff_pct", diff).withColumn("peak_shift", shift).withColumn("class", bivariate_class("volume_diff_pct", "peak_shift"))


def homes(df: DataFrame, purpose_column: str | None, fine: int = 12, index=hexagons) -> DataFrame:
    """(uid, kind, cell): the modal fine cell of HOME and of WORK rows, or by hours."""
    placed = index.with_cell(located(df), "cell", "lat", "lng", fine)
    if purpose_column:
        kinds = placed.withColumn("kind", purpose(purpose_column)).where("kind <> 'OTHER'")
        return modal(kinds, ["uid", "kind"], "cell", "cell")
    a = anchors(placed, "datetime", "cell")
    return a.select("uid", F.explode(F.map_from_arrays(F.array(F.lit("HOME"), F.lit("WORK")), F.array("home", "work"))).alias("kind", "cell")).where("cell IS NOT NULL")


def density(h: DataFrame, res: int, index=hexagons) -> DataFrame:
    """(kind, cell, agents) at a coarser resolution."""
    return h.groupBy("kind", index.cell_parent("cell", res).alias("cell")).agg(F.count("*").alias("agents"))


def matched(h: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row: agents with a home, and those among the given profiles."""
    own = h.where("kind = 'HOME'").select("uid").distinct()
    some = profiles.select("uid").distinct().withColumn("in", F.lit(1))
    return own.join(some, "uid", "left").agg(F.count("*").alias("total"), F.count("in").alias("matching"))


def annotated(d: DataFrame) -> DataFrame:
    """Densities with five colour classes at 20, 40, 60 and 80 percent and the share of the kind."""
    totals = d.groupBy("kind").agg(F.sum("agents").alias("all"))
    breaks = q.matched(q.quantiles(d, "agents", [0.2, 0.4, 0.6, 0.8], ["kind"]).select("kind", F.col("q").alias("breaks")), totals, ["kind"])
    return d.join(F.broadcast(breaks), "kind").select("kind", "cell", "agents", searchsorted("breaks", F.col("agents").cast("double")).alias("class"), (100.0 * F.col("agents") / F.col("all")).alias("pct"))


#: Height of the strips that neighbours are counted by, in parts of the distance.
STRIPS = 32


def neighbours_within(points: DataFrame, metres: float = 500.0, degrees: float = 0.0045, key: str = "id", lat: str = "lat", lng: str = "lng") -> DataFrame:
    """(id, n): other points within the distance and the box of degrees.

    Places, not points, meet in grid squares of that many degrees: each looks into its own and
    the eight around it.  There the places lie in strips, sorted by longitude; what is surely
    within is counted by running sums, and only places near the circle are measured, so that
    no list of pairs is made.  A task holds the places of nine squares at most."""
    g = points.select(F.col(key).alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lng).cast("double").alias("lng"))
    square = [F.floor(F.col("lat") / degrees).alias("gy"), F.floor(F.col("lng") / degrees).alias("gx")]
    places = g.where(finite("lat") & finite("lng")).groupBy("lat", "lng").agg(F.count("id").alias("w")).select("lat", "lng", "w", *square)
    steps = F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    met = places.withColumn("s", F.explode(steps)).select((F.col("gy") + F.col("s.dy")).alias("gy"), (F.col("gx") + F.col("s.dx")).alias("gx"), "lat", "lng", "w", ((F.col("s.dy") == 0) & (F.col("s.dx") == 0)).alias("own"))

    def counted(square: pa.Table) -> pa.Table:
        y, x, w = (square[c].to_numpy() for c in ("lat", "lng", "w"))
        own = np.flatnonzero(square["own"].to_numpy())
        n = np.concatenate([_within(y[o], x[o], y, x, w, metres, degrees) for o in np.array_split(own, -(-len(own) // 4096))]) if len(own) else np.zeros(0, np.int64)
        return pa.table([pa.array(y[own]), pa.array(x[own]), pa.array(n)], names=["lat", "lng", "n"])

    n = met.groupBy("gy", "gx").applyInArrow(counted, "lat double, lng double, n long")
    return g.join(n, ["lat", "lng"], "left").select("id", F.coalesce(F.when(F.col("id").isNotNull(), F.col("n") - 1), F.lit(0).cast("long")).alias("n"))


def _within(y: np.ndarray, x: np.ndarray, ys: np.ndarray, xs: np.ndarray, w: np.ndarray, metres: float, degrees: float, radius: float = 6371000.0) -> np.ndarray:
    """Weights of the places (ys, xs, w) within the distance and the box of each (y, x), itself
    included."""
    out = np.zeros(len(y), np.int64)
    most = np.sin(metres / radius / 2) ** 2
    strip = np.floor((ys - ys.min()) / (degrees / STRIPS)).astype(np.int64)
    order = np.lexsort((xs, strip))
    ys, xs, w, strip = ys[order], xs[order], w[order], strip[order]
    sums = np.concatenate([[0], np.cumsum(w)])
    starts = np.flatnonzero(np.diff(strip, prepend=-1))
    wide, narrow = degrees * (1 + 1e-9), degrees * (1 - 1e-9)
    for a, b in zip(starts, np.append(starts[1:], len(ys)), strict=True):
        low, high = ys[a:b].min(), ys[a:b].max()
        near, far = np.maximum(0, np.maximum(low - y, y - high)), np.maximum(np.abs(y - low), np.abs(y - high))
        c = np.cos(np.radians([low, high]))

        def half(gap: np.ndarray, cos: float) -> np.ndarray:
            """Half the width of the circle at so many degrees north or south, in degrees."""
            left = (most - np.sin(np.radians(gap) / 2) ** 2) / np.maximum(np.cos(np.radians(y)) * cos, 1e-300)  # noqa: B023
            return np.where(left < 0, -1.0, np.degrees(2 * np.arcsin(np.sqrt(np.clip(left, 0, 1)))))

        outer = np.where(near > wide, -1.0, np.minimum(half(near, c.min() * (1 - 1e-9)) * (1 + 1e-9) + 1e-12, wide))
        inner = np.where(far > narrow, -1.0, np.minimum(half(far, (1.0 if low <= 0 <= high else c.max()) * (1 + 1e-9)) * (1 - 1e-9) - 1e-12, narrow))
        at = np.flatnonzero(outer >= 0)
        band = xs[a:b]
        left, right = (a + np.searchsorted(band, x[at] + s * outer[at], side) for s, side in ((-1, "left"), (1, "right")))
        some = inner[at] >= 0
        first = np.where(some, a + np.searchsorted(band, x[at] - inner[at], "left"), right)
        last = np.where(some, a + np.searchsorted(band, x[at] + inner[at], "right"), right)
        first, last = np.clip(first, left, right), np.clip(last, left, right)
        out[at] += sums[last] - sums[first]
        for start, end in ((left, first), (last, right)):
            size = np.maximum(end - start, 0)
            i = np.repeat(at, size)
            j = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
            p, q = np.radians(y[i]), np.radians(ys[j])
            h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(xs[j] - x[i]) / 2) ** 2
            hit = (2 * radius * np.arcsin(np.sqrt(np.clip(h, 0, 1))) <= metres) & (np.abs(y[i] - ys[j]) <= degrees) & (np.abs(x[i] - xs[j]) <= degrees)
            np.add.at(out, i[hit], w[j[hit]])
    return out


#: Finer grids for the nearest node: each has squares a quarter as wide.
FINER, CROWD = 5, 16


def snap(points: DataFrame, nodes: DataFrame, metres: float = 750.0) -> DataFrame:
    """(id, node, metres): the nearest node within the distance, or -1.

    Places, not points, are looked up among the least nodes of places.  Squares of the grid are
    as wide as the distance at the points' latitude or wider; where nodes crowd, finer grids
    come first, and a place whose nearest lies within a square's width is done."""
    known = points.select("id", F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"))
    left = stored(known.where(finite("lat") & finite("lng")).select("lat", "lng").distinct(), "places")
    spots = stored(nodes.where(finite("lat") & finite("lng")).groupBy(F.col("lat").cast("double").alias("nlat"), F.col("lng").cast("double").alias("nlng")).agg(F.min("node").alias("node")), "spots")
    at = lambda lat, lng, m: (F.floor(lat / (m / 111_000.0)), F.floor(lng / (m / 111_000.0 * 2)))  # noqa: E731  longitudes shrink to half at 60 degrees
    level = 0
    while level < FINER and not spots.groupBy(*at(F.col("nlat"), F.col("nlng"), metres / 4**level)).count().where(F.col("count") > CROWD).isEmpty():
        level += 1
    steps = F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    d = haversine("lat", "lng", "nlat", "nlng", 6371000.0)
    found = []
    for k in range(level, -1, -1):
        reach = metres / 4**k
        ny, nx = at(F.col("nlat"), F.col("nlng"), reach)
        py, px = at(F.col("lat"), F.col("lng"), reach)
        n = spots.withColumn("s", F.explode(steps)).select("node", "nlat", "nlng", (ny + F.col("s.dy")).alias("gy"), (nx + F.col("s.dx")).alias("gx"))
        best = left.withColumns({"gy": py, "gx": px}).join(n, ["gy", "gx"]).withColumn("metres", d).where(F.col("metres") <= reach).groupBy("lat", "lng").agg(F.min(F.struct("metres", "node")).alias("m"))
        found.append(stored(best, "snapped"))
        if k:
            left = stored(left.join(found[-1], ["lat", "lng"], "left_anti"), "places")
    best = reduce(DataFrame.unionByName, found)
    return known.join(best, ["lat", "lng"], "left").select("id", F.coalesce(F.col("m.node"), F.lit(-1)).alias("node"), F.col("m.metres").alias("metres"))


def hourly_transport(synthetic: DataFrame, observed: DataFrame, res: int, slices: int = 16, seed: int = 42, index=hexagons, by: list[str] | None = None) -> DataFrame:
    """Sliced earth mover's distance of two visit histograms over cell centres in metres and
    hours of the day, an hour counting as a kilometre, per group of ``by``."""
    from ..functions.geo import mercator
    from .distance import sliced_wasserstein

    def points(df: DataFrame) -> DataFrame:
        at = index.with_cell(located(df), "cell", "lat", "lng", res).select(*(by or []), "cell", (F.hour("datetime") * 1000.0).alias("t"))
        x, y = mercator("c_lat", "c_lng")
        return index.with_centre(at, "cell", "c_lat", "c_lng").select(*(by or []), x.alias("x"), y.alias("y"), "t")

    return sliced_wasserstein(points(synthetic), points(observed), ["x", "y", "t"], slices, seed, by)
