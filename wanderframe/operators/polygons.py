"""Polygons filled with hexagonal cells by refinement.

From the base cells down, a cell whose surroundings no edge of the polygon enters is in or out
as a whole; the others are cut into their children.  Each edge travels only with the cells that
it comes near, and a child's side follows from its parent's by counting the edges between both
centres, so that no cell is ever compared with a whole polygon.
"""

from __future__ import annotations

from math import asin, atan2, cos, degrees, radians, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hexagons
from ..sources.work import stored

#: Centres of all descendants lie within this many distances of neighbours, the sum of the
#: steps 7 ** (-k / 2) for k from 1.
REACH = (1 / sqrt(7)) / (1 - 1 / sqrt(7))
#: Levels above the last at which cells that are in as a whole are spread over the tasks.
SPREAD = 4


def reach(res: int) -> float:
    """Degrees within which all centres of a cell's descendants lie; distances on a face are
    greater than on the sphere, and a base cell's neighbour is hexagons.STEP away."""
    return degrees(REACH * hexagons.STEP * sqrt(7) ** -res) * (1 + 1e-9)


def edges(polygons: DataFrame, key: str = "id", rings: str = "rings") -> DataFrame:
    """(key, x1, y1, x2, y2): the sides of all rings in degrees of longitude and latitude.

    ``rings`` is an array of rings, each an array of structs ``lng, lat``, closed or not; by
    the even-odd rule further rings are holes, or parts of their own.  A polygon with a side
    longer than 180 degrees crosses the antimeridian: its negative longitudes count from 180
    on.  Rings of less than three points, and rings or points that are null, are left out."""
    known = F.filter(F.filter(F.col(rings), lambda r: r.isNotNull()), lambda r: F.size(F.filter(r, _placed)) > 2)
    one = polygons.select(F.col(key).alias("key"), F.explode(known).alias("ring")).select("key", F.filter("ring", _placed).alias("ring"))
    sides = F.transform("ring", lambda p, i: F.struct(p.lng.cast("double").alias("x1"), p.lat.cast("double").alias("y1"), F.get("ring", (i + 1) % F.size("ring")).lng.cast("double").alias("x2"), F.get("ring", (i + 1) % F.size("ring")).lat.cast("double").alias("y2")))
    flat = one.withColumn("sides", sides)
    wraps = flat.groupBy(F.col("key").alias("k")).agg(F.max(F.exists("sides", lambda s: F.abs(s.x2 - s.x1) > 180)).alias("wraps"))
    east = lambda x: F.when(F.col("wraps") & (F.col(x) < 0), F.col(x) + 360).otherwise(F.col(x)).alias(x)
    return flat.join(wraps, F.col("key").eqNullSafe(F.col("k"))).select("key", "wraps", F.inline("sides")).select("key", east("x1"), "y1", east("x2"), "y2").where("x1 <> x2 OR y1 <> y2")


def _placed(p: Column) -> Column:
    return p.isNotNull() & p.lng.isNotNull() & p.lat.isNotNull()


def _near(res: int) -> Column:
    """Whether an edge enters the box about a cell's centre that holds all descendants."""
    b = reach(res)
    outermost = F.least(F.abs(F.col("lat")) + b, F.lit(90.0))
    # about a pole all longitudes are near
    wide = F.when(outermost > 90 - b, F.lit(360.0)).otherwise(b / F.cos(F.radians(outermost)))
    over = (F.least("x1", "x2") <= F.col("lng") + wide) & (F.greatest("x1", "x2") >= F.col("lng") - wide) & (F.least("y1", "y2") <= F.col("lat") + b) & (F.greatest("y1", "y2") >= F.col("lat") - b)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    off = F.abs(dx * (F.col("lat") - F.col("y1")) - dy * (F.col("lng") - F.col("x1")))
    return over & (off <= F.abs(dx) * b + F.abs(dy) * wide)


def _east_of(lat: Column, lng: Column) -> Column:
    """1 if an edge crosses the ray to the east of a point, else 0."""
    straddles = (F.col("y1") > lat) != (F.col("y2") > lat)
    x = F.col("x1") + F.try_divide(lat - F.col("y1"), F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    return F.when(straddles & (lng < x), 1).otherwise(0)


def _north_of(lat: Column, lng: Column) -> Column:
    """1 if an edge crosses the ray to the north of a point, else 0."""
    straddles = (F.col("x1") > lng) != (F.col("x2") > lng)
    y = F.col("y1") + F.try_divide(lng - F.col("x1"), F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return F.when(straddles & (lat < y), 1).otherwise(0)


def _roots(sides: DataFrame) -> DataFrame:
    """Base cells that a polygon's box comes near, each with all sides; ``flips`` is 1 where
    the side is between the centre and the far east."""
    s = hexagons.sphere()
    spots = []
    for n, (f, ab) in enumerate(s.home):
        p = s.point(f, hexagons._complex(*ab))
        spots.append((1 << 59 | n << 45 | (1 << 45) - 1, degrees(asin(p[2])), degrees(atan2(p[1], p[0]))))
    b = reach(0)
    box = sides.groupBy("key").agg(F.min(F.least("x1", "x2")).alias("west"), F.max(F.greatest("x1", "x2")).alias("east"), F.min(F.least("y1", "y2")).alias("south"), F.max(F.greatest("y1", "y2")).alias("north"))
    bases = F.array(*[F.struct(F.lit(h).alias("cell"), F.lit(lat).alias("lat"), F.lit(lng).alias("lng"), F.lit(360.0 if abs(lat) + 2 * b > 90 else b / cos(radians(abs(lat) + b))).alias("wide")) for h, lat, lng in spots])
    # the polygon repeats every 360 degrees; centres lie from -180 to 180
    overlaps = lambda x: (x.lat + b >= F.col("south")) & (x.lat - b <= F.col("north")) & F.exists(F.array(*[F.lit(t) for t in (-360.0, 0.0, 360.0)]), lambda t: (x.lng + x.wide >= F.col("west") + t) & (x.lng - x.wide <= F.col("east") + t))
    near = box.select("key", F.explode(F.filter(bases, overlaps)).alias("c")).select("key", "c.cell", "c.lat", "c.lng")
    copies = sides.withColumn("t", F.explode(F.array(F.lit(-360.0), F.lit(0.0), F.lit(360.0)))).select("key", (F.col("x1") + F.col("t")).alias("x1"), "y1", (F.col("x2") + F.col("t")).alias("x2"), "y2")
    return copies.join(near.withColumnRenamed("key", "k"), F.col("key").eqNullSafe(F.col("k"))).drop("k").withColumn("flips", _east_of(F.col("lat"), F.col("lng")))


def fill(polygons: DataFrame, res: int, key: str = "id", rings: str = "rings", compact: bool = False) -> DataFrame:
    """(key, cell): the cells of resolution ``res`` whose centre lies in the polygon, by straight
    lines in longitude and latitude; with ``compact`` cells that lie in it as a whole, with all
    their descendants, stand for those.

    See :func:`edges` for what ``rings`` may hold.  Polygons of one key count as one by the
    even-odd rule.  A polygon without an area, or a table without polygons, has no cells."""
    key_type = polygons.schema[key].dataType
    step = _roots(edges(polygons, key, rings)).withColumn("inside", F.lit(0))
    whole: list[DataFrame] = []
    for level in range(res + 1):
        step = stored(step.withColumn("near", _near(level)), "fill")
        side = step.groupBy("key", "cell").agg(((F.first("inside") + F.sum("flips")) % 2).cast("int").alias("inside"), F.max("near").alias("open"))
        if level == res:
            whole.append(side.where("inside = 1").select("key", "cell"))
            break
        side = stored(side, "fill-sides")
        whole.append(side.where("inside = 1 AND NOT open").select("key", "cell"))
        below = side.where("open").select(F.col("key").alias("k"), F.col("cell").alias("c"), "inside", F.explode(hexagons.children("cell")).alias("child"))
        below = below.withColumn("at", hexagons.centre("child"))
        if below.isEmpty():
            break
        left = step.where("near").drop("inside", "flips", "near")
        met = left.join(below, F.col("key").eqNullSafe(F.col("k")) & (F.col("cell") == F.col("c"))).drop("k", "c")
        # a longitude within 180 degrees of the parent's
        lng = F.col("lng") + F.pmod(F.col("at.lng") - F.col("lng") + 180.0, F.lit(360.0)) - 180.0
        moved = met.withColumn("to_lat", F.col("at.lat")).withColumn("to_lng", lng)
        # along the parallel of the parent to the child's meridian, then along that
        a = _east_of(F.col("lat"), F.col("lng")) + _east_of(F.col("lat"), F.col("to_lng"))
        b = _north_of(F.col("lat"), F.col("to_lng")) + _north_of(F.col("to_lat"), F.col("to_lng"))
        step = moved.withColumn("flips", a + b).select("key", "x1", "y1", "x2", "y2", F.col("child").alias("cell"), F.col("to_lat").alias("lat"), F.col("to_lng").alias("lng"), "flips", "inside")
    out = whole[0]
    for level in range(1, res + 1):
        if not compact:
            out = out.select("key", F.explode(hexagons.children("cell")).alias("cell"))
            if level == res - SPREAD:
                out = out.repartition("cell")  # a cell that is in as a whole grows by sevens
        out = out.unionByName(whole[level]) if level < len(whole) else out
    return out.select(F.col("key").cast(key_type).alias(key), "cell")
