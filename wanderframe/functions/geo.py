"""Distances, projections and grid cells as column expressions."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KM, METRES = 6371.0088, 6371000.0
MERCATOR = 6378137.0
FINEST = 24


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine(lat1, lng1, lat2, lng2, radius: float = KM) -> Column:
    """Great-circle distance in the radius' unit; null where any coordinate is null.

    The clamp at one is applied to known values only: ``least`` would skip a null."""
    p1, p2 = F.radians(c(lat1)), F.radians(c(lat2))
    a = F.pow(F.sin((p2 - p1) / 2), 2.0) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(c(lng2) - c(lng1)) / 2), 2.0)
    return F.when(a.isNotNull(), 2 * radius * F.asin(F.sqrt(F.least(a, F.lit(1.0)))))


def in_range(lat, lng) -> Column:
    """Latitude within 90 degrees and longitude within 180, ends included."""
    return c(lat).between(-90.0, 90.0) & c(lng).between(-180.0, 180.0)


def mercator(lat, lng) -> tuple[Column, Column]:
    """Web-Mercator x and y in metres."""
    return F.radians(c(lng)) * MERCATOR, F.log(F.tan(F.lit(pi / 4) + F.radians(c(lat)) / 2)) * MERCATOR


def local_scale(lat, lng, mean_lat) -> tuple[Column, Column]:
    """Degrees with longitude shrunk by the cosine of a mean latitude, for nearest-point search."""
    return c(lat), c(lng) * F.cos(F.radians(c(mean_lat)))


def cell(lat, lng, res: int) -> Column:
    """Equal-angle cell id as a long: resolution in bits 52 up, then row and column.

    A cell of resolution r spans 2 ** (1 - r) degrees.  Null where a coordinate is null or
    out of range."""
    n = float(2 ** (res - 1))
    row, col = F.floor((c(lat) + 90.0) * n), F.floor((c(lng) + 180.0) * n)
    return F.when(in_range(lat, lng), F.lit(res << 52) + row * (1 << FINEST + 2) + col)


def with_cell(df: DataFrame, name: str, lat, lng, res: int) -> DataFrame:
    """``df`` with ``name``, the cell of a point."""
    return df.withColumn(name, cell(lat, lng, res))


def with_centre(df: DataFrame, h: str, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """``df`` with the latitude and longitude of a cell's centre."""
    y, x = cell_centre(h)
    return df.withColumns({lat: y, lng: x})


def cell_resolution(h) -> Column:
    return F.shiftright(c(h), 52).bitwiseAND(15).cast("int")


def cell_row(h) -> Column:
    return F.shiftright(c(h), FINEST + 2).bitwiseAND((1 << FINEST + 2) - 1)


def cell_column(h) -> Column:
    return c(h).bitwiseAND((1 << FINEST + 2) - 1)


def cell_size(h) -> Column:
    return F.pow(F.lit(2.0), 1.0 - cell_resolution(h))


def cell_centre(h) -> tuple[Column, Column]:
    """Latitude and longitude of a cell's centre."""
    s = cell_size(h)
    return (cell_row(h) + 0.5) * s - 90.0, (cell_column(h) + 0.5) * s - 180.0


def cell_parent(h, res: int) -> Column:
    """The cell of a coarser resolution that holds this one."""
    up = (cell_resolution(h) - res).cast("int")
    return F.lit(res << 52) + F.call_function("shiftright", cell_row(h), up) * (1 << FINEST + 2) + F.call_function("shiftright", cell_column(h), up)


def cell_disk(h, k: int, res: int | None = None) -> Column:
    """The cells at most k rows and columns away, itself included, each once: columns go on
    around the earth, rows end at the poles.  ``res`` is taken from the cell."""
    n = F.call_function("shiftleft", F.lit(1).cast("long"), cell_resolution(h) - 1)  # cells a degree, times two a circle
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-k, k + 1) for j in range(-k, k + 1)])
    head = F.shiftleft(cell_resolution(h).cast("long"), 52)
    moved = F.transform(steps, lambda s: F.struct((cell_row(h) + s.i).alias("y"), F.pmod(cell_column(h) + s.j, 360 * n).alias("x")))
    return F.array_distinct(F.transform(F.filter(moved, lambda p: (p.y >= 0) & (p.y <= 180 * n)), lambda p: head + p.y * (1 << FINEST + 2) + p.x))


def cell_ring(h) -> Column:
    """The closed boundary of a cell as (lng, lat) pairs, counter-clockwise."""
    s = cell_size(h)
    south, west = cell_row(h) * s - 90.0, cell_column(h) * s - 180.0
    corners = ((west, south), (west + s, south), (west + s, south + s), (west, south + s), (west, south))
    return F.array(*[F.array(F.round(x, 9), F.round(y, 9)) for x, y in corners])


def cell_hex(h) -> Column:
    return F.lower(F.hex(c(h)))


def deterrence(distance, mass_from, mass_to, power: float = -2.0, out: float = 1.0, into: float = 1.0, least: float = 0.001) -> Column:
    """Gravity weight: origin mass, destination mass and distance raised to their powers."""
    return F.pow(c(mass_from), F.lit(out)) * F.pow(c(mass_to), F.lit(into)) * F.pow(F.greatest(c(distance), F.lit(least)), F.lit(power))


def friction(distance, rate: float, least: float, power: float) -> Column:
    """Exponential decay over distance, corrected for the density of far places."""
    return F.exp(-rate * c(distance)) / F.pow(F.greatest(c(distance), F.lit(least)), F.lit(power))


# The ellipsoid of 1980 and the plane of zone VII of the Japanese grid (origin,
# scale); step, stretches and anchor in metres of the obfuscated pings' grid.
AXIS, FLATTENING = 6378137.0, 1 / 298.257222101
ORIGIN_LAT, ORIGIN_LNG, SCALE = 36.0, 137 + 10 / 60, 0.9999
STEP, STRETCH_X, STRETCH_Y, ANCHOR_X, ANCHOR_Y = 500.0, 1.1, 0.9, -11610.0, -104950.0


def undistorted(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """``df`` with metric_x and metric_y: the pings' grid turned back by a quarter, its
    stretches undone about its mean, in metres about the anchor."""
    mean = df.agg(F.avg(y).alias("__mx"), F.avg(-F.col(x)).alias("__my"))  # one row
    out = df.join(F.broadcast(mean))
    mx = ANCHOR_X + (F.col(y) - F.col("__mx")) / STRETCH_X * STEP
    my = ANCHOR_Y + (-F.col(x) - F.col("__my")) / STRETCH_Y * STEP
    return out.withColumns({"metric_x": mx, "metric_y": my}).drop("__mx", "__my")


def _series() -> tuple[float, list[float], list[float], float]:
    """Rectifying radius and the coefficients of the transverse Mercator projection and of
    its inverse, as series in the third flattening."""
    n = FLATTENING / (2 - FLATTENING)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    ahead = [n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3, 13 / 48 * n**2 - 3 / 5 * n**3, 61 / 240 * n**3]
    back = [n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3, n**2 / 48 + n**3 / 15, 17 / 480 * n**3]
    return radius, ahead, back, 2 * n**0.5 / (1 + n)


def _conformal(sine: Column, e: float) -> Column:
    """Tangent of the conformal latitude."""
    return F.sinh(F.atanh(sine) - e * F.atanh(e * sine))


def to_plane(lat, lng, origin: tuple[float, float] = (ORIGIN_LAT, ORIGIN_LNG), scale: float = SCALE) -> tuple[Column, Column]:
    """(x, y) in metres east and north of the origin: transverse Mercator."""
    radius, ahead, _, e = _series()

    def plane(t: Column, turn: Column) -> tuple[Column, Column]:
        xi, eta = F.atan2(t, F.cos(turn)), F.atanh(F.sin(turn) / F.sqrt(1 + t * t))
        north = xi + sum((a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(ahead, 1)), F.lit(0.0))
        east = eta + sum((a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(ahead, 1)), F.lit(0.0))
        return east * scale * radius, north * scale * radius

    x, y = plane(_conformal(F.sin(F.radians(c(lat))), e), F.radians(c(lng) - origin[1]))
    _, zero = plane(_conformal(F.sin(F.radians(F.lit(origin[0]))), e), F.lit(0.0))
    return x, y - zero


def from_plane(x, y, origin: tuple[float, float] = (ORIGIN_LAT, ORIGIN_LNG), scale: float = SCALE) -> tuple[Column, Column]:
    """(lat, lng) of metres east and north of the origin."""
    from math import atan, atanh, radians, sin, sinh

    radius, ahead, back, e = _series()
    sine = sin(radians(origin[0]))
    xi0 = atan(sinh(atanh(sine) - e * atanh(e * sine)))
    zero = xi0 + sum(a * sin(2 * j * xi0) for j, a in enumerate(ahead, 1))
    xi, eta = c(y) / (scale * radius) + zero, c(x) / (scale * radius)
    xi1 = xi - sum((b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(back, 1)), F.lit(0.0))
    eta1 = eta - sum((b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(back, 1)), F.lit(0.0))
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    n = FLATTENING / (2 - FLATTENING)
    turn = [2 * n - 2 / 3 * n**2 - 2 * n**3, 7 / 3 * n**2 - 8 / 5 * n**3, 56 / 15 * n**3]
    phi = chi + sum((d * F.sin(2 * j * chi) for j, d in enumerate(turn, 1)), F.lit(0.0))
    return F.degrees(phi), F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))) + origin[1]
