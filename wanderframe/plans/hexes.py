"""Queries on hexagonal cells, with SQL that finds cells its own way.

The SQL takes the nearest of the lattice points around a place by distance, and climbs to the
base cell by trying which direction leaves a multiple of 7; only the faces and the tables of
base cells are the same.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hexagons as H
from ..operators import od, polygons
from . import views
from .registry import Registry
from .views import common

query = Registry()


def _list(values) -> str:
    return "[" + ", ".join(str(int(x)) for x in values) + "]"


def located_sql(src: str, res: int, name: str) -> str:
    """Common tables up to ``name`` (lat, lng, face, i, j): lattice points of ``src``'s places."""
    s = H.sphere()
    faces = ", ".join("(" + ", ".join([str(f), *(repr(float(x)) + "::DOUBLE" for v in (s.centre[f], s.x[f], s.y[f]) for x in v)]) + ")" for f in range(20))
    m = H._complex(*H.scale(res)) / H.STEP
    return f"""{name}f AS (SELECT * FROM (VALUES {faces}) t(face, cx, cy, cz, xx, xy, xz, yx, yy, yz)),
 {name}g AS (SELECT lat, lng, cos(radians(lat)) * cos(radians(lng)) AS x, cos(radians(lat)) * sin(radians(lng)) AS y, sin(radians(lat)) AS z FROM (SELECT DISTINCT lat, lng FROM {src})),
 {name}n AS (SELECT lat, lng, face, (x * xx + y * xy + z * xz) / d AS p, (x * yx + y * yy + z * yz) / d AS q FROM (SELECT *, x * cx + y * cy + z * cz AS d FROM {name}g, {name}f) QUALIFY row_number() OVER (PARTITION BY lat, lng ORDER BY d DESC, face) = 1),
 {name}o AS (SELECT lat, lng, face, {m.real!r}::DOUBLE * p - {m.imag!r}::DOUBLE * q AS u, ({m.imag!r}::DOUBLE * p + {m.real!r}::DOUBLE * q) / {H.W.imag!r}::DOUBLE AS b FROM {name}n),
 {name} AS (SELECT lat, lng, face, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j FROM (SELECT lat, lng, face, u + b / 2 AS a, b, floor(u + b / 2) + da AS i, floor(b) + db AS j FROM {name}o, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(da, db))
  QUALIFY row_number() OVER (PARTITION BY lat, lng ORDER BY (a - i) * (a - i) - (a - i) * (b - j) + (b - j) * (b - j)) = 1)"""


def ids_sql(src: str, res: int, name: str) -> str:
    """Common tables up to ``name`` (face, i, j, cell): the cells of ``src``'s lattice points."""
    s = H.sphere()
    ua, ub = (_list([u[k] for u in H.UNITS] + [0]) for k in (0, 1))
    up = "CASE WHEN lvl % 2 = 1 THEN [3 * x - y, x + 2 * y] ELSE [2 * x + y, 3 * y - x] END"
    rest = f"list_filter(range(7), lambda k: (CASE WHEN lvl % 2 = 1 THEN abs((3 * (a - {ua}[k + 1]) - (b - {ub}[k + 1])) % 7) + abs((a - {ua}[k + 1] + 2 * (b - {ub}[k + 1])) % 7) ELSE abs((2 * (a - {ua}[k + 1]) + b - {ub}[k + 1]) % 7) + abs((3 * (b - {ub}[k + 1]) - (a - {ua}[k + 1])) % 7) END) = 0)[1]"
    spot = "face * 25 + (a + 2) * 5 + b + 2"
    return f"""{name}h AS (SELECT DISTINCT face, i, j, i AS a, j AS b, {res} AS lvl, CAST([] AS BIGINT[]) AS e FROM {src}
  UNION ALL SELECT face, i, j, up[1] // 7, up[2] // 7, lvl - 1, list_prepend(k, e) FROM (SELECT *, {up} AS up FROM (SELECT *, a - {ua}[k + 1] AS x, b - {ub}[k + 1] AS y FROM (SELECT *, {rest} AS k FROM {name}h WHERE lvl > 0)))),
 {name} AS (SELECT face, i, j, CAST({1 << 59 | res << 52 | (1 << 3 * (15 - res)) - 1} AS BIGINT) + (CAST({_list(s.base.ravel())}[{spot} + 1] AS BIGINT) << 45)
   + CAST(coalesce(list_sum(list_transform(range(1, {res + 1}), lambda l: CASE WHEN e[l] = 6 THEN 0 ELSE CAST({_list(H.DIGITS)}[(e[l] + turn) % 6 + 1] AS BIGINT) << (45 - 3 * l) END)), 0) AS BIGINT) AS cell
  FROM (SELECT *, {_list(s.turns.ravel())}[({spot}) * 7 + coalesce(list_filter(e, lambda x: x < 6)[1], 6) + 1] AS turn FROM {name}h WHERE lvl = 0))"""


def hexed(name: str, res: int, *names: str) -> str:
    """A WITH clause of the test views and ``name``: pings with their cell."""
    head = common(*(names or ("pings",))).replace("WITH ", "WITH RECURSIVE ", 1)
    return f"{head}, {located_sql('pings', res, f'{name}l')}, {ids_sql(f'{name}l', res, f'{name}i')}, {name} AS (SELECT p.*, c.cell FROM pings p JOIN {name}l l ON p.lat = l.lat AND p.lng = l.lng JOIN {name}i c ON c.face = l.face AND c.i = l.i AND c.j = l.j)"


def _more(name: str, res: int) -> str:
    return f", {located_sql('pings', res, f'{name}l')}, {ids_sql(f'{name}l', res, f'{name}i')}, {name} AS (SELECT p.*, c.cell FROM pings p JOIN {name}l l ON p.lat = l.lat AND p.lng = l.lng JOIN {name}i c ON c.face = l.face AND c.i = l.i AND c.j = l.j)"


def _parent(res: int) -> str:
    low = res << 52 | (1 << 3 * (15 - res)) - 1
    keep = ~(15 << 52 | (1 << 3 * (15 - res)) - 1)
    return f"((cell & {keep}) | {low})"


@query(hexed("x", 9) + f" SELECT event_id, cell, {_parent(7)} AS parent, lower(to_hex(cell)) AS hex FROM x")
def hex_cells(spark, sf):
    c = H.with_cell(views.pings(spark, sf), "cell", "lat", "lng", 9)
    return c.select("event_id", "cell", H.parent("cell", 7).alias("parent"), H.cell_hex("cell").alias("hex"))


_M = 1 / H._complex(*H.scale(9))
CENTRE = f"""c AS (SELECT i.cell, l.face, {H.STEP!r}::DOUBLE * ((l.i - l.j / 2.0) * {_M.real!r}::DOUBLE - l.j * {H.W.imag!r}::DOUBLE * {_M.imag!r}::DOUBLE) AS p, {H.STEP!r}::DOUBLE * ((l.i - l.j / 2.0) * {_M.imag!r}::DOUBLE + l.j * {H.W.imag!r}::DOUBLE * {_M.real!r}::DOUBLE) AS q FROM (SELECT DISTINCT face, i, j FROM xl) l JOIN xi i USING (face, i, j)),
 v AS (SELECT cell, cx + p * xx + q * yx AS x, cy + p * xy + q * yy AS y, cz + p * xz + q * yz AS z FROM c JOIN xlf USING (face))"""


@query(hexed("x", 9) + f", {CENTRE} SELECT cell, round(degrees(atan2(z, sqrt(x * x + y * y))), 8) AS lat, round(degrees(atan2(y, x)), 8) AS lng FROM v")
def hex_centres(spark, sf):
    """Centres of the cells that have a ping; the SQL holds for cells that no edge of a face crosses."""
    c = H.with_cell(views.pings(spark, sf), "cell", "lat", "lng", 9).select("cell").distinct()
    return H.with_centre(c, "cell").select("cell", F.round("lat", 8).alias("lat"), F.round("lng", 8).alias("lng"))


@query(hexed("x", 8) + f", y AS (SELECT DISTINCT face, l.i AS i0, l.j AS j0, l.i + d.a AS i, l.j + d.b AS j FROM xl l, (VALUES {', '.join(str(u) for u in H.UNITS)}) d(a, b)), {ids_sql('y', 8, 'yi')} SELECT DISTINCT o.cell, n.cell AS neighbour FROM y JOIN xi o ON o.face = y.face AND o.i = y.i0 AND o.j = y.j0 JOIN yi n ON n.face = y.face AND n.i = y.i AND n.j = y.j")
def hex_neighbours(spark, sf):
    c = H.with_cell(views.pings(spark, sf), "cell", "lat", "lng", 8).select("cell").distinct()
    return c.select("cell", F.explode(H.neighbours("cell", 8)).alias("neighbour"))


def _hex_flows(name: str, side: str = "") -> str:
    return f"SELECT origin, destination, count(*) AS flow FROM (SELECT cell AS origin, lead(cell) OVER (PARTITION BY uid ORDER BY datetime) AS destination FROM {name} {side}) WHERE origin <> destination GROUP BY ALL"


@query(hexed("x", 8) + " " + _hex_flows("x"))
def hex_od_flows(spark, sf):
    return od.flows(views.pings(spark, sf), 8)


@query(
    common("pings").replace("WITH ", "WITH RECURSIVE ", 1) + "".join(_more(f"x{r}", r) + f", s{r} AS ({_hex_flows(f'x{r}', 'WHERE side = 0')}), o{r} AS ({_hex_flows(f'x{r}', 'WHERE side = 1')})" for r in (7, 8, 9)) + " "
    + " UNION ALL ".join(f"SELECT CAST({r} AS INTEGER) AS res, round(2.0 * sum(least(coalesce(s{r}.flow, 0), coalesce(o{r}.flow, 0))) / (sum(coalesce(s{r}.flow, 0)) + sum(coalesce(o{r}.flow, 0))), 9) AS cpc FROM s{r} FULL OUTER JOIN o{r} USING (origin, destination)" for r in (7, 8, 9))
)
def hex_common_part_of_commuters(spark, sf):
    p = views.pings(spark, sf)
    out = None
    for res in (7, 8, 9):
        one = od.common_part(od.flows(p.where("side = 0"), res), od.flows(p.where("side = 1"), res)).select(F.lit(res).alias("res"), F.round("cpc", 9).alias("cpc"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    hexed("x", 8) + """, h AS (SELECT side, cell, hour(datetime) AS hr, count(*) AS n FROM x GROUP BY ALL), v AS (SELECT side, cell, CAST(sum(n) AS BIGINT) AS vol, CAST(arg_min(hr, -n * 100 + hr) AS INTEGER) AS peak FROM h GROUP BY side, cell),
 b AS (SELECT coalesce(s.cell, o.cell) AS cell, coalesce(s.vol, 0) AS syn_volume, coalesce(o.vol, 0) AS obs_volume, coalesce(s.peak, 0) AS syn_peak, coalesce(o.peak, 0) AS obs_peak FROM (SELECT * FROM v WHERE side = 0) s FULL OUTER JOIN (SELECT * FROM v WHERE side = 1) o ON s.cell = o.cell)
 SELECT cell, syn_volume, obs_volume, syn_peak, obs_peak, round((syn_volume - obs_volume) / greatest(obs_volume, 1) * 100.0, 6) AS volume_diff_pct FROM b"""
)
def hex_stvd_difference(spark, sf):
    p = views.pings(spark, sf)
    d = od.hourly_difference(od.hourly(p.where("side = 0"), 8), od.hourly(p.where("side = 1"), 8))
    return d.select("cell", "syn_volume", "obs_volume", "syn_peak", "obs_peak", F.round("volume_diff_pct", 6).alias("volume_diff_pct"))


@query(
    hexed("x", 12) + f""", k AS (SELECT uid, purpose AS kind, cell, count(*) AS n FROM x WHERE purpose <> 'OTHER' GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY uid, kind ORDER BY n DESC, cell) AS r FROM k)
 SELECT kind, {_parent(7)} AS cell, count(*) AS agents FROM m WHERE r = 1 GROUP BY ALL"""
)
def hex_density_explicit(spark, sf):
    return od.density(od.homes(views.pings(spark, sf), "purpose"), 7)


#: Boxes around what groups of users cover, each with a hole, and a fine grid over all of them.
GRID = "grid AS (SELECT y.y / 500.0::DOUBLE AS lat, x.x / 500.0::DOUBLE AS lng FROM range(24350, 24450) y(y), range(1100, 1190) x(x))"


@query(
    common("pings").replace("WITH ", "WITH RECURSIVE ", 1) + f""", b AS (SELECT uid % 5 AS id, min(lng) - 0.013 AS w, max(lng) + 0.011 * (1 + uid % 5) AS e, min(lat) - 0.017 AS s, max(lat) + 0.019 AS n FROM pings GROUP BY uid % 5), {GRID}, {located_sql('grid', 8, 'xl')}, {ids_sql('xl', 8, 'xi')},
 {CENTRE.replace(repr(_M.real), repr((1 / H._complex(*H.scale(8))).real)).replace(repr(_M.imag), repr((1 / H._complex(*H.scale(8))).imag))}, p AS (SELECT cell, degrees(atan2(z, sqrt(x * x + y * y))) AS lat, degrees(atan2(y, x)) AS lng FROM v)
 SELECT id, cell FROM b JOIN p ON lng > w AND lng < e AND lat > s AND lat < n AND NOT (lng > w + 0.02 AND lng < w + 0.05 AND lat > s + 0.02 AND lat < s + 0.04)"""
)
def hex_fill(spark, sf):
    b = views.pings(spark, sf).groupBy((F.col("uid") % 5).alias("id")).agg(F.min("lng").alias("w"), F.max("lng").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n"))
    b = b.select("id", (F.col("w") - 0.013).alias("w"), (F.col("e") + 0.011 * (1 + F.col("id"))).alias("e"), (F.col("s") - 0.017).alias("s"), (F.col("n") + 0.019).alias("n"))
    ring = lambda w, s, e, n: F.array(*[F.struct(x.alias("lng"), y.alias("lat")) for x, y in ((w, s), (e, s), (e, n), (w, n))])
    w, s = F.col("w"), F.col("s")
    shapes = b.select("id", F.array(ring(w, s, F.col("e"), F.col("n")), ring(w + 0.02, s + 0.02, w + 0.05, s + 0.04)).alias("rings"))
    return polygons.fill(shapes, 8)


QUERIES, ORACLE = query.queries, query.oracle
