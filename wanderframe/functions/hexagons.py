"""Hexagonal cells on the sphere as column expressions.

The sphere is projected from its centre onto the twenty faces of an icosahedron.  On a face,
cells of resolution r are points of a lattice of numbers a + b w with w = exp(2 pi i / 3);
those of resolution r + 1 are finer by the root of 7 and turned by 19.1 degrees, one way for
odd resolutions and the other way for even ones, so that dividing by 2 - w or 3 + w leads from
a cell to its parent, and the remainder, zero or one of the six units, is the cell's digit.
Remainders are the classes modulo 7 of a + 2 b or a + 4 b.  The cell of resolution 0 that the
division ends in has one face as its home; digits are turned into that face's directions.
Twelve base cells lie on corners of the icosahedron, where five faces meet instead of six:
their digits skip one direction.

An id has its mode in bits 59 to 62, the resolution in 52 to 55, the base cell in 45 to 51 and
fifteen digits of three bits, unused ones 7.

All tables follow from the centres of the faces.  Expressions are built-in functions
throughout; tables are arrays that the optimizer folds once.
"""

from __future__ import annotations

from cmath import exp as cexp
from collections.abc import Callable
from functools import lru_cache
from math import cos, pi, radians, sin, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geo import c, in_range

FINEST = 15
# Latitude and longitude of the faces' centres in radians; a face and the one
# opposite to it follow from each other, all are given as they are published.
FACES = (
    (0.803582649718989942, 1.248397419617396099), (1.307747883455638156, 2.536945009877921159), (1.054751253523952054, -1.347517358900396623), (0.600191595538186799, -0.450603909469755746),
    (0.491715428198773866, 0.401988202911306943), (0.172745327415618701, 1.678146885280433686), (0.605929321571350690, 2.953923329812411617), (0.427370518328979641, -1.888876200336285401),
    (-0.079066118549212831, -0.733429513380867741), (-0.230961644455383637, 0.506495587332349035), (0.079066118549212831, 2.408163140208925497), (0.230961644455383637, -2.635097066257444203),
    (-0.172745327415618701, -1.463445768309359553), (-0.605929321571350690, -0.187669323777381622), (-0.427370518328979641, 1.252716453253507838), (-0.600191595538186799, 2.690988744120037492),
    (-0.491715428198773866, -2.739604450678486295), (-0.803582649718989942, -1.893195233972397139), (-1.307747883455638156, -0.604647643711872080), (-1.054751253523952054, 1.794075294689396615),
)
# The digit of each direction in steps of 60 degrees from the first axis.
DIGITS = (4, 6, 2, 3, 1, 5)
#: Stages that go into one generated method.
METHOD = 5
#: What stands for no direction.
NONE = 7
W = cexp(2j * pi / 3)
UNITS = ((1, 0), (1, 1), (0, 1), (-1, 0), (-1, -1), (0, -1))
#: Distance of neighbouring base cells on a face, the sphere's radius being one.
STEP = (3 - sqrt(5)) / 2
#: Directions of a face's three edges, each opposite to the corner of the third axis before it.
EDGES = (1, 3, 5)
#: Directions around a corner of five faces in the order of the faces, from the home face on.
AROUND = (3, 5, 0, 1, 2)


def _complex(a: int, b: int) -> complex:
    return a + b * W


def _lattice(z: complex) -> tuple[int, int]:
    """The lattice point at ``z``."""
    b = z.imag / W.imag
    return round(z.real + b / 2), round(b)


@lru_cache
def scale(res: int) -> tuple[int, int]:
    """The product of the steps down to ``res``: lattice coordinates of the unit there."""
    z = 1 + 0j
    for level in range(1, res + 1):
        z *= _complex(2, -1) if level % 2 else _complex(3, 1)
    return _lattice(z)


class Sphere:
    """Faces, their neighbours and base cells, derived from the faces' centres."""

    def __init__(self) -> None:
        self.centre = np.array([[cos(a) * cos(o), cos(a) * sin(o), sin(a)] for a, o in FACES])
        north, south = (v / np.linalg.norm(v) for v in (self.centre[:5].sum(axis=0), self.centre[15:].sum(axis=0)))
        self.x, self.y = np.zeros((20, 3)), np.zeros((20, 3))
        for f in (*range(5), *range(15, 20)):
            self._axis(f, north if f < 5 else south)
        upper = [self.point(f, 2 * W) for f in range(5)]
        for f in range(5, 15):
            ring = upper if f >= 10 else [-v for v in upper]
            self._axis(f, max(ring, key=lambda v: float(v @ self.centre[f])))  # noqa: B023
        corners: list[np.ndarray] = []
        self.corner = np.zeros((20, 3), int)
        for f in range(20):
            for i in range(3):
                self.corner[f, i] = self._same(corners, self.point(f, 2 * W**i))
        self.move = np.zeros((20, 3, 4), int)  # beyond each edge: face, turns, and shift in base cells
        for f in range(20):
            for m in range(3):
                i, j = m, (m + 1) % 3
                g = next(g for g in range(20) if g != f and {self.corner[f, i], self.corner[f, j]} <= set(self.corner[g]))
                there = [list(self.corner[g]).index(self.corner[f, k]) for k in (i, j)]
                u = (W ** there[0] - W ** there[1]) / (W**i - W**j)
                self.move[f, m] = (g, UNITS.index(_lattice(u)), *_lattice(2 * (W ** there[0] - u * W**i)))
        self._bases()

    def _axis(self, f: int, corner: np.ndarray) -> None:
        """Turn a face's first axis to a corner."""
        flat = corner - (corner @ self.centre[f]) * self.centre[f]
        self.x[f] = flat / np.linalg.norm(flat)
        self.y[f] = np.cross(self.centre[f], self.x[f])

    @staticmethod
    def _same(known: list[np.ndarray], v: np.ndarray) -> int:
        """The number of a point, a new one if it is not known."""
        for i, w in enumerate(known):
            if v @ w > 1 - 1e-9:
                return i
        known.append(v)
        return len(known) - 1

    def point(self, f: int, z: complex) -> np.ndarray:
        """The point of the sphere at ``z`` on a face, in base cells from its centre."""
        p = self.centre[f] + STEP * (z.real * self.x[f] + z.imag * self.y[f])
        return p / np.linalg.norm(p)

    def over(self, f: int, z: complex) -> tuple[int, complex, int]:
        """Face, place and turns of what lies at ``z`` in the plane of a face: beyond an edge
        the plane of the face there goes on."""
        for m, e in enumerate(EDGES):
            if (z * UNIT[-e % 6]).real > 1 + 1e-9:
                g, u, a, b = self.move[f, m].tolist()
                return g, UNIT[u] * z + _complex(a, b), u
        return f, z, 0

    def _bases(self) -> None:
        """Base cells, numbered from north to south, with home face and place.

        Those inside a face are at home there.  Of those on an edge the faces around the
        north and those of the third ring have the edge from the first axis to the second at
        home, faces around the north and south that from the second to the third, and faces
        of the second ring and around the south the last.  Corners are at home where the
        first axis leads to them."""
        homes: list[tuple[np.ndarray, int, tuple[int, int]]] = []
        known: list[np.ndarray] = []
        for f in range(20):
            ring = f // 5
            own = [(0, 0), UNITS[0], UNITS[2], UNITS[4]] + [UNITS[e] for e, rings in zip(EDGES, ((0, 2), (0, 3), (1, 3)), strict=True) if ring in rings]
            if f == 0 or f == 19 or ring in (1, 2):
                own.append((2, 0))
            for ab in own:
                p = self.point(f, _complex(*ab))
                assert self._same(known, p) == len(known) - 1 == len(homes), (f, ab)
                homes.append((p, f, ab))
        homes.sort(key=lambda h: -h[0][2])
        self.home = [(f, ab) for _, f, ab in homes]
        self.pentagons = [i for i, (_, ab) in enumerate(self.home) if ab == (2, 0)]
        points = np.array([p for p, _, _ in homes])
        spots = [(a, b) for a in range(-2, 3) for b in range(-2, 3)]
        #: By face and place: the base cell, and by leading direction the turns into its home.
        self.base = np.full((20, 25), -1)
        self.turns = np.zeros((20, 25, 7), int)
        #: By base cell and leading direction: face, place there, and turns into its directions.
        self.decode = np.zeros((122, 7, 4), int)
        for n, (f, (a, b)) in enumerate(self.home):
            self.decode[n, :] = (f, a, b, 0)
        for n in self.pentagons:
            self._corner(n)
        for f in range(20):
            for s, (a, b) in enumerate(spots):
                z = _complex(a, b)
                if abs(z) > 2 + 1e-9:
                    continue
                g, there, u = self.over(f, z)
                n = int(np.argmax(points @ self.point(g, there)))
                self.base[f, s] = n
                if n not in self.pentagons:
                    self.turns[f, s] = self._into(n, g, u)
                else:
                    self.turns[f, s] = self.at_corner[n][f]

    def _into(self, n: int, g: int, u: int) -> int:
        """Turns that lead from the directions of face ``g`` after ``u`` to the home's."""
        home, _ = self.home[n]
        if home == g:
            return u
        return next((u + t) % 6 for h, t, _, _ in self.move[g].tolist() if h == home)

    def _corner(self, n: int) -> None:
        """Tables of a base cell on a corner: its faces in order, and for each leading
        direction which face it leads into, by steps from the face's own direction."""
        home, _ = self.home[n]
        spot = next(i for i in range(3) if self.corner[home, i] == self._number(n))
        number = self.corner[home, spot]
        faces = [f for f in range(20) if number in self.corner[f]]
        p = self.point(home, 2 + 0j)
        east = self.centre[home] - (self.centre[home] @ p) * p
        north = np.cross(p, east)
        faces.sort(key=lambda f: np.arctan2(self.centre[f] @ north, self.centre[f] @ east) % (2 * pi) if f != home else 0.0)
        if not hasattr(self, "at_corner"):
            self.at_corner: dict[int, dict[int, list[int]]] = {}
            self.around: dict[int, list[tuple[int, int]]] = {}
        self.at_corner[n], self.around[n] = {}, []
        for q, f in enumerate(faces):
            i = list(self.corner[f]).index(number)
            inward = (2 * i + 3) % 6
            steps = [(e - inward + 3) % 6 - 3 for e in range(6)]
            self.at_corner[n][f] = [(AROUND[(q + d) % 5] - e) % 6 for e, d in enumerate(steps)] + [0]
            self.around[n].append((f, i))
            a, b = (2 * x for x in UNITS[2 * i])
            self.decode[n, AROUND[q]] = (f, a, b, (inward - AROUND[q]) % 6)

    def _number(self, n: int) -> int:
        f, _ = self.home[n]
        return int(self.corner[f, 0])


UNIT = [_complex(*u) for u in UNITS]


@lru_cache
def sphere() -> Sphere:
    return Sphere()


def table(values, kind: str = "int") -> Column:
    """A constant array; one literal, so that large tables cost one call."""
    return F.split(F.lit(",".join(map(repr, np.asarray(values).ravel().tolist()))), ",").cast(f"array<{kind}>")


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def at(array: Column, i: Column) -> Column:
    return F.get(array, i.cast("int"))


Env = Callable[[str], Column]
Stage = Callable[[Env], dict[str, Column]]


def chained(start: dict[str, Column], stages: list[Stage], last: Callable[[Env], Column]) -> Column:
    """``last`` of the values that the stages make one after another, as one expression: each
    stage's values are computed once, in a struct that the next one takes."""
    made = F.struct(*[v.alias(k) for k, v in start.items()])
    for stage in stages:
        made = let(made, lambda x: F.struct(*[v.alias(k) for k, v in stage(x.getField).items()]))  # noqa: B023
    return let(made, lambda x: last(x.getField))


def projected(df: DataFrame, name: str, start: dict[str, Column], stages: list[Stage], last: Callable[[Env], Column]) -> DataFrame:
    """``df`` with ``name``: as :func:`chained`, a projection for each stage, which generated
    code runs several times faster than one nested expression.

    The JVM does not compile methods beyond 8,000 bytes, which a generated one for all stages
    is; a lambda ends it, so one value of every few stages passes through one."""
    kept = [F.col(f"`{c}`") for c in df.columns if c != name]
    env: Env = lambda k: F.col(f"__{k}")
    out = df.select("*", *[v.alias(f"__{k}") for k, v in start.items()])
    for i, stage in enumerate(stages, 1):
        made = stage(env)
        if i % METHOD == 0:
            k = next(iter(made))
            made[k] = let(made[k], lambda x: x)
        out = out.select(*kept, *[v.alias(f"__{k}") for k, v in made.items()])
    # a generator of one row: no filter or join key is traced, and so written out, through the stages
    return out.select(*kept, F.stack(F.lit(1), last(env)).alias(name))


def _packed(values: list[int], bits: int, i: Column, low: int = 0) -> Column:
    """The ``i``-th of a few small numbers, cut out of one constant: no array, never null."""
    word = sum(v - low << bits * k for k, v in enumerate(values))
    cut = F.call_function("shiftright", F.lit(word).cast("long"), (i * bits).cast("int")).bitwiseAND((1 << bits) - 1).cast("int")
    return cut + low if low else cut


def _by_parity(of: Callable[[int], Column], odd: int | Column) -> Column:
    """A value that depends on a level's parity, which may be known or a column."""
    return of(odd) if isinstance(odd, int) else F.when(odd == 1, of(1)).otherwise(of(0))


def _remainders(odd: int) -> list[int]:
    """By class modulo 7 the direction that dividing a lattice point leaves over."""
    by = [NONE] * 7
    for e, (x, y) in enumerate(UNITS):
        by[(x + (4 - 2 * odd) * y) % 7] = e
    return by


def _up(a: Column, b: Column, t: Column, odd: int | Column) -> tuple[Column, Column, Column]:
    """The parent of a lattice point of class ``t``, and the direction left over.

    Coordinates are whole doubles below 2 ** 53."""
    units = lambda o: [UNITS[e] if e != NONE else (0, 0) for e in _remainders(o)]
    over = lambda i: _by_parity(lambda o: _packed([(2 + o) * x + (1 - 2 * o) * y if i == 0 else (2 * o - 1) * x + (3 - o) * y for x, y in units(o)], 4, t, -8), odd)
    return F.rint(((2 + odd) * a + (1 - 2 * odd) * b - over(0)) * (1 / 7)), F.rint(((2 * odd - 1) * a + (3 - odd) * b - over(1)) * (1 / 7)), _by_parity(lambda o: _packed(_remainders(o), 3, t), odd)


def _class(a: Column, b: Column, odd: int | Column) -> Column:
    x = a + (4 - 2 * odd) * b
    return (x - 7 * F.floor(x * (1 / 7) + 1e-9)).cast("int")


def _encoding(res: int, columns: bool) -> tuple[list[Stage], Callable[[Env], Column]]:
    """Stages from (face, a, b), a lattice point of resolution ``res``, to its cell; with
    ``columns`` a stage or two for each level, else one fold over the levels."""
    s = sphere()
    long = lambda x: x.cast("long")
    stages: list[Stage] = [lambda env: {"face": env("face"), "a": env("a").cast("double"), "b": env("b").cast("double"), "lead": F.lit(6), "w": F.lit(0).cast("long")}]
    shift = lambda level: 3 * (FINEST - level)

    def risen(env: Env, t: Column, odd: int | Column, by: int | Column) -> dict[str, Column]:
        a, b, e = _up(env("a"), env("b"), t, odd)
        return {"a": a, "b": b, "w": env("w") + F.call_function("shiftleft", long(e), by if isinstance(by, Column) else F.lit(by)), "lead": F.when(e == NONE, env("lead")).otherwise(e)}

    if columns:
        for level in range(res, 0, -1):
            stages.append(lambda env, o=level % 2, by=shift(level): {"face": env("face")} | risen(env, _class(env("a"), env("b"), o), o, by))
    elif res:

        def fold(env: Env) -> dict[str, Column]:
            start = F.struct(*[env(k).alias(k) for k in ("a", "b", "w", "lead")])
            step = lambda acc, level: let(_class(acc.a, acc.b, level % 2), lambda t: F.struct(*[v.alias(k) for k, v in risen(acc.getField, t, level % 2, shift(level).cast("int")).items()]))
            return {"face": env("face"), "r": F.aggregate(F.array(*[F.lit(x) for x in range(res, 0, -1)]), start, step)}

        stages += [fold, lambda env: {"face": env("face")} | {k: env("r").getField(k) for k in ("a", "b", "w", "lead")}]
    stages += [
        lambda env: {"w": env("w"), "lead": env("lead"), "spot": (env("face") * 25 + (env("a") + 2) * 5 + env("b") + 2).cast("int")},
        lambda env: {"w": env("w"), "base": F.coalesce(at(table(s.base), env("spot")), F.lit(0)), "turn": F.coalesce(at(table(s.turns), env("spot") * 7 + env("lead")), F.lit(0))},
    ]

    def whole(env: Env) -> Column:
        h = F.lit(1 << 59 | res << 52 | (1 << 3 * (FINEST - res)) - 1) + F.shiftleft(long(env("base")), 45)
        for level in range(1, res + 1):
            e = F.shiftright(env("w"), shift(level)).bitwiseAND(7).cast("int")
            h = h + F.shiftleft(long(F.when(e == NONE, 0).otherwise(_packed([*DIGITS, *DIGITS], 3, e + env("turn")))), shift(level))
        return h

    return stages, whole


def _encoded(face: Column, a: Column, b: Column, res: int) -> Column:
    """The cell of resolution ``res`` at a lattice point of a face's plane."""
    return chained({"face": face, "a": a, "b": b}, *_encoding(res, columns=False))


def _locating(lat, lng, res: int, columns: bool) -> tuple[dict[str, Column], list[Stage], Callable[[Env], Column]]:
    """Stages from a point to its cell: the face with the nearest centre, the place on it, the
    nearest lattice point.  Of the three coordinates that sum up to zero the one that rounding
    moves most follows from the others."""
    s = sphere()
    phi, lam = F.radians(c(lat).cast("double")), F.radians(c(lng).cast("double"))
    centres = [list(map(float, v)) for v in s.centre]
    m = _complex(*scale(res)) / STEP
    axis = lambda env, of: F.coalesce(sum((env(x) * at(table(of[:, i], "double"), env("face")) for i, x in enumerate("xyz")), F.lit(0.0)) / env("best"), F.lit(0.0))
    xyz = lambda env: {k: env(k) for k in "xyz"}
    stages: list[Stage] = [
        lambda env: xyz(env) | {"dots": F.array(*[env("x") * x + env("y") * y + env("z") * z for x, y, z in centres])},
        lambda env: xyz(env) | {"best": F.array_max(env("dots")), "face": F.array_position(env("dots"), F.array_max(env("dots"))).cast("int") - 1},
        lambda env: {"face": env("face"), "p": axis(env, s.x), "q": axis(env, s.y)},
        lambda env: {"face": env("face"), "b": (env("p") * m.imag + env("q") * m.real) / W.imag, "a": env("p") * m.real - env("q") * m.imag + (env("p") * m.imag + env("q") * m.real) / W.imag / 2},
        lambda env: {k: env(k) for k in ("face", "a", "b")} | {"q": F.rint(env("a") - env("b")), "r": F.rint(env("b")), "s": F.rint(-env("a"))},
        lambda env: {k: env(k) for k in ("face", "q", "r", "s")} | {"dq": F.abs(env("q") - env("a") + env("b")), "dr": F.abs(env("r") - env("b")), "ds": F.abs(env("s") + env("a"))},
        lambda env: {"face": env("face"), "q": F.when((env("dq") > env("dr")) & (env("dq") > env("ds")), -env("r") - env("s")).otherwise(env("q")), "b": F.when((env("dr") >= env("dq")) & (env("dr") > env("ds")), -env("q") - env("s")).otherwise(env("r"))},
        lambda env: {"face": env("face"), "a": env("q") + env("b"), "b": env("b")},
    ]
    more, last = _encoding(res, columns)
    # unknown points go the same way as one known, so that no stage has to look for nulls
    start = {"x": F.cos(phi) * F.cos(lam), "y": F.cos(phi) * F.sin(lam), "z": F.sin(phi)}
    return {k: F.when(in_range(lat, lng), v).otherwise(float(k == "x")) for k, v in start.items()}, stages + more, last


def cell(lat, lng, res: int) -> Column:
    """The id of the cell of resolution ``res`` (0 to 15) that holds a point, as a long.

    Null where a coordinate is null, not a number or out of range.  For whole tables
    :func:`with_cell` is faster."""
    return F.when(in_range(lat, lng), chained(*_locating(lat, lng, res, columns=False)))


def with_cell(df: DataFrame, name: str, lat, lng, res: int) -> DataFrame:
    """``df`` with ``name``, the cell of a point as :func:`cell` says."""
    start, stages, last = _locating(lat, lng, res, columns=True)
    keep = lambda f: lambda env: f(env) | {"known": env("known")}
    return projected(df, name, start | {"known": in_range(lat, lng) & c(lat).isNotNull() & c(lng).isNotNull()}, [keep(f) for f in stages], lambda env: F.when(env("known"), last(env)))


def resolution(h) -> Column:
    return F.shiftright(c(h), 52).bitwiseAND(15).cast("int")


def base_cell(h) -> Column:
    return F.shiftright(c(h), 45).bitwiseAND(127).cast("int")


def parent(h, res: int) -> Column:
    """The cell of a coarser resolution that this one's digits lead through."""
    kept = ~(15 << 52 | (1 << 3 * (FINEST - res)) - 1)
    return c(h).bitwiseAND(F.lit(kept)).bitwiseOR(F.lit(res << 52 | (1 << 3 * (FINEST - res)) - 1))


def _digit(h: Column, level: Column) -> Column:
    return F.call_function("shiftright", h, (FINEST - level) * 3).bitwiseAND(7).cast("int")


def _levels(h: Column) -> Column:
    return F.slice(F.array(*[F.lit(x) for x in range(1, FINEST + 1)]), F.lit(1), resolution(h))


def _lead(h: Column) -> Column:
    """Direction of the first digit that is not zero, 6 if there is none."""
    first = F.filter(F.transform(_levels(h), lambda x: _digit(h, x)), lambda d: d > 0)
    return F.coalesce(at(table([6, *(DIGITS.index(d) for d in range(1, 7)), 6]), F.get(first, F.lit(0))), F.lit(6))


def is_pentagon(h) -> Column:
    return base_cell(h).isin(sphere().pentagons) & (_lead(c(h)) == 6)


def children(h) -> Column:
    """The cells of the next resolution whose parent this is: seven, six of a pentagon."""
    res = resolution(h)
    shift = (FINEST - 1 - res) * 3
    first = c(h) + F.lit(1 << 52) - F.call_function("shiftleft", F.lit(7).cast("long"), shift)
    digits = F.array(*[F.lit(d).cast("long") for d in range(7)])
    return F.transform(F.filter(digits, lambda d: (d != 1) | ~is_pentagon(h)), lambda d: first + F.call_function("shiftleft", d, shift))


def _placing(h: Column, res: int, columns: bool) -> tuple[dict[str, Column], list[Stage]]:
    """Stages to (f, a, b, x, y): a cell's place on a face that it lies on, as a lattice point
    of resolution ``res`` and in base cells.

    ``res`` is at least the cell's: unused digits count as zero, which is its centre."""
    s = sphere()
    inverse = 1 / _complex(*scale(res))
    root = [table(s.decode[:, :, i]) for i in range(4)]
    units = [*UNITS, (0, 0)]

    def down(acc: Env, d: Column, turn: Column, odd: int | Column) -> dict[str, Column]:
        e = _packed([6, *(DIGITS.index(x) for x in range(1, 7)), 6], 3, d)
        own = F.when(e == 6, 6).otherwise((e + turn) % 6)
        p, q = (_packed([u[i] + 1 for u in units], 2, own) - 1 for i in (0, 1))
        return {"a": (3 - odd) * acc("a") + (2 * odd - 1) * acc("b") + p, "b": (1 - 2 * odd) * acc("a") + (2 + odd) * acc("b") + q}

    digits = [F.shiftright(h, 3 * (FINEST - k)).bitwiseAND(7).cast("int") for k in range(1, res + 1)]

    def first_direction() -> Column:
        return F.coalesce(*[F.when((d != 0) & (d != 7), _packed([6, *(DIGITS.index(x) for x in range(1, 7)), 6], 3, d)) for d in digits], F.lit(6))

    def rooted(env: Env) -> dict[str, Column]:
        f, a, b, turn = (F.coalesce(at(t, env("spot")), F.lit(0)) for t in root)
        return {"f": f, "a": a.cast("double"), "b": b.cast("double"), "turn": turn}

    if columns:
        descent: list[Stage] = [lambda env, k=k: {"f": env("f"), "turn": env("turn")} | down(env, digits[k], env("turn"), (k + 1) % 2) for k in range(res)]
    else:

        def fold(env: Env) -> dict[str, Column]:
            levels = F.array(*[F.struct(F.lit((k + 1) % 2).alias("odd"), d.alias("d")) for k, d in enumerate(digits)])
            step = lambda acc, x: F.struct(*[v.alias(k) for k, v in down(acc.getField, x.d, acc.turn, x.odd).items()], acc.turn.alias("turn"))
            return {"f": env("f"), "r": F.aggregate(levels, F.struct(env("a").alias("a"), env("b").alias("b"), env("turn").alias("turn")), step)}

        descent = [fold, lambda env: {"f": env("f"), "a": env("r").a, "b": env("r").b}] if res else []

    def in_bases(env: Env) -> dict[str, Column]:
        p, q = env("a") - env("b") / 2, env("b") * W.imag
        return {k: env(k) for k in ("f", "a", "b")} | {"x": p * inverse.real - q * inverse.imag, "y": p * inverse.imag + q * inverse.real}

    stages: list[Stage] = [rooted, *descent, in_bases, *_folding(scale(res)) * 2]
    return {"spot": base_cell(h) * 7 + first_direction()}, stages


def _placed(h: Column, then, res: int = FINEST) -> Column:
    """``then`` of the struct that :func:`_placing` leads to."""
    start, stages = _placing(h, res, columns=False)
    return chained(start, stages, lambda env: let(F.struct(*[env(k).alias(k) for k in "fabxy"]), then))


def _folding(unit: tuple[int, int]) -> list[Stage]:
    """Stages that put what lies over an edge of its face onto the face beyond it; ``unit`` is
    a base cell's step in lattice coordinates."""
    s = sphere()
    moves = [table(s.move[:, :, i]) for i in range(4)]
    ux, uy = table([z.real for z in UNIT], "double"), table([z.imag for z in UNIT], "double")
    ua, ub = (table([u[i] for u in UNITS]) for i in (0, 1))
    wa, wb = unit
    keep = lambda env: {k: env(k) for k in "fabxy"}

    def measured(env: Env) -> dict[str, Column]:
        return keep(env) | {"reach": F.array(*[env("x") * cos(pi / 3 * e) + env("y") * sin(pi / 3 * e) for e in EDGES])}

    def edged(env: Env) -> dict[str, Column]:
        far = F.array_max(env("reach"))
        return keep(env) | {"edge": F.when(far > 1 + 1e-9, env("f") * 3 + F.array_position(env("reach"), far).cast("int") - 1)}

    def moved(env: Env) -> dict[str, Column]:
        over = env("edge").isNotNull()
        g, u, ta, tb = (F.coalesce(at(m, env("edge")), F.lit(0)) for m in moves)
        a, b, x, y = (env(k) for k in "abxy")
        va, vb, vx, vy = (F.coalesce(at(t, u), F.lit(0)) for t in (ua, ub, ux, uy))
        new = {"f": g, "a": va * a - vb * b + ta * wa - tb * wb, "b": va * b + vb * a - vb * b + ta * wb + tb * wa - tb * wb, "x": vx * x - vy * y + (ta - tb / 2), "y": vx * y + vy * x + tb * W.imag}
        return {k: F.when(over, v).otherwise(env(k)) for k, v in new.items()}

    return [measured, edged, moved]


def _on_sphere(f: Column, x: Column, y: Column) -> Column:
    """Struct of latitude and longitude in degrees of a place on a face's plane, which beyond
    an edge goes on on the face there."""
    s = sphere()
    axes = [[table(m[:, i], "double") for i in range(3)] for m in (s.centre, s.x, s.y)]
    p = F.struct(*[(at(axes[0][i], f) + STEP * (x * at(axes[1][i], f) + y * at(axes[2][i], f))).alias("xyz"[i]) for i in range(3)])
    return let(p, lambda v: F.struct(F.degrees(F.atan2(v.z, F.sqrt(v.x * v.x + v.y * v.y))).alias("lat"), F.degrees(F.atan2(v.y, v.x)).alias("lng")))


def centre(h) -> Column:
    """Struct of latitude and longitude of a cell's centre; null of null."""
    h = c(h)
    return F.when(h.isNotNull(), _placed(h, lambda z: _on_sphere(z.f, z.x, z.y)))


def with_centre(df: DataFrame, h: str, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """``df`` with the latitude and longitude of a cell's centre, null of null; faster than
    :func:`centre` for whole tables."""
    start, stages = _placing(F.coalesce(c(h), F.lit(0).cast("long")), FINEST, columns=True)
    s = sphere()
    axes = [[table(m[:, i], "double") for i in range(3)] for m in (s.centre, s.x, s.y)]
    on = [lambda env: {k: F.coalesce(at(axes[0][i], env("f")) + STEP * (env("x") * at(axes[1][i], env("f")) + env("y") * at(axes[2][i], env("f"))), F.lit(0.0)) for i, k in enumerate("pqr")}]
    known = F.col(f"`{h}`").isNotNull()
    at_ = lambda env: F.when(known, F.struct(F.degrees(F.atan2(env("r"), F.sqrt(env("p") * env("p") + env("q") * env("q")))).alias("lat"), F.degrees(F.atan2(env("q"), env("p"))).alias("lng")))
    return projected(df, "__centre", start, [*stages, *on], at_).withColumns({lat: F.col("__centre.lat"), lng: F.col("__centre.lng")}).drop("__centre")


def cell_centre(h) -> tuple[Column, Column]:
    """Latitude and longitude of a cell's centre."""
    at_ = centre(h)
    return at_.getField("lat"), at_.getField("lng")


def _corners(res: int) -> list[complex]:
    """A cell's corners about its centre, in base cells."""
    return [(UNIT[k] + UNIT[(k + 1) % 6]) / 3 / _complex(*scale(res)) for k in range(6)]


def _beyond(f: Column, x: Column, y: Column) -> Column:
    """Latitude and longitude of a place that may lie beyond an edge of the face."""
    s = sphere()
    moves = [table(s.move[:, :, i]) for i in range(4)]
    ux, uy = table([z.real for z in UNIT], "double"), table([z.imag for z in UNIT], "double")
    reach = F.array(*[x * cos(pi / 3 * e) + y * sin(pi / 3 * e) for e in EDGES])

    def moved(spot: Column) -> Column:
        u, ta, tb = (at(m, spot) for m in moves[1:])
        return _on_sphere(at(moves[0], spot), at(ux, u) * x - at(uy, u) * y + (ta - tb / 2), at(ux, u) * y + at(uy, u) * x + tb * W.imag)

    return let(reach, lambda r: F.when(F.array_max(r) <= 1 + 1e-9, _on_sphere(f, x, y)).otherwise(let(f * 3 + F.array_position(r, F.array_max(r)).cast("int") - 1, moved)))


@lru_cache
def _pentagon(res: int) -> list[complex]:
    """Places of a pentagon's boundary within one face, about the corner, the first axis
    leading to the face's centre: a corner of the cell, and at odd resolutions the crossing
    of the edge before it."""
    corners = sorted(_corners(res), key=lambda z: abs(np.angle(z * cexp(1e-6j))))
    if res % 2 == 0:
        return [min(corners, key=lambda z: abs(np.angle(z) + pi / 6))]
    own = next(z for z in corners if -pi / 6 <= np.angle(z) < pi / 6)
    edge, before = cexp(-1j * pi / 6), own * cexp(-1j * pi / 3)
    # where the side from the corner before to this one meets the edge
    p, d = before / edge, (own - before) / edge
    return [(p - d * p.imag / d.imag).real * edge, own]


def boundary(h) -> Column:
    """Array of (lat, lng) structs around a cell, counter-clockwise, open: its corners, and at
    odd resolutions the points where its sides cross an edge of a face."""
    s = sphere()
    h = c(h)
    res = resolution(h)
    offsets = [_corners(r) for r in range(FINEST + 1)]
    ox, oy = (table([[getattr(z, p) for z in r] for r in offsets], "double") for p in ("real", "imag"))
    around = {n: [(f, 2 * W**i, np.exp(1j * pi / 3 * ((2 * i + 3) % 6))) for f, i in s.around[n]] for n in s.pentagons}

    def hexagon(z: Column) -> Column:
        reach = lambda x, y: F.greatest(*[x * cos(pi / 3 * e) + y * sin(pi / 3 * e) for e in EDGES])
        spots = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: let(F.struct((z.x + at(ox, res * 6 + k)).alias("x"), (z.y + at(oy, res * 6 + k)).alias("y")), lambda v: F.struct(v.x.alias("x"), v.y.alias("y"), reach(v.x, v.y).alias("r"))))

        def side(v: Column, w: Column) -> Column:
            """A corner, and before the next one the crossing of an edge, if any."""
            here = _beyond(z.f, v.x, v.y)
            out = F.when(v.r > w.r, v).otherwise(w)
            mine = lambda q, e: q.x * cos(pi / 3 * e) + q.y * sin(pi / 3 * e)
            far = F.array(*[mine(out, e) for e in EDGES])

            def crossed(which: Column) -> Column:
                a = F.array(*[mine(v, e) for e in EDGES])
                b = F.array(*[mine(w, e) for e in EDGES])
                t = (1 - at(a, which)) / (at(b, which) - at(a, which))
                return let(t, lambda t: F.array(here, _on_sphere(z.f, v.x + t * (w.x - v.x), v.y + t * (w.y - v.y))))

            crosses = (res % 2 == 1) & (((v.r > 1 + 1e-9) & (w.r < 1 - 1e-9)) | ((v.r < 1 - 1e-9) & (w.r > 1 + 1e-9)))
            return F.when(crosses, let(F.array_position(far, F.array_max(far)).cast("int") - 1, crossed)).otherwise(F.array(here))

        return let(spots, lambda p: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: side(F.get(p, k), F.get(p, (k + 1) % 6)))))

    rings = F.lit(None)
    for n in s.pentagons:
        pieces = [[(f, v + o * u) for f, v, u in around[n] for o in _pentagon(r)] for r in range(FINEST + 1)]
        wide = 10
        flat = [p + [(0, 0j)] * (wide - len(p)) for p in pieces]
        fs, xs, ys = table([[f for f, _ in p] for p in flat]), table([[z.real for _, z in p] for p in flat], "double"), table([[z.imag for _, z in p] for p in flat], "double")
        ring = F.transform(F.slice(F.sequence(F.lit(0), F.lit(9)), F.lit(1), F.when(res % 2 == 1, 10).otherwise(5)), lambda k: _on_sphere(at(fs, res * wide + k), at(xs, res * wide + k), at(ys, res * wide + k)))  # noqa: B023
        rings = F.when(base_cell(h) == n, ring).otherwise(rings)
    return F.when(h.isNotNull(), F.when(is_pentagon(h), rings).otherwise(_placed(h, hexagon)))


def cell_ring(h) -> Column:
    """The closed boundary of a cell as (lng, lat) pairs, counter-clockwise."""
    pairs = lambda b: F.transform(b, lambda p: F.array(F.round(p.lng, 9), F.round(p.lat, 9)))
    return let(pairs(boundary(h)), lambda p: F.concat(p, F.slice(p, 1, 1)))


def neighbours(h, res: int) -> Column:
    """The cells of resolution ``res`` that share a side with this one of it: six, five of a
    pentagon."""
    s = sphere()
    h = c(h)
    ua, ub = (table([u[i] for u in UNITS]) for i in (0, 1))
    six = _placed(h, lambda z: F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: _encoded(z.f, z.a + at(ua, k), z.b + at(ub, k), res)), res)
    if res:
        five = F.array(*[h + (d << 3 * (FINEST - res)) for d in range(2, 7)])
    else:
        by = {n: sorted({int(s.base[f, (2 * UNITS[2 * i][0] - UNITS[2 * i][0] + 2) * 5 + 2 * UNITS[2 * i][1] - UNITS[2 * i][1] + 2]) for f, i in s.around[n]}) for n in s.pentagons}
        flat = table([by.get(n, [0] * 5) for n in range(122)])
        five = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.lit(1 << 59 | (1 << 45) - 1) + F.shiftleft(at(flat, base_cell(h) * 5 + k).cast("long"), 45))
    return F.when(h.isNotNull(), F.when(is_pentagon(h), five).otherwise(six))


def cell_disk(h, k: int, res: int) -> Column:
    """The cells at most ``k`` steps away, itself included, each once, for cells of
    resolution ``res``."""
    wider = lambda r, _: F.array_distinct(F.concat(r, F.flatten(F.transform(r, lambda x: neighbours(x, res)))))
    steps = F.array(*[F.lit(i) for i in range(k)]).cast("array<int>")
    return F.when(c(h).isNotNull(), F.aggregate(steps, F.array(c(h)), wider))


def cell_hex(h) -> Column:
    return F.lower(F.hex(c(h)))


#: Names that the grid of equal angles has too, so that operators take either.
cell_resolution, cell_parent = resolution, parent
