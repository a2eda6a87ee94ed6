"""Sources, sinks, derived artefacts and the metadata of runs."""

from __future__ import annotations

import hashlib
import json
import re
import threading
from collections.abc import Callable, Iterable
from io import BytesIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.scalar import content_key
from .schema import TrajSchema, canonical, require
from .work import dense_ranks, hadoop

STAMP = re.compile(r"^(?P<stem>.+)_(?P<stamp>\d{8}T\d{6})\.parquet$")


def trajectories(spark: SparkSession, path: str) -> DataFrame:
    """A trajectory table with canonical columns; fails if a role has no column."""
    return canonical(spark.read.parquet(path))


def parquet(spark: SparkSession, path: str, required: Iterable[str] = (), columns: Iterable[str] | None = None) -> DataFrame:
    """A lazy scan with a check of its columns and, if given, a projection."""
    df = spark.read.parquet(path)
    require(df, *required, *(columns or ()))
    return df.select(*columns) if columns else df


def csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """CSV, gzipped or not, with a declared schema."""
    return spark.read.schema(schema).option("header", header).csv(path)


def stata(spark: SparkSession, path: str) -> DataFrame:
    """A Stata file, from any file system that Spark reads, parsed on the driver: the format
    cannot be split, and one file is one array there.  Large ones belong in Parquet first."""
    raw = spark.read.format("binaryFile").load(path).select("content").first()[0]
    return spark.createDataFrame(pd.read_stata(BytesIO(raw), convert_categoricals=False))


def social_network(spark: SparkSession, path: str, visible: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, x, y, size, uid) and edges (u, v, weight) of a network file.

    Counts in the file must match its lists, the first rows must have their shape, and only
    the first ``visible`` nodes and the edges among them are given."""
    rows = spark.read.option("multiLine", True).schema("nodes array<array<string>>, edges array<array<string>>, degrees array<bigint>, node_count bigint, edge_count bigint").json(path)
    sizes = rows.select(F.size("nodes"), "node_count", F.size("edges"), "edge_count", F.size("degrees"), F.expr("forall(slice(nodes, 1, 10), n -> size(n) >= 4)"), F.expr("forall(slice(edges, 1, 10), e -> size(e) >= 3)")).first()
    if sizes is None or sizes[0] != sizes[1] or sizes[2] != sizes[3] or sizes[4] not in (None, -1, sizes[0]) or not sizes[5] or not sizes[6]:
        raise ValueError(f"network file {path} contradicts itself")
    nodes = rows.select(F.posexplode("nodes")).select(F.col("pos").cast("long").alias("id"), *[F.get("col", F.lit(i)).cast("double").alias(n) for i, n in enumerate(("x", "y", "size"))], F.get("col", F.lit(3)).alias("uid"))
    edges = rows.select(F.explode("edges").alias("e")).select(*[F.get("e", F.lit(i)).cast("double").cast("long").alias(n) for i, n in enumerate(("u", "v"))], F.get("e", F.lit(2)).cast("double").alias("weight"))
    return nodes.where(F.col("id") < visible), edges.where((F.col("u") < visible) & (F.col("v") < visible))


def missing_keys(wanted: DataFrame, cached: DataFrame, fields: list[str], key: str = "cache_key") -> DataFrame:
    """Rows whose content key is not in the cache yet."""
    return wanted.withColumn(key, content_key(*fields)).join(cached.select(key), key, "left_anti")


def in_box(df: DataFrame, west: float, south: float, east: float, north: float, bbox: str = "bbox") -> DataFrame:
    """Rows of a geo table whose bounding-box struct meets the box; reaches the scan as filters."""
    return df.where((F.col(f"{bbox}.xmin") <= east) & (F.col(f"{bbox}.xmax") >= west) & (F.col(f"{bbox}.ymin") <= north) & (F.col(f"{bbox}.ymax") >= south))


def geo_parquet(spark: SparkSession, path: str, box: tuple[float, float, float, float], columns: Iterable[str] = (), bbox: str = "bbox", **partitions: str) -> DataFrame:
    """Rows of a hive-partitioned geo table, local or remote, that meet (west, south, east,
    north), with the partitions named: both prune what is read."""
    df = in_box(spark.read.parquet(path), *box, bbox=bbox)
    for name, value in partitions.items():
        df = df.where(F.col(name) == value)
    return df.select(*columns) if columns else df


def schema_rows(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


def write_sorted(df: DataFrame, path: str, keys: list[str], mode: str = "overwrite") -> None:
    """One directory of Parquet, partitioned by the first key's range and sorted by all."""
    df.repartitionByRange(*keys[:1]).sortWithinPartitions(*keys).write.mode(mode).parquet(path)


def append_days(df: DataFrame, path: str, ts: str = "datetime") -> bool:
    """Append to a table partitioned by day; an empty chunk writes nothing."""
    if df.isEmpty():
        return False
    df.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").parquet(path)
    return True


def metrics_json(rows: DataFrame, by: list[str], value: str, path: str | None = None) -> dict:
    """Nested dictionary of a small metric table; written as JSON if a path is given."""
    out: dict = {}
    for r in rows.collect():
        at = out
        for k in by[:-1]:
            at = at.setdefault(r[k], {})
        at[r[by[-1]]] = r[value]
    if path:
        fs, p = hadoop(rows.sparkSession, path)
        sink = fs.create(p, True)
        try:
            sink.write(bytearray(json.dumps(out, indent=1, default=str).encode()))
        finally:
            sink.close()
    return out


def features(cells: DataFrame, h: str = "cell") -> DataFrame:
    """GeoJSON features of cells, one text a row, with the other columns as properties."""
    properties = F.struct(*[c for c in cells.columns if c != h], geo.cell_hex(h).alias("cell"))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(geo.cell_ring(h)).alias("coordinates"))
    return cells.select(h, F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))).alias("feature"))


def first_users(df: DataFrame, n: int, uid: str = "uid") -> DataFrame:
    """All rows of the first n distinct users."""
    few = df.select(uid).distinct().orderBy(uid).limit(n)
    return df.join(F.broadcast(few), uid, "left_semi")


def split_users(df: DataFrame, seed: str, uid: str = "uid") -> tuple[DataFrame, DataFrame]:
    """Two halves of the population by a seeded order of its ids."""
    ids = df.select(uid).distinct().withColumn("__key", F.md5(F.concat_ws("|", F.lit(seed), F.col(uid).cast("string"))))
    ranked = dense_ranks(ids, ["__key", uid], "__rank")
    middle = (ranked.count() + 1) // 2
    return tuple(df.join(ranked.where(half), uid, "left_semi") for half in (F.col("__rank") < middle, F.col("__rank") >= middle))


def discover_runs(spark: SparkSession, folder: str, stem: str) -> list[tuple[str, str]]:
    """(stamp, path) of the runs of a stem, newest first, found through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{folder}/{stem}_*.parquet")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
    runs = [(m["stamp"], str(s.getPath().toString())) for s in found if (m := STAMP.match(s.getPath().getName())) and m["stem"] == stem]
    return sorted(runs, reverse=True)


def run_summary(df: DataFrame, schema: TrajSchema | None = None) -> DataFrame:
    """One row: n_rows, n_users, first and last time."""
    t = canonical(df, schema)
    return t.agg(F.count("*").alias("n_rows"), F.countDistinct("uid").alias("n_users"), F.min("datetime").cast("string").alias("first"), F.max("datetime").cast("string").alias("last"))


def derived(spark: SparkSession, folder: str, name: str, key_parts: Iterable, build: Callable[[], DataFrame], inputs: Iterable[str] = ()) -> DataFrame:
    """A derived table kept under a key of its parts and of the times its input files last
    changed; built when it is not there yet."""
    key = hashlib.sha256("\0".join(map(str, [*key_parts, *(changed(spark, p) for p in inputs)])).encode()).hexdigest()[:24]
    path = f"{folder}/{name}-{key}.parquet"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


class PayloadCache:
    """JSON payloads under a key of their inputs, built once however many ask at a time.

    The key covers a version, the name and the parts; give file names with their times of
    change as parts (:func:`changed`).  A payload that ``stale`` calls so is built anew."""

    def __init__(self, spark: SparkSession, folder: str, version: str = "1", stale: Callable[[dict], bool] = lambda p: False):
        self.spark, self.folder, self.version, self.stale = spark, folder, version, stale
        self.locks: dict[str, threading.Lock] = {}
        self.guard = threading.Lock()

    def get(self, name: str, parts: Iterable, build: Callable[[], dict]) -> dict:
        key = hashlib.sha256("\0".join(map(str, [self.version, name, *parts])).encode()).hexdigest()[:24]
        with self.guard:
            lock = self.locks.setdefault(key, threading.Lock())
        with lock:  # who comes while another builds waits for that result
            fs, path = hadoop(self.spark, f"{self.folder}/{name}-{key}.json")
            if fs.exists(path):
                found = json.loads(self.spark.read.text(path.toString(), wholetext=True).first()[0])
                if not self.stale(found):
                    return found
            payload = build()
            sink = fs.create(path, True)
            try:
                sink.write(bytearray(json.dumps(payload, default=str).encode()))
            finally:
                sink.close()
            return payload


def changed(spark: SparkSession, path: str) -> str:
    """A path with the time it was last changed, for the keys of caches."""
    fs, p = hadoop(spark, path)
    return f"{path}@{fs.getFileStatus(p).getModificationTime()}"


def wkb_centroid(df: DataFrame, geometry: str) -> tuple[Column, Column]:
    """(lng, lat) of the centroids of well-known binary geometries: points, lines by their
    length, polygons by their area, and collections of one kind; null for what it cannot read.

    The binary is walked in Arrow batches: no built-in function reads it."""

    @F.pandas_udf("lng double, lat double")
    def centre(shapes: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([wkb_centre(x) for x in shapes], columns=["lng", "lat"], dtype="float64")

    at = centre(df[geometry])
    return at.getField("lng"), at.getField("lat")


def wkb_centre(raw: bytes | None) -> tuple[float | None, float | None]:
    """The centroid of one geometry: mean of parts weighted by area, else length, else count."""
    import struct

    sums: dict[int, list[float]] = {0: [0.0, 0.0, 0.0], 1: [0.0, 0.0, 0.0], 2: [0.0, 0.0, 0.0]}

    def add(dimension: int, weight: float, x: float, y: float) -> None:
        s = sums[dimension]
        s[0], s[1], s[2] = s[0] + weight, s[1] + weight * x, s[2] + weight * y

    def points(at: int, order: str, n: int, size: int) -> tuple[list[tuple[float, float]], int]:
        return [struct.unpack_from(order + "dd", raw, at + i * 8 * size) for i in range(n)], at + n * 8 * size

    def walk(at: int) -> int:
        order = "<" if raw[at] else ">"
        kind = struct.unpack_from(order + "I", raw, at + 1)[0]
        size = 2 + bool(kind & 0x80000000 or kind // 1000 % 10 in (1, 3)) + bool(kind & 0x40000000 or kind // 1000 % 10 in (2, 3))
        at += 5 + 4 * bool(kind & 0x20000000)
        shape = kind & 0xFFFF
        shape %= 1000
        if shape == 1:
            (p,), at = points(at, order, 1, size)
            add(0, 1.0, *p)
            return at
        n, at = struct.unpack_from(order + "I", raw, at)[0], at + 4
        if shape == 2:
            line, at = points(at, order, n, size)
            for a, b in zip(line, line[1:], strict=False):
                add(1, ((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5, (a[0] + b[0]) / 2, (a[1] + b[1]) / 2)
        elif shape == 3:
            for ring_number in range(n):
                m, at = struct.unpack_from(order + "I", raw, at)[0], at + 4
                ring, at = points(at, order, m, size)
                doubled = [(a[0] * b[1] - b[0] * a[1], a[0] + b[0], a[1] + b[1]) for a, b in zip(ring, ring[1:], strict=False)]
                area = sum(d for d, _, _ in doubled) / 2
                if area:
                    sign = (1 if ring_number == 0 else -1) * (1 if area > 0 else -1)
                    add(2, sign * area, sum(d * x for d, x, _ in doubled) / (6 * area), sum(d * y for d, _, y in doubled) / (6 * area))
        elif shape in (4, 5, 6, 7):
            for _ in range(n):
                at = walk(at)
        else:
            raise ValueError(f"geometry of kind {shape}")
        return at

    try:
        walk(0)
    except (ValueError, TypeError, IndexError, struct.error):
        return None, None
    for dimension in (2, 1, 0):
        weight, x, y = sums[dimension]
        if weight:
            return x / weight, y / weight
    return None, None
