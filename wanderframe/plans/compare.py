"""Reports: two trajectory tables compared section by section, for every filter at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hexagons
from ..operators import activity, distance, filters, graph, laws, od, profiles, sampling, traj, transport
from ..sources import io, schema
from ..sources.work import stored

SECTIONS = ("distributions", "activity", "motifs", "profiles", "cpc", "stvd", "laws", "transport", "network")


def _row(df: DataFrame, name: str, value: str, unit: str | None = None) -> DataFrame:
    return distance.metric_rows(df, name, value, unit)


def distributions(s: DataFrame, o: DataFrame) -> list[DataFrame]:
    """W1 of jumps, gyration, visits and waits, for all filters in one pass each.

    Measures are taken over whole trajectories and then filtered by their time, so that a
    filter never joins rows that were not neighbours."""
    jumps = [filters.by_filter(traj.jump_lengths(x)) for x in (s, o)]
    waits = [filters.by_filter(traj.waiting_times(x)) for x in (s, o)]
    by = ["filter_key"]
    return [
        _row(distance.wasserstein(*jumps, "jump_km", by), "w1_jump_lengths", "w1", "km"),
        _row(distance.wasserstein(*waits, "wait_minutes", by), "w1_waiting_times", "w1", "min"),
        _row(distance.wasserstein(traj.radius_of_gyration(s), traj.radius_of_gyration(o), "rog_km"), "w1_radius_of_gyration", "w1", "km"),
        _row(distance.wasserstein(traj.visits_per_user(s), traj.visits_per_user(o), "visits"), "w1_visits_per_user", "w1"),
    ]


def section(name: str, s: DataFrame, o: DataFrame, vs: DataFrame, vo: DataFrame, index=hexagons) -> list[DataFrame]:
    """The metric rows of one section; ``vs`` and ``vo`` are visits with purposes."""
    if name == "distributions":
        return distributions(s, o)
    if name == "activity":
        daily = [activity.daily_profile(v, "start_timestamp", "end_timestamp", "purpose") for v in (vs, vo)]
        return [
            _row(distance.jensen_shannon(*(distance.shares(filters.by_filter(v, "start_timestamp"), "purpose", ["filter_key"]) for v in (vs, vo)), ["purpose"], "n", ["filter_key"]), "jsd_activity", "jsd"),
            _row(distance.jensen_shannon(*(activity.transitions(v) for v in (vs, vo)), ["a", "b"], "n"), "jsd_transitions", "jsd"),
            _row(activity.profile_divergence(*daily), "jsd_daily_profile", "jsd"),
        ]
    if name == "motifs":
        return [_row(distance.jensen_shannon(*(profiles.motif_shares(profiles.daily_motifs(v)) for v in (vs, vo)), ["motif"], "n"), "jsd_motifs", "jsd")]
    if name == "profiles":
        m = [profiles.profile_metrics(v).persist() for v in (vs, vo)]  # four distances read each
        return [_row(distance.wasserstein(*m, c), f"w1_{c}", "w1") for c in ("regularity", "diversity", "entropy", "stationarity")]
    if name == "cpc":
        return [_row(od.common_part(od.flows(s, r, index), od.flows(o, r, index)), f"cpc_{r}", "cpc") for r in (7, 8, 9)]
    if name == "stvd":
        both = [filters.by_filter(x, times=False) for x in (s, o)]  # hours are a coordinate already
        return [_row(od.hourly_transport(*both, r, 8, index=index, by=["filter_key"]), f"stvd_emd_{r}", "sliced_w1", "m") for r in (7, 8, 9)]
    if name == "laws":
        v = [laws.daily_locations(laws.law_visits(x)) for x in (s, o)]
        return [_row(laws.log_normal(d), f"{side}_daily_{c}", c) for d, side in zip(v, ("syn", "obs"), strict=True) for c in ("mu", "sigma")]
    if name == "transport":
        legs = [transport.observed_legs(x, schema.find(x, "mode")).withColumn("source", F.lit(side)) for x, side in ((s, "syn"), (o, "obs")) if schema.find(x, "mode")]
        if not legs:
            return []
        t = transport.summary(reduce(DataFrame.unionByName, legs))
        return [t.select(F.lit("all").alias("filter_key"), F.concat_ws("_", F.lit("share"), "source", "mode").alias("metric_name"), F.col("share").alias("value"), F.lit("%").alias("unit"))]
    if name == "network":
        e = [graph.normalized(graph.co_presence(v, ts="start_timestamp")[0]).persist() for v in (vs, vo)]
        return [_row(distance.wasserstein(graph.degree(e[0]), graph.degree(e[1]), "degree"), "w1_degree", "w1"), _row(distance.wasserstein(graph.clustering(e[0]), graph.clustering(e[1]), "clustering"), "w1_clustering", "w1")]
    raise ValueError(f"unknown section {name}")


def _aligned(s: DataFrame, o: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Both sides' values of each key, zero where one lacks it."""
    a, b = s.select(*keys, F.col(value).alias("synthetic")), o.select(*keys, F.col(value).alias("observed"))
    return a.join(b, keys, "full_outer").fillna(0.0, ["synthetic", "observed"])


def activity_block(vs: DataFrame, vo: DataFrame) -> dict[str, DataFrame]:
    """What the activity charts show of synthetic and observed visits, in long form: purpose
    (percent), transition (a, b) and daily (activity, hour) with ``diff``, observed less
    synthetic, and ``bound``, the largest difference but one at least, for the scale."""
    share = lambda v: distance.shares(v, "purpose").withColumn("pct", 100 * F.col("share"))
    purpose = _aligned(share(vs), share(vo), ["purpose"], "pct").select("purpose", F.round("synthetic", 2).alias("synthetic"), F.round("observed", 2).alias("observed"))

    def difference(s: DataFrame, o: DataFrame, keys: list[str]) -> DataFrame:
        d = _aligned(s, o, keys, "pct").select(*keys, (F.col("observed") - F.col("synthetic")).alias("d"))
        top = d.agg(F.greatest(F.max(F.abs("d")), F.lit(1.0)).alias("bound"))  # one row
        return d.join(F.broadcast(top)).select(*keys, F.round("d", 3).alias("diff"), "bound")

    daily = [activity.daily_profile(v, "start_timestamp", "end_timestamp", "purpose") for v in (vs, vo)]
    return {"purpose": purpose, "transition": difference(activity.transitions(vs), activity.transitions(vo), ["a", "b"]), "daily": difference(*daily, ["activity", "bin"])}


def profiles_block(vs: DataFrame, vo: DataFrame, minutes: int = 5, most: int = 4000) -> dict[str, DataFrame]:
    """What the profile charts show: ``scatter``, at most so many users of each side by md5
    order, and ``box``, the quartiles of each metric by side and profile."""
    sides = []
    for name, v in (("synthetic", vs), ("observed", vo)):
        kinds = profiles.clustered(profiles.intermittency(profiles.token_spans(v, minutes)))
        m = profiles.profile_metrics(v).join(kinds.select("uid", "profile", "intermittency", "degree_of_return"), "uid")
        sides.append(stored(m.withColumn("dataset", F.lit(name)), "profiles"))
    points = [sampling.hashed_rows(m.select("dataset", "uid", "profile", F.col("degree_of_return").alias("x"), F.col("intermittency").alias("y")), "uid", most) for m in sides]
    metrics = ("regularity", "diversity", "entropy", "stationarity")
    long = reduce(DataFrame.unionByName, sides).select("dataset", "profile", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in metrics])).alias("m")).select("dataset", "profile", "m.metric", "m.value")
    return {"scatter": points[0].unionByName(points[1]), "box": distance.box(long, "value", ["metric", "dataset", "profile"])}


def report(synthetic: DataFrame, observed: DataFrame, sections: tuple[str, ...] = SECTIONS, adaptation: str = "auto", index=hexagons) -> tuple[DataFrame, list[str]]:
    """(filter_key, metric_name, value, unit) of all sections, and warnings.

    Both tables need the four trajectory roles; location and purpose columns are used where
    they exist.  The synthetic side is never forced to collapse.  ``index`` is the kind of
    cells of flows and histograms."""
    warnings: list[str] = []
    sides, visits = [], []
    for df, mode in ((synthetic, "auto" if adaptation == "force" else adaptation), (observed, adaptation)):
        t = schema.canonical(df)
        location, purpose = schema.find(t, "location"), schema.find(t, "activity")
        t, w = traj.adapt(t, mode, location, has_duration=schema.find(t, "duration") is not None or schema.find(t, "end") is not None)
        v, w2 = traj.activity_visits(t, location, schema.find(t, "end"), purpose)
        warnings += [x for x in (w, w2) if x]
        sides.append(t.persist())
        visits.append(v.persist())
    rows = [r for name in sections for r in section(name, *sides, *visits, index)]
    return reduce(DataFrame.unionByName, rows), warnings


def report_from_paths(spark: SparkSession, synthetic: str, observed: str, out: str | None = None, **options) -> dict:
    """The report of two tables as a nested dictionary, written as JSON if ``out`` is given."""
    rows, _ = report(io.parquet(spark, synthetic), io.parquet(spark, observed), **options)
    return io.metrics_json(rows, ["filter_key", "metric_name"], "value", out)
