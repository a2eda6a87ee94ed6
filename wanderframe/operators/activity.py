"""Activities: shares, transitions, daily profiles, time use and diaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clock_minutes, minutes_between, seconds_of

DAY = 86400


def transitions(v: DataFrame, start: str = "start_timestamp", activity: str = "purpose") -> DataFrame:
    """(a, b, n, pct): consecutive activities of all users, repeats included, in percent of all."""
    w = Window.partitionBy("uid").orderBy(start)
    pairs = v.where(F.col(activity).isNotNull()).select(F.col(activity).alias("a"), F.lead(activity).over(w).alias("b")).where("b IS NOT NULL")
    n = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    return n.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def in_bins(df: DataFrame, start: str, end: str, minutes: int) -> DataFrame:
    """Each interval once per bin of the day that it overlaps, with ``bin`` (of the day) and
    ``seconds``.  Bins are counted from the epoch, so midnight needs no case of its own."""
    if 1440 % minutes:
        raise ValueError("bins must divide the day")
    size = minutes * 60
    a, b = seconds_of(start), seconds_of(end)
    cut = df.where(F.col(end) > F.col(start)).withColumn("__bin", F.explode(F.sequence(F.floor(a / size), F.floor((b - 1) / size))))
    took = F.least(b, (F.col("__bin") + 1) * size) - F.greatest(a, F.col("__bin") * size)
    return cut.withColumn("seconds", took).withColumn("bin", F.pmod(F.col("__bin"), F.lit(DAY // size)).cast("int")).where("seconds > 0").drop("__bin")


def daily_profile(df: DataFrame, start: str, end: str, activity: str, minutes: int = 60, by: list[str] | None = None) -> DataFrame:
    """(activity, bin, seconds, pct): time of each activity in percent of its bin of the day."""
    by = by or []
    sums = in_bins(df, start, end, minutes).groupBy(*by, F.col(activity).alias("activity"), "bin").agg(F.sum("seconds").alias("seconds"))
    return sums.withColumn("pct", 100.0 * F.col("seconds") / F.sum("seconds").over(Window.partitionBy(*by, "bin")))


def profile_divergence(a: DataFrame, b: DataFrame) -> DataFrame:
    """The mean over bins of the divergence of two daily profiles; bins empty on both sides do not count."""
    from .distance import jensen_shannon

    return jensen_shannon(a, b, ["activity"], "pct", ["bin"]).agg(F.coalesce(F.avg("jsd"), F.lit(0.0)).alias("jsd"))


def split_midnight(df: DataFrame, start: str = "arrival", end: str = "departure") -> DataFrame:
    """Intervals cut at midnight: day, its start and end there, and minutes."""
    last = F.to_date(F.col(end) - F.expr("INTERVAL 1 MICROSECOND"))
    days = F.explode(F.sequence(F.to_date(start), last))
    cut = df.where(F.col(end) > F.col(start)).withColumn("day", days)
    s = F.greatest(F.col(start).cast("timestamp_ntz"), F.col("day").cast("timestamp_ntz"))
    e = F.least(F.col(end).cast("timestamp_ntz"), F.date_add("day", 1).cast("timestamp_ntz"))
    return cut.withColumns({"seg_start": s, "seg_end": e}).withColumn("minutes", minutes_between("seg_start", "seg_end"))


def time_use(segments: DataFrame, category: str, group: str | None = None) -> DataFrame:
    """(category, minutes): mean minutes a day per user-day that has any segment."""
    by = [group] if group else []
    days = segments.groupBy(*by).agg(F.countDistinct(F.struct("uid", "day")).alias("days"))
    sums = segments.groupBy(*by, F.col(category).alias("category")).agg(F.sum("minutes").alias("total"))
    joined = sums.join(F.broadcast(days), by) if by else sums.join(F.broadcast(days))
    return joined.select(*by, "category", (F.col("total") / F.col("days")).alias("minutes"))


def surveyed(df: DataFrame, categories: list[str], weight: str, day: str | None = None) -> DataFrame:
    """(category, minutes): weighted mean minutes of a wide survey; zero without weight.

    ``day`` limits to weekday or weekend by the label in the column day; labels that name no
    day of the week count as neither."""
    label = F.lower(F.trim(F.col("day").cast("string")))
    end = label.isin("saturday", "sunday", "sat", "sun", "6", "7")
    work = label.isin("monday", "tuesday", "wednesday", "thursday", "friday", "mon", "tue", "wed", "thu", "fri", "1", "2", "3", "4", "5")
    kept = df.where(end if day == "weekend" else work if day == "weekday" else F.lit(True))
    long = kept.select(F.col(weight).cast("double").alias("w"), *[F.col(c).cast("double").alias(c) for c in categories]).unpivot(["w"], categories, "category", "x").where("x IS NOT NULL AND w IS NOT NULL")
    return long.groupBy("category").agg(F.when(F.sum("w") > 0, F.sum(F.col("w") * F.col("x")) / F.sum("w")).otherwise(0.0).alias("minutes"))


def time_use_rows(synthetic: DataFrame, observed: DataFrame) -> DataFrame:
    """Per category: minutes of both, difference, its percent of the observed (null for
    zero) and of the day."""
    both = synthetic.select("category", F.col("minutes").alias("synthetic")).join(observed.select("category", F.col("minutes").alias("observed")), "category", "full_outer").fillna(0.0)
    diff = F.col("synthetic") - F.col("observed")
    return both.select("category", F.round("synthetic", 6).alias("synthetic"), F.round("observed", 6).alias("observed"), F.round(diff, 6).alias("diff"), F.round(F.try_divide(diff, F.nullif("observed", F.lit(0.0))) * 100, 6).alias("diff_pct"), F.round(diff / 1440 * 100, 6).alias("share_pp"))


def mean_share_difference(rows: DataFrame) -> DataFrame:
    return rows.agg(F.coalesce(F.avg(F.abs("share_pp")), F.lit(0.0)).alias("mean_abs_share_pp"))


def day_coverage(segments: DataFrame, minutes: float = 1440.0, slack: float = 1.0) -> DataFrame:
    """(uid, day, minutes, full): whether a user-day is covered."""
    per = segments.groupBy("uid", "day").agg(F.sum("minutes").alias("minutes"))
    return per.withColumn("full", F.abs(F.col("minutes") - minutes) <= slack)


def regrouped(df: DataFrame, mapping: dict[str, str], column: str, default: str = "other") -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(column, F.coalesce(F.try_element_at(table, F.col(column)), F.lit(default)))


def diary_slots(diaries: DataFrame, minutes: int) -> DataFrame:
    """(diary_id, slot, purpose): the episode of each slot of a day; "24:00" ends it.

    An episode covers at least the slot it starts in; of several the later one holds."""
    e = diaries.select("diary_id", F.posexplode("episodes").alias("i", "e"))
    a = F.floor(clock_minutes("e.start") / minutes)
    b = F.greatest(F.floor((clock_minutes("e.end") - 1) / minutes), a)
    slots = e.select("diary_id", "i", F.col("e.purpose").alias("purpose"), F.explode(F.sequence(a, b)).alias("slot"))
    return slots.groupBy("diary_id", "slot").agg(F.max_by("purpose", "i").alias("purpose"))


def annotate_by_diary(df: DataFrame, chosen: DataFrame, diaries: DataFrame, ts: str = "datetime") -> DataFrame:
    """Rows with the purpose of the episode they fall in, by the diary chosen for the user's day."""
    e = diaries.select("diary_id", F.explode("episodes").alias("e")).select("diary_id", clock_minutes("e.start").alias("s"), clock_minutes("e.end").alias("t"), F.col("e.purpose").alias("purpose"))
    m = F.hour(ts) * 60 + F.minute(ts)
    d = df.withColumn("day", F.to_date(ts)).withColumn("m", m).join(chosen.select("uid", "day", "diary_id"), ["uid", "day"], "left")
    return d.join(e, (d.diary_id == e.diary_id) & (d.m >= e.s) & (d.m < e.t), "left").drop(e.diary_id).drop("s", "t", "m")


def diary_features(diaries: DataFrame) -> DataFrame:
    """Per diary: stops, stops away, minutes by purpose, first departure, last return, and
    excursions from home back to home."""
    e = diaries.select("diary_id", F.posexplode("episodes").alias("i", "e")).select("diary_id", "i", clock_minutes("e.start").alias("s"), clock_minutes("e.end").alias("t"), F.col("e.purpose").alias("p"))
    w = Window.partitionBy("diary_id").orderBy("i")
    away = (F.col("p") != "HOME").cast("int")
    e = e.withColumn("leaves", (F.lag("p").over(w) == "HOME") & (F.col("p") != "HOME")).withColumn("homes_after", F.max(F.when(F.col("p") == "HOME", F.col("i"))).over(Window.partitionBy("diary_id")))
    sums = [F.coalesce(F.sum(F.when(F.col("p") == x, F.col("t") - F.col("s"))), F.lit(0)).alias(f"{x.lower()}_minutes") for x in ("HOME", "WORK", "OTHER")]
    return e.groupBy("diary_id").agg(F.count("*").alias("stops"), F.sum(away).alias("stops_away"), *sums, F.min(F.when(F.col("leaves"), F.col("s"))).alias("first_departure"), F.max(F.when((F.col("p") == "HOME") & (F.col("i") > 0), F.col("s"))).alias("last_return"), F.count_if(F.coalesce(F.col("leaves"), F.lit(False)) & (F.col("homes_after") > F.col("i"))).alias("excursions"))
