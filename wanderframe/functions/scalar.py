"""Casts, labels, clocks and draws as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import c


def lenient_timestamp(col) -> Column:
    """A timestamp without zone, null where the value cannot be read as one."""
    return F.expr(f"try_cast({col} AS timestamp_ntz)") if isinstance(col, str) else col.try_cast("timestamp_ntz")


def lenient_double(col) -> Column:
    return c(col).try_cast("double")


def finite(col) -> Column:
    """Neither null, NaN nor infinite."""
    return c(col).isNotNull() & ~F.isnan(c(col)) & (F.abs(c(col)) < float("inf"))


def minutes_between(a, b) -> Column:
    """Minutes from a to b as a double."""
    return (F.unix_micros(c(b).cast("timestamp")) - F.unix_micros(c(a).cast("timestamp"))) / 6e7


def seconds_of(col) -> Column:
    return F.unix_seconds(c(col).cast("timestamp"))


def after_minutes(ts, minutes) -> Column:
    return c(ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (c(minutes) * 60).cast("decimal(18,6)"))


def label(col) -> Column:
    """Upper-cased and trimmed; the texts nan, none and null and the empty text are null."""
    t = F.upper(F.trim(c(col).cast("string")))
    return F.when(~t.isin("NAN", "NONE", "NULL", ""), t)


def purpose(col) -> Column:
    """HOME, WORK or OTHER; whatever else, null included, is OTHER."""
    t = F.upper(F.trim(c(col).cast("string")))
    return F.when(t.isin("HOME", "WORK"), t).otherwise("OTHER")


def mode(col, mapping: dict[str, str]) -> Column:
    """A transport mode by a small dictionary on trimmed lower case; unknown is null."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]) if mapping else F.create_map().cast("map<string,string>")
    return F.try_element_at(table, F.lower(F.trim(c(col).cast("string"))))


MODES = {"walk": "walk", "walking": "walk", "foot": "walk", "bike": "bike", "bicycle": "bike", "cycling": "bike", "car": "car", "drive": "car", "auto": "car", "rail": "rail", "train": "rail", "metro": "rail", "subway": "rail"}
MODE_ORDER = ("walk", "bike", "car", "rail")


def mode_rank(col) -> Column:
    """Place in the order walk, bike, car, rail; others come behind."""
    at = F.array_position(F.array(*[F.lit(m) for m in MODE_ORDER]), c(col))
    return F.when(at > 0, at).otherwise(F.lit(len(MODE_ORDER) + 1))


def clock_minutes(col) -> Column:
    """Minutes of the day of "HH:MM", 24:00 included."""
    p = F.split(c(col), ":")
    return F.get(p, F.lit(0)).cast("int") * 60 + F.get(p, F.lit(1)).cast("int")


def clip(x, low: float, high: float) -> Column:
    return F.least(F.greatest(c(x), F.lit(low)), F.lit(high))


def tokens(*cols) -> Column:
    return F.concat_ws("_", *[c(x) for x in cols])


def keyword_label(col, rules: dict[str, tuple[str, ...]], default: str) -> Column:
    """The first rule any of whose keywords stands in the lower-cased text."""
    text = F.lower(F.coalesce(c(col), F.lit("")))
    found = [(name, reduce(lambda a, b: a | b, [text.contains(w) for w in words])) for name, words in rules.items()]
    out = F.lit(default)
    for name, hit in reversed(found):
        out = F.when(hit, name).otherwise(out)
    return out


def content_key(*cols) -> Column:
    """SHA-256 of the fields joined by NUL."""
    return F.sha2(F.concat_ws("\0", *[c(x).cast("string") for x in cols]), 256)


def searchsorted(breaks, x) -> Column:
    """How many of the ascending breaks lie below x."""
    return F.size(F.filter(c(breaks), lambda b: b < c(x)))


def bivariate_class(volume, peak) -> Column:
    """Nine classes of a volume difference in percent (-3, 3) by a peak shift in hours (2, 5)."""
    x = F.when(c(volume) < -3, 0).when(c(volume) <= 3, 1).otherwise(2)
    y = F.when(c(peak) <= 2, 0).when(c(peak) <= 5, 1).otherwise(2)
    return y * 3 + x


def cosine(a, b) -> Column:
    """Cosine similarity of two arrays of doubles; null where either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(c(x), c(y), lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))


def uniform(seed: int, *cols) -> Column:
    """A number in (0, 1) that depends on the seed and the columns' texts alone: the first 52
    bits of their md5, so that any engine can repeat the draw."""
    text = F.concat_ws("|", F.lit(str(seed)), *[c(x).cast("string") for x in cols])
    return (F.conv(F.left(F.md5(text), F.lit(13)), 16, 10).cast("long") + 0.5) / float(1 << 52)


def normal(seed: int, *cols) -> Column:
    """A standard normal draw (Box-Muller) of the seed and the columns."""
    return F.sqrt(-2 * F.log(uniform(seed, *cols))) * F.cos(6.283185307179586 * uniform(seed + 7919, *cols))


def log_normal_hours(mu, sigma, z) -> Column:
    """exp(mu + sigma z) hours, at least a minute, in whole seconds."""
    return F.round(F.greatest(F.exp(c(mu) + c(sigma) * c(z)), F.lit(1 / 60)) * 3600) / 3600


def explore_probability(visited, rho: float = 0.6, gamma: float = 0.21) -> Column:
    """Chance to explore after so many distinct places: rho S ** -gamma, S at least one."""
    return rho * F.pow(F.greatest(c(visited), F.lit(1)).cast("double"), F.lit(-gamma))


def crp_weight(count, similarity, temperature, top=0.0) -> Column:
    """count exp((similarity - top) / temperature)."""
    top = F.lit(top) if isinstance(top, (int, float)) else c(top)
    return c(count) * F.exp((c(similarity) - top) / c(temperature))


# What the five grades of health are called.
HEALTH = ("very poor", "poor", "fair", "good", "very good")


def narrative(transport: bool = True) -> Column:
    """A profile's description in prose, of its columns name, age, gender, job, education,
    health, household, has_car and has_bike."""
    health = F.coalesce(F.get(F.array(*[F.lit(x) for x in HEALTH]), (F.col("health") - 1).cast("int")), F.col("health").cast("string"))
    own = F.concat_ws(" and ", F.when(F.col("has_car"), "a car"), F.when(F.col("has_bike"), "a bike"))
    moves = F.when(own == "", "They rely on public transport or walking.").otherwise(F.concat(F.lit("They own "), own, F.lit(".")))
    text = F.format_string("%s is a %s-year-old %s working as a %s. They have %s level education and %s health. They live as: %s. ", *[F.col(x).cast("string") for x in ("name", "age", "gender", "job", "education")], health, F.col("household"))
    return F.concat(text, moves) if transport else text
