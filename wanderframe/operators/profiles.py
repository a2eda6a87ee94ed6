"""Daily motifs and individual mobility profiles."""

from __future__ import annotations

from functools import lru_cache
from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import minutes_between, tokens
from ..sources.work import stored
from .quantiles import quantiles
from .sampling import weighted

LARGEST = 6
SHIFT = 36
# The seventeen daily motifs of the literature, their ids and published shares
# in percent, in the literature's order.
LITERATURE = (
    (0x1000000000, 10.10),
    (0x2000000006, 30.80),
    (0x30000000E4, 12.70),
    (0x300000008C, 9.40),
    (0x30000000E2, 0.60),
    (0x4000006818, 7.30),
    (0x4000004218, 5.00),
    (0x4000007888, 1.70),
    (0x4000006984, 0.70),
    (0x5000C80830, 3.00),
    (0x5000820830, 2.30),
    (0x5000E84030, 1.30),
    (0x5000C10610, 1.00),
    (0x6620102060, 1.30),
    (0x6408102060, 1.30),
    (0x6720802060, 0.72),
    (0x66040A0060, 0.86),
)


@lru_cache(maxsize=100_000)
def canonical_id(n: int, edges: frozenset) -> int:
    """n in the high bits, below the greatest adjacency matrix over all orders of the nodes,
    read row by row; -1 beyond six nodes."""
    if n > LARGEST:
        return -1
    best = 0
    for order in permutations(range(n)):
        bits = 0
        for a, b in edges:
            bits |= 1 << (n * n - 1 - order[a] * n - order[b])
        best = max(best, bits)
    return (n << SHIFT) + best


def motif_of(path: list[str]) -> int:
    """The motif of a day's sequence of places: moves between consecutive distinct ones."""
    number: dict[str, int] = {}
    ids = [number.setdefault(p, len(number)) for p in path]
    return canonical_id(len(number), frozenset((a, b) for a, b in zip(ids, ids[1:], strict=False) if a != b))


def adjacency(motif: int) -> list[list[int]]:
    """The matrix of a motif id."""
    n = motif >> SHIFT
    return [[motif >> (n * n - 1 - i * n - j) & 1 for j in range(n)] for i in range(n)]


def daily_motifs(v: DataFrame) -> DataFrame:
    """(uid, day, n_nodes, motif) from visits with location_id and purpose.

    A node is a place with HOME or VISIT; a visit belongs to the day it starts on.  The
    paths are built in Spark; only distinct small graphs are put into canonical form."""
    home = F.when(F.col("purpose") == "HOME", "HOME").otherwise("VISIT")
    day = v.where("location_id IS NOT NULL").select("uid", F.to_date("start_timestamp").alias("day"), "start_timestamp", tokens("location_id", home).alias("node"))
    paths = day.groupBy("uid", "day").agg(F.transform(F.sort_array(F.collect_list(F.struct("start_timestamp", "node"))), lambda x: x.node).alias("path"))

    @F.pandas_udf("long")
    def motif(path: pd.Series) -> pd.Series:
        return path.map(lambda p: motif_of(list(p)))

    return paths.select("uid", "day", F.size(F.array_distinct("path")).alias("n_nodes"), motif("path").alias("motif"))


def motif_shares(m: DataFrame) -> DataFrame:
    n = m.groupBy("motif").agg(F.count("*").alias("n"))
    return n.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def motif_basis(shares: DataFrame) -> DataFrame:
    """(name, pct, reference_pct): shares of the literature's motifs, m1 to m17, and of all
    others together; motifs that do not occur have zero."""
    spark = shares.sparkSession
    rest = round(100 - sum(p for _, p in LITERATURE), 2)
    basis = spark.createDataFrame([(f"m{i}", m, p) for i, (m, p) in enumerate(LITERATURE, 1)] + [("other", None, rest)], "name string, motif long, reference_pct double")
    named = shares.join(F.broadcast(basis.select("name", "motif")), "motif", "left").groupBy(F.coalesce("name", F.lit("other")).alias("name")).agg(F.sum("pct").alias("pct"))
    return basis.select("name", "reference_pct").join(named, "name", "left").select("name", F.coalesce("pct", F.lit(0.0)).alias("pct"), "reference_pct")


# The outings of each literature motif, by the stops before the return home.
EXCURSIONS = ((), (1,), (1, 1), (2,), (2, 1), (2, 1), (3,), (1, 1, 1), (1, 3), (3, 1), (4,), (2, 1, 1), (2, 2), (4, 1), (5,), (3, 1, 1), (3, 2))


def motif_prior(spark: SparkSession) -> DataFrame:
    """(motif, n_locations, weight, excursions) of the literature's motifs by their number: the
    weights of those with as many places add up to one."""
    rows = [(i, m >> SHIFT, p, list(out)) for i, ((m, p), out) in enumerate(zip(LITERATURE, EXCURSIONS, strict=True), 1)]
    table = spark.createDataFrame(rows, "motif long, n_locations long, pct double, excursions array<long>")
    return table.select("motif", "n_locations", (F.col("pct") / F.sum("pct").over(Window.partitionBy("n_locations"))).alias("weight"), "excursions")


def draw_motifs(diaries: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """``diaries`` (key, n_locations) with a motif of as many places, drawn by weight, and its
    excursions; null where the literature has none of that size."""
    options = diaries.select(key, "n_locations").join(F.broadcast(motif_prior(diaries.sparkSession)), "n_locations")
    drawn = weighted(options, [key], "motif", "weight", 1, seed).select(key, "motif", "excursions")
    return diaries.join(drawn, key, "left")


def token_steps(v: DataFrame, minutes: int = 5) -> DataFrame:
    """(uid, t, token): a visit's place and purpose at every so many minutes inside it; of
    two visits at one moment the later start holds."""
    size = minutes * 60
    a = F.ceil(F.unix_seconds(F.col("start_timestamp").cast("timestamp")) / size)
    b = F.floor(F.unix_seconds(F.col("end_timestamp").cast("timestamp")) / size)
    steps = v.withColumn("a", a).withColumn("b", b).where("b >= a").select("uid", "start_timestamp", tokens("location_id", "purpose").alias("token"), F.explode(F.sequence("a", "b")).alias("t"))
    return steps.groupBy("uid", "t").agg(F.max_by("token", "start_timestamp").alias("token"))


def token_spans(v: DataFrame, minutes: int = 5) -> DataFrame:
    """(uid, a, b, token): the steps of :func:`token_steps` as spans of one token, first and
    last step included, a row for each visit instead of each step.

    Where no visit outlasts a later one each holds until the next begins; users of whom one
    does are taken step by step."""
    size = minutes * 60
    a = F.ceil(F.unix_seconds(F.col("start_timestamp").cast("timestamp")) / size)
    b = F.floor(F.unix_seconds(F.col("end_timestamp").cast("timestamp")) / size)
    own = stored(v.select("uid", "location_id", "purpose", "start_timestamp", "end_timestamp", a.alias("a"), b.alias("b")).where("b >= a"), "visits")
    w = Window.partitionBy("uid").orderBy("start_timestamp", "b", "location_id", "purpose")
    following = own.withColumns({"next": F.lead("a").over(w), "later": F.lead("b").over(w), "same": F.lead("start_timestamp").over(w) == F.col("start_timestamp")})
    nested = stored(following.where((F.col("later") < F.col("b")) | F.col("same")).select("uid").distinct(), "nested")
    plain = following.join(F.broadcast(nested) if nested.count() < 10_000 else nested, "uid", "left_anti")
    spans = plain.select("uid", "a", F.least("b", F.col("next") - 1).alias("b"), tokens("location_id", "purpose").alias("token")).where("b >= a")
    steps = token_steps(own.join(nested, "uid", "left_semi"), minutes)
    return spans.unionByName(steps.select("uid", F.col("t").alias("a"), F.col("t").alias("b"), "token"))


def intermittency(steps: DataFrame) -> DataFrame:
    """(uid, returner_run, explorer_run, intermittency, degree_of_return).

    A step is known if its token was seen before or is frequent (0.8 of the user's mean
    frequency); R and E are the mean lengths of known and new runs.  Steps are (uid, t, token)
    or spans of them (uid, a, b, token)."""
    spans = steps if "a" in steps.columns else steps.select("uid", F.col("t").alias("a"), F.col("t").alias("b"), "token")
    by_user, by_token, w = Window.partitionBy("uid"), Window.partitionBy("uid", "token"), Window.partitionBy("uid").orderBy("a")
    # One shuffle by user serves all windows.
    freq = spans.repartition("uid").withColumn("k", F.col("b") - F.col("a") + 1).withColumn("n", F.sum("k").over(by_token)).withColumn("first", F.min("a").over(by_token))
    mean = F.sum("k").over(by_user) / F.sum((F.col("a") == F.col("first")).cast("long")).over(by_user)
    known = freq.withColumn("frequent", F.col("n") >= 0.8 * mean)
    # Of a span the first step is new if it is the token's first and the token is not frequent.
    new = ~F.col("frequent") & (F.col("a") == F.col("first"))
    part = lambda known, a, k: F.struct(F.lit(known).alias("known"), a.alias("a"), k.alias("k"))
    whole = F.array(part(True, F.col("a"), F.col("k")))
    cut = F.filter(F.array(part(False, F.col("a"), F.lit(1).cast("long")), part(True, F.col("a") + 1, F.col("k") - 1)), lambda x: x.k > 0)
    parts = known.select("uid", F.explode(F.when(new, cut).otherwise(whole)).alias("p")).select("uid", "p.*")
    run = parts.withColumn("new", (~F.coalesce(F.lag("known").over(w) == F.col("known"), F.lit(False))).cast("long")).withColumn("run", F.sum("new").over(w))
    lengths = run.groupBy("uid", "run", "known").agg(F.sum("k").alias("len"))
    r = lengths.groupBy("uid").agg(F.coalesce(F.avg(F.when(F.col("known"), F.col("len"))), F.lit(0.0)).alias("returner_run"), F.coalesce(F.avg(F.when(~F.col("known"), F.col("len"))), F.lit(0.0)).alias("explorer_run"))
    return r.withColumn("intermittency", F.col("returner_run") + F.col("explorer_run")).withColumn("degree_of_return", F.atan2("returner_run", "explorer_run"))


def distinct_runs(ids: list[int]) -> int:
    """How many different contiguous sub-sequences there are: states of a suffix automaton."""
    link, length, step = [-1], [0], [{}]
    last = 0
    for x in ids:
        cur = len(length)
        length.append(length[last] + 1)
        link.append(0)
        step.append({})
        p = last
        while p >= 0 and x not in step[p]:
            step[p][x] = cur
            p = link[p]
        if p >= 0:
            q = step[p][x]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                step.append(dict(step[q]))
                while p >= 0 and step[p].get(x) == q:
                    step[p][x] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return sum(length[i] - length[link[i]] for i in range(1, len(length)))


def profile_metrics(v: DataFrame) -> DataFrame:
    """Per user: regularity, diversity, normalised entropy and stationarity of the visits."""
    t = v.dropna(subset=["uid", "location_id", "start_timestamp"]).withColumn("token", tokens("location_id", "purpose"))

    @F.pandas_udf("double")
    def diversity(path: pd.Series) -> pd.Series:
        out = []
        for p in path:
            codes = {x: i for i, x in enumerate(dict.fromkeys(p))}
            n = len(p)
            out.append(distinct_runs([codes[x] for x in p]) / (n * (n + 1) / 2) if n else 0.0)
        return pd.Series(out, dtype="float64")

    seq = t.groupBy("uid").agg(
        F.count("*").alias("n"), F.countDistinct("token").alias("kinds"), F.transform(F.sort_array(F.collect_list(F.struct("start_timestamp", "token"))), lambda x: x.token).alias("path"),
        F.sum(minutes_between("start_timestamp", "end_timestamp")).alias("dwell"), minutes_between(F.min("start_timestamp"), F.max("end_timestamp")).alias("span"),
    )
    each = t.groupBy("uid", "token").agg(F.count("*").alias("k")).withColumn("p", F.col("k") / F.sum("k").over(Window.partitionBy("uid")))
    h = each.groupBy("uid").agg((-F.sum(F.col("p") * F.log2("p"))).alias("h"), F.count("*").alias("m")).select("uid", F.when(F.col("m") > 1, F.col("h") / F.log2("m")).otherwise(0.0).alias("entropy"))
    return seq.join(h, "uid").select("uid", "n", (1 - F.col("kinds") / F.col("n")).alias("regularity"), diversity("path").alias("diversity"), "entropy", F.try_divide("dwell", F.nullif("span", F.lit(0.0))).alias("stationarity"))


def clustered(features: DataFrame, rounds: int = 100) -> DataFrame:
    """Users in three profiles by two standardised features (intermittency, degree_of_return).

    Lloyd's rounds from the order statistics at 1/6, 1/2 and 5/6 of degree_of_return; a round
    is one aggregation and only the three centres come to the driver.  By their mean degree
    of return the clusters are Routiner, Regular and Scouter.  All rounds read one stored table."""
    features = stored(features, "features")
    s = features.agg(*[f(c).alias(f"{n}_{c}") for c in ("intermittency", "degree_of_return") for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if s is None or s.m_intermittency is None:
        return features.withColumn("profile", F.lit(None).cast("string"))
    x = (F.col("intermittency") - s.m_intermittency) / (s.s_intermittency or 1.0)
    y = (F.col("degree_of_return") - s.m_degree_of_return) / (s.s_degree_of_return or 1.0)
    f = features.withColumn("__x", x).withColumn("__y", y)
    at = quantiles(f, "__y", [1 / 6, 0.5, 5 / 6]).first().q
    starts = f.select(*[F.min_by(F.struct("__x", "__y"), F.struct(F.abs(F.col("__y") - q), F.col("uid"))).alias(f"c{i}") for i, q in enumerate(at)]).first()
    centres = [(c["__x"], c["__y"]) for c in starts]

    def nearest(centres: list) -> F.Column:
        return F.array_min(F.array(*[F.struct((F.pow(F.col("__x") - a, 2) + F.pow(F.col("__y") - b, 2)).alias("d"), F.lit(i).alias("i")) for i, (a, b) in enumerate(centres)])).getField("i")

    for _ in range(rounds):
        new = list(centres)
        for r in f.groupBy(nearest(centres).alias("i")).agg(F.avg("__x").alias("x"), F.avg("__y").alias("y")).collect():
            new[r.i] = (r.x, r.y)
        done = max(abs(p - q) for a, b in zip(new, centres, strict=True) for p, q in zip(a, b, strict=True)) < 1e-9
        centres = new
        if done:
            break
    rank = sorted(range(3), key=lambda i: -centres[i][1])
    names = F.array(*[F.lit(("Routiner", "Regular", "Scouter")[rank.index(i)]) for i in range(3)])
    return f.withColumn("profile", F.get(names, nearest(centres))).drop("__x", "__y")
