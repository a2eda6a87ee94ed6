"""Relational building blocks on the star schema: filters, joins, aggregates, windows, sets."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import distance, filters, sampling
from ..sources import io
from . import views
from .registry import Registry
from .views import common, table

query = Registry()


# Sources ------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000")
def source_projected_scan(spark, sf):
    return io.parquet(spark, f"{sf}/orders.parquet", columns=["o_orderkey", "o_totalprice"]).where("o_totalprice > 300000")


@query("SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day FROM events")
def source_run_summary(spark, sf):
    s = io.run_summary(views.pings(spark, sf))
    return s.select("n_rows", "n_users", F.substring("first", 1, 10).alias("first_day"), F.substring("last", 1, 10).alias("last_day"))


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT DISTINCT user_id FROM events ORDER BY user_id LIMIT 10)")
def source_first_users(spark, sf):
    return io.first_users(table(spark, sf, "events"), 10, "user_id").select("event_id", "user_id")


@query(
    """WITH ids AS (SELECT DISTINCT user_id FROM events), r AS (SELECT user_id, ntile(2) OVER (ORDER BY md5('seed|' || CAST(user_id AS VARCHAR)), user_id) AS half FROM ids)
SELECT CAST(half AS BIGINT) AS half, count(*) AS n_rows, count(DISTINCT user_id) AS n_users FROM events JOIN r USING (user_id) GROUP BY half"""
)
def source_population_split(spark, sf):
    halves = io.split_users(table(spark, sf, "events"), "seed", "user_id")
    out = [h.agg(F.lit(i).cast("long").alias("half"), F.count("*").alias("n_rows"), F.countDistinct("user_id").alias("n_users")) for i, h in enumerate(halves, 1)]
    return out[0].unionByName(out[1])


# Projections, filters, casts -----------------------------------------------------------------


@query("SELECT event_id, TRY_CAST(props AS DOUBLE) AS as_number, TRY_CAST(CAST(event_id AS VARCHAR) || '.5' AS DOUBLE) AS half, TRY_CAST(substr(CAST(ts AS VARCHAR), 1, 19) AS TIMESTAMP) AS at FROM events")
def project_lenient_casts(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", scalar.lenient_double("props").alias("as_number"), scalar.lenient_double(F.concat(F.col("event_id").cast("string"), F.lit(".5"))).alias("half"), scalar.lenient_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("at"))


def _filter_sql() -> str:
    parts = ["'all', TRUE", "'weekday', isodow(ts) < 6", "'weekend', isodow(ts) >= 6", "'special', CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'"]
    parts += [f"'{k}', hour(ts) >= {a} AND hour(ts) < {b}" for k, (a, b) in filters.TIMES.items()]
    unions = " UNION ALL ".join(f"SELECT {p.split(', ', 1)[0]} AS filter_key, value, user_id FROM events WHERE {p.split(', ', 1)[1]}" for p in parts)
    return f"SELECT filter_key, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean_value FROM ({unions}) GROUP BY filter_key"


@query(_filter_sql())
def filter_all_keys_one_pass(spark, sf):
    e = filters.by_filter(table(spark, sf, "events").withColumnRenamed("ts", "datetime"), special={"special": (date(2024, 1, 10), date(2024, 1, 12))})
    return e.groupBy("filter_key").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean_value"))


@query(common("profiles") + " SELECT uid, gender, age, job FROM profiles WHERE gender = 'female' AND age BETWEEN 25 AND 34")
def filter_demographic(spark, sf):
    return views.profiles(spark, sf).where(filters.demographic(gender="female", age="25-34")).select("uid", "gender", "age", "job")


@query(common("pings") + " SELECT event_id FROM pings WHERE lng BETWEEN 2.26 AND 2.29 AND lat BETWEEN 48.80 AND 48.83")
def filter_viewport(spark, sf):
    return views.pings(spark, sf).where(filters.in_viewport("lat", "lng", views.BOX)).select("event_id")


@query("SELECT event_type, CASE upper(trim(event_type)) WHEN 'CLICK' THEN 'A' WHEN 'VIEW' THEN 'B' ELSE 'OTHER' END AS kind, coalesce(nullif(event_type, 'error'), 'none') AS filled, count(*) AS n FROM events GROUP BY ALL")
def project_conditional(spark, sf):
    kind = F.when(F.upper(F.trim("event_type")) == "CLICK", "A").when(F.upper(F.trim("event_type")) == "VIEW", "B").otherwise("OTHER")
    return table(spark, sf, "events").groupBy("event_type", kind.alias("kind"), F.coalesce(F.nullif("event_type", F.lit("error")), F.lit("none")).alias("filled")).agg(F.count("*").alias("n"))


@query(common("pings") + " SELECT CASE mode WHEN 'walk' THEN 1 WHEN 'bike' THEN 2 WHEN 'car' THEN 3 ELSE 4 END AS place, mode, count(*) AS n FROM pings GROUP BY ALL")
def project_mode_dictionary(spark, sf):
    p = views.pings(spark, sf).withColumn("mode", scalar.mode(F.upper(F.concat(F.lit(" "), F.col("mode"))), scalar.MODES))
    return p.groupBy(scalar.mode_rank("mode").cast("int").alias("place"), "mode").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice IS NOT NULL")
def filter_membership(spark, sf):
    return table(spark, sf, "orders").dropna(subset=["o_totalprice"]).where(F.col("o_orderstatus").isin("F", "P")).select("o_orderkey", "o_orderpriority")


@query("SELECT event_id, sha256(CAST(user_id AS VARCHAR) || chr(0) || event_type) AS cache_key FROM events")
def scalar_content_key(spark, sf):
    return table(spark, sf, "events").select("event_id", scalar.content_key("user_id", "event_type").alias("cache_key"))


@query(
    """SELECT user_id, round(greatest(least(avg(value), 60), 40), 6) AS clipped, CAST(sum(CASE WHEN event_type LIKE '%click%' OR event_type LIKE '%view%' THEN 1 ELSE 0 END) AS BIGINT) AS passive,
 round(exp(avg(ln(value + 1))), 6) AS geometric, lower(to_hex(user_id)) AS hex, CAST(bit_count(user_id) AS BIGINT) AS bits, CAST(user_id >> 2 AS BIGINT) AS shifted FROM events GROUP BY user_id"""
)
def scalar_numeric_and_text(spark, sf):
    e = table(spark, sf, "events").withColumn("kind", scalar.keyword_label("event_type", {"passive": ("click", "view")}, "active"))
    return e.groupBy("user_id").agg(F.round(scalar.clip(F.avg("value"), 40.0, 60.0), 6).alias("clipped"), F.count_if(F.col("kind") == "passive").alias("passive"), F.round(F.exp(F.avg(F.log(F.col("value") + 1))), 6).alias("geometric")).withColumns({"hex": F.lower(F.hex("user_id")), "bits": F.bit_count("user_id").cast("long"), "shifted": F.shiftright("user_id", 2)})


@query(
    """SELECT event_id, CAST(hour(ts) AS BIGINT) AS h, CAST(isodow(ts) - 1 AS BIGINT) AS d, date_trunc('day', ts) AS day_start, ts + INTERVAL 90 MINUTE AS later,
 round(CAST(date_diff('microsecond', date_trunc('day', ts), ts) AS DOUBLE) / 60000000, 4) AS minute_of_day FROM events"""
)
def scalar_times(spark, sf):
    e = table(spark, sf, "events")
    day = F.date_trunc("day", F.col("ts")).cast("timestamp_ntz")
    return e.select("event_id", F.hour("ts").cast("long").alias("h"), F.weekday("ts").cast("long").alias("d"), day.alias("day_start"), scalar.after_minutes("ts", F.lit(90)).alias("later"), F.round(scalar.minutes_between(day, "ts"), 4).alias("minute_of_day"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def scalar_json(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


# Joins -----------------------------------------------------------------------------------------


@query("SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join_inner_star(spark, sf):
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def join_left_count(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left").fillna(0, ["orders"])


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def join_semi(spark, sf):
    big = table(spark, sf, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(big, "c_custkey", "left_semi")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_anti(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").join(table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query(
    """SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.n, 0) AS clicks, coalesce(b.n, 0) AS errors FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' AND value > 60 GROUP BY 1) a
 FULL OUTER JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' AND value > 60 GROUP BY 1) b ON a.user_id = b.user_id"""
)
def join_full_outer(spark, sf):
    side = lambda t, n: table(spark, sf, "events").where((F.col("event_type") == t) & (F.col("value") > 60)).groupBy("user_id").agg(F.count("*").alias(n))
    return side("click", "clicks").join(side("error", "errors"), "user_id", "full_outer").fillna(0)


@query(
    """WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), b AS (SELECT user_id, ts AS seen, event_id AS view_id FROM events WHERE event_type = 'view')
SELECT a.event_id, b.view_id FROM a ASOF JOIN b ON a.user_id = b.user_id AND a.ts >= b.seen"""
)
def join_as_of(spark, sf):
    """The last view before each click: one window over both kinds instead of a range join."""
    e = table(spark, sf, "events").where("event_type IN ('click', 'view')")
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_type").desc()).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("view_id", seen).where("event_type = 'click' AND view_id IS NOT NULL").select("event_id", "view_id")


@query(
    """SELECT a.event_id, count(*) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR WHERE a.event_type = 'purchase' GROUP BY a.event_id"""
)
def join_range_bucketed(spark, sf):
    """Events in the six hours after a purchase: both sides meet in six-hour buckets."""
    e = table(spark, sf, "events")
    bucket = F.floor(scalar.seconds_of("ts") / 21600)
    a = e.where("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("t0"), F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    b = e.select("user_id", "ts", bucket.alias("bucket"))
    return a.join(b, ["user_id", "bucket"]).where("ts > t0 AND ts <= t0 + INTERVAL 6 HOURS").groupBy("event_id").agg(F.count("*").alias("n"))


@query("SELECT r_name, n.n FROM region LEFT JOIN (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1) n ON r_regionkey = n_regionkey")
def join_lookup_dimension(spark, sf):
    n = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("n"))
    return table(spark, sf, "region").join(n, "r_regionkey", "left").select("r_name", "n")


# Aggregates ------------------------------------------------------------------------------------


@query(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
 round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus"""
)
def aggregate_pricing_summary(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(min(value), 6) AS least, round(max(value), 6) AS most, round(stddev_pop(value), 6) AS sd, round(sqrt(avg(value * value)), 6) AS rms, coalesce(sum(CASE WHEN value < 0 THEN value END), 0.0) AS negative FROM events GROUP BY event_type")
def aggregate_basic(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"), F.round(F.stddev_pop("value"), 6).alias("sd"), F.round(F.sqrt(F.avg(F.col("value") * F.col("value"))), 6).alias("rms"), F.coalesce(F.sum(F.when(F.col("value") < 0, F.col("value"))), F.lit(0.0)).alias("negative"))


@query("SELECT event_type AS k, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type")
def aggregate_distribution_summary(spark, sf):
    s = distance.summary(table(spark, sf, "events").withColumnRenamed("event_type", "k"), "value", ["k"])
    return s.select("k", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "std", "p10", "p90")])


@query("SELECT event_type AS k, round(min(value), 6) AS least, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS most FROM events GROUP BY event_type")
def aggregate_box(spark, sf):
    b = distance.box(table(spark, sf, "events").withColumnRenamed("event_type", "k"), "value", ["k"])
    return b.select("k", *[F.round(c, 6).alias(c) for c in ("least", "q1", "median", "q3", "most")])


@query("SELECT user_id, event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 9) AS share FROM events GROUP BY user_id, event_type")
def aggregate_shares(spark, sf):
    s = distance.shares(table(spark, sf, "events"), "event_type", ["user_id"])
    return s.select("user_id", "event_type", "n", F.round("share", 9).alias("share"))


@query("SELECT user_id, event_type AS modal FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY user_id, event_type) WHERE r = 1")
def aggregate_modal_value(spark, sf):
    from ..operators.traj import modal

    return modal(table(spark, sf, "events"), ["user_id"], "event_type", "modal")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 15")
def aggregate_having(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 15")


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'error') AS error FROM events GROUP BY user_id")
def aggregate_pivot(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").pivot("event_type", ["click", "view", "error"]).count().fillna(0)


@query("SELECT l_returnflag, round(sum(l_quantity * l_extendedprice) / nullif(sum(l_quantity), 0), 4) AS weighted FROM lineitem GROUP BY l_returnflag")
def aggregate_weighted_mean(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_quantity") * F.col("l_extendedprice")) / F.nullif(F.sum("l_quantity"), F.lit(0)), 4).alias("weighted"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS BIGINT) AS g FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def aggregate_cube(spark, sf):
    return table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping("o_orderstatus").cast("long").alias("g"))


@query("SELECT r_name, n_name, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def aggregate_rollup(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).rollup("r_name", "n_name").agg(F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT user_id, min(CASE WHEN event_type = 'click' THEN ts END) AS first_click, arg_max(event_type, ts) AS last_kind FROM events GROUP BY user_id")
def aggregate_ordered_first_last(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "click", F.col("ts"))).alias("first_click"), F.max_by("event_type", "ts").alias("last_kind"))


# Windows ---------------------------------------------------------------------------------------


@query(
    """SELECT event_id, lag(value) OVER w AS before, lead(event_type) OVER w AS after, row_number() OVER w AS rn, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS last3,
 count(*) OVER w AS running FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)"""
)
def window_analytic(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts")
    return table(spark, sf, "events").select("event_id", F.lag("value").over(w).alias("before"), F.lead("event_type").over(w).alias("after"), F.row_number().over(w).cast("long").alias("rn"), F.round(F.sum("value").over(w.rowsBetween(-2, 0)), 6).alias("last3"), F.count("*").over(w).alias("running"))


@query("SELECT o_orderkey, rank() OVER w AS rnk, dense_rank() OVER w AS dense, ntile(4) OVER w AS quarter FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey)")
def window_ranking(spark, sf):
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.rank().over(w).cast("long").alias("rnk"), F.dense_rank().over(w).cast("long").alias("dense"), F.ntile(4).over(w).cast("long").alias("quarter"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 3")
def window_top_k_per_group(spark, sf):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return table(spark, sf, "events").withColumn("r", F.row_number().over(w)).where("r <= 3").select("user_id", "event_id")


@query(
    """SELECT user_id, s AS session, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM (SELECT user_id, ts, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS s FROM (SELECT user_id, ts,
 CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, s"""
)
def window_sessions(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts")
    new = (~F.coalesce(F.col("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL 6 HOURS"), F.lit(False))).cast("long")
    e = table(spark, sf, "events").withColumn("b", new).withColumn("session", F.sum("b").over(w))
    return e.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


# Sorts, limits, samples --------------------------------------------------------------------------


@query("SELECT event_id, value FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 20")
def limit_top_n(spark, sf):
    return table(spark, sf, "events").select("event_id", "value").orderBy(F.desc_nulls_last("value"), "event_id").limit(20)


@query("SELECT event_id FROM events ORDER BY md5('7' || CAST(event_id AS VARCHAR)), event_id LIMIT 200")
def sample_hashed_rows(spark, sf):
    return sampling.hashed_rows(table(spark, sf, "events").select("event_id"), "event_id", 200, "7")


@query("SELECT event_id, round(CASE WHEN b > a THEN (value - a) / (b - a) ELSE 0 END, 9) AS scaled FROM (SELECT event_id, value, min(value) OVER (PARTITION BY event_type) AS a, max(value) OVER (PARTITION BY event_type) AS b FROM events)")
def scale_min_max(spark, sf):
    return sampling.scaled(table(spark, sf, "events"), "value", ["event_type"]).select("event_id", F.round("scaled", 9).alias("scaled"))


# Sets --------------------------------------------------------------------------------------------


@query("SELECT 'c' AS side, c_nationkey AS nation, NULL AS s_suppkey FROM customer UNION ALL SELECT 's', s_nationkey, s_suppkey FROM supplier")
def set_union_by_name(spark, sf):
    c = table(spark, sf, "customer").select(F.lit("c").alias("side"), F.col("c_nationkey").alias("nation"))
    s = table(spark, sf, "supplier").select(F.lit("s").alias("side"), F.col("s_nationkey").alias("nation"), "s_suppkey")
    return c.unionByName(s, allowMissingColumns=True)


@query("SELECT user_id FROM events WHERE event_type = 'click' AND value > 90 INTERSECT SELECT user_id FROM events WHERE event_type = 'view' AND value > 90")
def set_intersect(spark, sf):
    e = table(spark, sf, "events").where("value > 90")
    return e.where("event_type = 'click'").select("user_id").intersect(e.where("event_type = 'view'").select("user_id"))


@query("SELECT user_id FROM events EXCEPT SELECT user_id FROM events WHERE event_type = 'view' AND value > 90")
def set_except(spark, sf):
    e = table(spark, sf, "events")
    return e.select("user_id").subtract(e.where("event_type = 'view' AND value > 90").select("user_id"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def set_distinct(spark, sf):
    return table(spark, sf, "events").dropDuplicates(["user_id", "event_type"]).select("user_id", "event_type")


@query("SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click')")
def set_missing_keys(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", F.col("event_id").cast("string").alias("k"))
    cached = e.where("event_type = 'click'").select(scalar.content_key("k").alias("cache_key"))
    return io.missing_keys(e, cached, ["k"]).select("event_id")


QUERIES, ORACLE = query.queries, query.oracle
