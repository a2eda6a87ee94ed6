"""The library's functions under SQL names; SQL bodies run inside the engine."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .geo import FINEST, KM

BODIES = {
    "haversine_km": (
        "lat1 DOUBLE, lng1 DOUBLE, lat2 DOUBLE, lng2 DOUBLE", "DOUBLE",
        f"CASE WHEN lat1 IS NULL OR lng1 IS NULL OR lat2 IS NULL OR lng2 IS NULL THEN NULL ELSE 2 * {KM} * asin(sqrt(least(1.0D, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lng2 - lng1) / 2), 2)))) END",
    ),
    "cell_id": ("lat DOUBLE, lng DOUBLE, res INT", "BIGINT", f"CASE WHEN lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 THEN shiftleft(cast(res AS BIGINT), 52) + floor((lat + 90) * pow(2, res - 1)) * {1 << FINEST + 2} + floor((lng + 180) * pow(2, res - 1)) END"),
    "cell_lat": ("h BIGINT", "DOUBLE", f"((shiftright(h, {FINEST + 2}) & {(1 << FINEST + 2) - 1}) + 0.5D) * pow(2, 1 - (shiftright(h, 52) & 15)) - 90"),
    "cell_lng": ("h BIGINT", "DOUBLE", f"((h & {(1 << FINEST + 2) - 1}) + 0.5D) * pow(2, 1 - (shiftright(h, 52) & 15)) - 180"),
    "purpose_of": ("p STRING", "STRING", "CASE WHEN upper(trim(p)) IN ('HOME', 'WORK') THEN upper(trim(p)) ELSE 'OTHER' END"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to ``spark.sql``; returns their names."""
    for name, (args, kind, body) in BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")

    @F.pandas_udf("bigint")
    def motif_id(path):
        from ..operators.profiles import motif_of

        return path.map(lambda p: motif_of(list(p)))

    spark.udf.register("motif_id", motif_id)

    class SplitMidnight:
        """(day, seg_start, seg_end) for each day that an interval touches."""

        def eval(self, arrival, departure):
            from datetime import datetime, time, timedelta

            while arrival is not None and departure is not None and arrival < departure:
                end = min(departure, datetime.combine(arrival.date() + timedelta(days=1), time()))
                yield arrival.date(), arrival, end
                arrival = end

    spark.udtf.register("split_midnight", F.udtf(SplitMidnight, returnType="day date, seg_start timestamp_ntz, seg_end timestamp_ntz"))
    return [*BODIES, "motif_id", "split_midnight"]
