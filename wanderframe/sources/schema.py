"""Columns by role: which physical column holds the user, the time, the place and so on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import lenient_double, lenient_timestamp

# Candidate names of each role, in order of preference.
ROLES = {
    "datetime": ("datetime", "start_timestamp", "timestamp", "check-in_time", "start_time", "_start_time", "checkin_time", "time", "date"),
    "lat": ("lat", "latitude"),
    "lng": ("lng", "lon", "longitude", "long"),
    "uid": ("uid", "user_id", "user", "agent_id", "userid"),
    "duration": ("duration_minutes", "duration", "trip_duration_minutes", "duration_hours"),
    "activity": ("purpose", "activity", "act", "location_type", "category", "purpose_d"),
    "location": ("location_id", "tile_id", "Code_INSEE_D", "area", "venueId", "location"),
    "end": ("end_timestamp", "_end_time", "end_time"),
    "mode": ("mode", "transport_mode", "transport", "travel_mode", "trip_mode", "vehicle_mode"),
}


def find(df: DataFrame, role: str) -> str | None:
    """The first candidate of the role that ``df`` has, in whatever case."""
    have = {c.lower(): c for c in reversed(df.columns)}
    return next((have[n.lower()] for n in ROLES[role] if n.lower() in have), None)


def require(df: DataFrame, *names: str) -> None:
    """Raise with the list of columns that are missing."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


@dataclass(frozen=True)
class TrajSchema:
    """The four columns of a trajectory table."""

    uid: str
    datetime: str
    lat: str
    lng: str

    @classmethod
    def detect(cls, df: DataFrame) -> TrajSchema:
        got = {r: find(df, r) for r in ("uid", "datetime", "lat", "lng")}
        if missing := [r for r, n in got.items() if n is None]:
            raise ValueError(f"no column for: {', '.join(missing)} among {', '.join(df.columns)}")
        return cls(**got)


def canonical(df: DataFrame, schema: TrajSchema | None = None) -> DataFrame:
    """Columns uid, datetime, lat, lng with lenient casts, and all others as they are."""
    s = schema or TrajSchema.detect(df)
    taken = {s.uid, s.datetime, s.lat, s.lng}
    rest = [F.col(f"`{c}`") for c in df.columns if c not in taken and c not in ("uid", "datetime", "lat", "lng")]
    return df.select(F.col(f"`{s.uid}`").alias("uid"), lenient_timestamp(F.col(f"`{s.datetime}`")).alias("datetime"), lenient_double(F.col(f"`{s.lat}`")).alias("lat"), lenient_double(F.col(f"`{s.lng}`")).alias("lng"), *rest)


def padded(df: DataFrame, **defaults: str) -> DataFrame:
    """Null columns of the given SQL types for those that ``df`` lacks."""
    return df.withColumns({n: F.lit(None).cast(t) for n, t in defaults.items() if n not in df.columns})
