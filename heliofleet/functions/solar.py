"""Local time and sun position as column arithmetic (no per-row library, no join)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def localize(ts: Column, zone: str) -> Column:
    """Naive local time to a UTC instant; NULL if that local time does not exist or is ambiguous."""
    naive = ts.cast("timestamp")
    utc = F.to_utc_timestamp(naive, zone)
    hour = F.expr("INTERVAL 1 HOUR")
    twice = (F.from_utc_timestamp(utc + hour, zone) == naive) | (F.from_utc_timestamp(utc - hour, zone) == naive)
    return F.when((F.from_utc_timestamp(utc, zone) == naive) & ~twice, utc)


def solar_noon_and_half_day(day: Column, latitude: float, longitude: float) -> tuple[Column, Column]:
    """Solar noon in UTC minutes of the day, and half the day length in minutes.

    Low-precision series in the fractional year for declination and equation of time, with the
    sun's centre 90.833 degrees from the zenith. Good to about two minutes at temperate
    latitudes; half the day is NULL where the sun does not cross the horizon.
    """
    g = (F.dayofyear(day).cast("double") - 0.5) * (2 * math.pi / 365.0)
    equation = (
        0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g)
        - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g)
    ) * 229.18
    declination = (
        0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g)
        - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g)
        - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)
    )
    phi, horizon = math.radians(latitude), math.radians(90.833)
    cosine = math.cos(horizon) / math.cos(phi) / F.cos(declination) - math.tan(phi) * F.tan(declination)
    half_day = F.nanvl(F.degrees(F.acos(cosine)) * 4, F.lit(None).cast("double"))
    return F.lit(720.0 - 4.0 * longitude) - equation, half_day


def sun_times(ts: Column, latitude: float, longitude: float) -> tuple[Column, Column]:
    """Sunrise and sunset instants (UTC, whole seconds) of the calendar date of ``ts``."""
    day = F.to_date(ts)
    noon, half_day = solar_noon_and_half_day(day, latitude, longitude)
    midnight = F.unix_seconds(day.cast("timestamp"))
    return tuple(F.timestamp_seconds(midnight + F.round(m * 60)) for m in (noon - half_day, noon + half_day))


def sunlit(ts: Column, latitude: float, longitude: float, zone: str) -> Column:
    """True when the local reading lies between sunrise and sunset, both included."""
    day = F.to_date(ts)
    noon, half_day = solar_noon_and_half_day(day, latitude, longitude)
    minute = (F.unix_micros(localize(ts, zone)) - F.unix_micros(day.cast("timestamp"))) / 60_000_000
    return F.coalesce(F.abs(minute - noon) <= half_day, F.lit(False))
