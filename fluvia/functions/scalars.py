"""Scalar column expressions: rounding, seasons, units, distances, interpolation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FT_PER_M = 3.280839895
FT_PER_MILE = 5280.0
FT2_PER_ACRE = 43560.0
FT2_PER_YD2 = 9.0
EARTH_MILES = 3958.8


def clip(x: Column, low: float, high: float) -> Column:
    """Null stays null; least and greatest alone would skip it."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def half_even(x: Column) -> Column:
    return F.bround(x, 0).cast("bigint")


def finite(x: Column) -> Column:
    """Infinities and NaN become null."""
    x = F.nanvl(x, F.lit(None).cast("double"))
    return F.when(F.abs(x) != F.lit(float("inf")), x)


def harmonics(day: Column, order: int = 2) -> dict[str, Column]:
    """Sine and cosine of the day of the year, and the month."""
    out = {}
    for k in range(1, order + 1):
        angle = 2 * k * F.pi() * F.dayofyear(day) / 365.25
        out |= {f"sin{k}": F.sin(angle), f"cos{k}": F.cos(angle)}
    return out | {"month": F.month(day).cast("bigint")}


def lerp(low: Column, high: Column, share: Column) -> Column:
    return low * (1 - share) + high * share


def share_between(x: Column, low: Column, high: Column) -> Column:
    """Place of x from low to high; the middle of a span of nothing."""
    return F.when(high == low, 0.5).otherwise((x - low) / (high - low))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle miles."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_MILES * F.asin(F.sqrt(a))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees clockwise from north, on a plane scaled at the middle latitude."""
    east = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.pmod(F.degrees(F.atan2(east, lat2 - lat1)), F.lit(360.0))


def utm(lat: Column, lon: Column, central: float = -93.0) -> tuple[Column, Column]:
    """Easting and northing in metres on the WGS 84 transverse Mercator zone around ``central``, by the usual series."""
    a, e2, k0 = 6378137.0, 0.00669437999014, 0.9996
    ep2 = e2 / (1 - e2)
    phi, dl = F.radians(lat), F.radians(lon - central)
    n = a / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    t, c, m = F.pow(F.tan(phi), 2), ep2 * F.pow(F.cos(phi), 2), dl * F.cos(phi)
    e4, e6 = e2**2, e2**3
    arc = a * ((1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * phi - (3 * e2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * F.sin(2 * phi) + (15 * e4 / 256 + 45 * e6 / 1024) * F.sin(4 * phi) - 35 * e6 / 3072 * F.sin(6 * phi))
    east = k0 * n * (m + (1 - t + c) * F.pow(m, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(m, 5) / 120) + 500000.0
    north = k0 * (arc + n * F.tan(phi) * (m * m / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(m, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * F.pow(m, 6) / 720))
    return east, north


def travel_days(miles: Column, speed: Column) -> Column:
    """Whole days of travel, at least one; a distance of nothing takes one day."""
    return F.when(miles == 0, F.lit(1)).otherwise(F.greatest(F.lit(1), half_even(miles / speed))).cast("bigint")


def adaptive_speed(q: Column, base: float = 100.0, reference: float | None = None, power: float = 0.4) -> Column:
    """Miles a day for a discharge (0.05 at least): base times (q / reference) to the power; q is already a ratio without a reference."""
    safe = F.greatest(q, F.lit(0.05))
    return base * F.pow(safe if reference is None else safe / reference, power)


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^a-zA-Z0-9_]", "_")


def cache_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *parts))


def pixel(east: Column, north: Column, left: float, top: float, size: float = 30.0) -> tuple[Column, Column]:
    """Row and column of the raster cell at a place, from the raster's upper left corner, halves to even."""
    return half_even((F.lit(top) - north) / size), half_even((east - F.lit(left)) / size)


def feet(metres: Column) -> Column:
    return metres * FT_PER_M


def metres(feet_: Column) -> Column:
    return feet_ / FT_PER_M
