"""Column expressions shared by the operators; all stay inside JVM codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
EARTH_RADIUS_M = 6371000.0
KM_PER_DEGREE = 111.32


def C(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rnd(x, digits: int = 6) -> Column:
    """Round for reporting; negative zero becomes zero.

    The nudge moves exact halves off the tie, so that the last bit of a sum,
    which depends on the order of addition, does not decide the digit.
    """
    return F.round(C(x) + 1e-9, digits) + F.lit(0.0)


# --- bands and indices -------------------------------------------------------

def normalised_difference(a, b, eps: float = 0.0) -> Column:
    """(a-b)/(a+b); NULL where the denominator is zero."""
    a, b = C(a), C(b)
    return F.try_divide(a - b, a + b + F.lit(eps)) if eps else F.try_divide(a - b, a + b)


def scaled(band, gain: float, offset: float = 0.0) -> Column:
    return C(band) * F.lit(gain) + F.lit(offset)


def bits_clear(flags, *bits: int) -> Column:
    """True where none of the given bits is set."""
    mask = reduce(lambda m, b: m | (1 << b), bits, 0)
    return C(flags).cast("int").bitwiseAND(F.lit(mask)) == 0


def harmonised(sensor, value, slopes: dict[str, tuple[float, float]]) -> Column:
    """Per-sensor linear map value*slope+intercept; other sensors pass through."""
    out = C(value)
    for name, (slope, intercept) in slopes.items():
        out = F.when(C(sensor) == name, C(value) * slope + intercept).otherwise(out)
    return out


def db_to_linear(db) -> Column:
    return F.pow(F.lit(10.0), C(db) / 10.0)


def linear_to_db(v) -> Column:
    """10*log10(v); NULL for non-positive power."""
    return F.when(C(v) > 0, F.log10(C(v)) * 10.0)


def wind_speed(u, v) -> Column:
    return F.hypot(C(u), C(v))


# --- calendar ---------------------------------------------------------------

def dekad_index(ts) -> Column:
    """Ten-day period of the year, 0..36 (the last days of December stay in 36)."""
    return F.least(F.floor((F.dayofyear(C(ts)) - 1) / 10), F.lit(36)).cast("int")


def mid_month_doy(year, month) -> Column:
    return F.dayofyear(F.make_date(C(year), C(month), F.lit(15)))


def season_year(ts, shift_days: int) -> Column:
    """Season a date belongs to when the season runs ``shift_days`` into the next year."""
    return F.year(F.date_sub(C(ts).cast("date"), shift_days))


def season_doy(ts, shift_days: int) -> Column:
    """Day of year counted on past December for the overlap of an extended season."""
    d = C(ts).cast("date")
    start = F.make_date(season_year(d, shift_days), F.lit(1), F.lit(1))
    return F.datediff(d, start) + 1


# --- geography ---------------------------------------------------------------

def haversine(lon1, lat1, lon2, lat2, radius: float = EARTH_RADIUS_KM) -> Column:
    p1, p2 = F.radians(C(lat1)), F.radians(C(lat2))
    dp = F.radians(C(lat2) - C(lat1))
    dl = F.radians(C(lon2) - C(lon1))
    a = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return F.asin(F.sqrt(a)) * (2 * radius)


def point_segment_km(lon, lat, lon1, lat1, lon2, lat2) -> Column:
    """Planar point-to-segment distance in a local equirectangular frame."""
    kx = F.cos(F.radians(C(lat))) * KM_PER_DEGREE
    ax, ay = (C(lon1) - C(lon)) * kx, (C(lat1) - C(lat)) * KM_PER_DEGREE
    bx, by = (C(lon2) - C(lon)) * kx, (C(lat2) - C(lat)) * KM_PER_DEGREE
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    t = F.when(len2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / len2)))
    t = F.coalesce(t, F.lit(0.0))
    px, py = ax + t * dx, ay + t * dy
    return F.sqrt(px * px + py * py)


def grid_cell(coord, size: float) -> Column:
    return F.floor(C(coord) / size).cast("long")


# --- text --------------------------------------------------------------------

def clean_name(name, aliases: dict[str, str] | None = None, fallback=None) -> Column:
    """Trim, title-case, map aliases; blank becomes ``fallback``."""
    n = F.initcap(F.trim(C(name)))
    n = F.nullif(n, F.lit(""))
    for wrong, right in (aliases or {}).items():
        n = F.when(n == wrong, F.lit(right)).otherwise(n)
    return F.coalesce(n, C(fallback)) if fallback is not None else n


# --- reproducible randomness -------------------------------------------------

def hash_key(*cols, seed: int | str = 42) -> Column:
    """md5 of the key and a seed: an order that no partitioning can change."""
    parts = [C(c).cast("string") for c in cols]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def hash_uniform(*cols, seed: int | str = 42) -> Column:
    """Uniform in [0,1) from the first 13 hex digits of the key's md5."""
    h = F.substring(hash_key(*cols, seed=seed), 1, 13)
    return F.conv(h, 16, 10).cast("double") / float(16**13)


def hash_bin(*cols, seed: int | str = 42, digits: int = 4) -> Column:
    """Leading hex digits of the md5 as an integer: monotone in ``hash_key``."""
    return F.conv(F.substring(hash_key(*cols, seed=seed), 1, digits), 16, 10).cast("int")
