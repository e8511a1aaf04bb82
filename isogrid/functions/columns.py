"""Column expressions over observations, coordinates and labels; all built-in functions, so they stay in generated code."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

KELVIN = 273.15
#: Readings beyond this many degrees Celsius are fill values.
MOST_DEGREES = 100.0
EARTH_RADIUS = 6378137.0
EARTH_CIRCUMFERENCE = 2 * pi * EARTH_RADIUS


def celsius(kelvin: Column) -> Column:
    """Kelvin to Celsius; NaN and fill values become NULL."""
    value = kelvin - F.lit(KELVIN)
    return F.when(~F.isnan(kelvin) & (F.abs(value) <= MOST_DEGREES), value)


def season_of(month: Column) -> Column:
    """0 December to February, 1 March to May, 2 June to August, 3 September to November, by calendar year."""
    return F.floor((month % 12) / 3).cast("int")


def fractional_year(year: Column, month: Column) -> Column:
    return year + (month - 1) / F.lit(12.0)


def norm_lon(lon: Column) -> Column:
    """Longitude in -180..180 (180 itself stays)."""
    turned = F.pmod(lon, F.lit(360.0))
    return F.when(turned > 180, turned - 360).otherwise(turned)


def wrap_lon(lon: Column, low: float, high: float) -> Column:
    """Longitude moved by one turn towards the domain low..high, across the antimeridian."""
    up = F.when(lon < low, lon + 360).otherwise(lon)
    return F.when(up > high, up - 360).otherwise(up)


def in_bounds(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether a point lies in (south, north, west, east); a negative longitude is first moved up by one turn."""
    south, north, west, east = box
    return lat.between(south, north) & F.when(lon < 0, lon + 360).otherwise(lon).between(west, east)


def mercator_x(lon: Column, east_half: Column | None = None) -> Column:
    """Metres east of Greenwich; points of the half east of the antimeridian (lon -180..0) go on past it."""
    x = F.radians(lon) * EARTH_RADIUS
    return x if east_half is None else x + F.when(east_half, F.lit(EARTH_CIRCUMFERENCE)).otherwise(0.0)


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.lit(pi / 4) + F.radians(lat) / 2)) * EARTH_RADIUS


def lon_of(x: Column) -> Column:
    """Longitude 0..360 of a Mercator x."""
    return F.pmod(F.degrees(x / EARTH_RADIUS), F.lit(360.0))


def lat_of(y: Column) -> Column:
    return F.degrees(F.atan(F.sinh(y / EARTH_RADIUS)))


def edge_weight(lat: Column, lon: Column, box: tuple[float, float, float, float], lat_step: float, lon_step: float, cells: float) -> Column:
    """0 at the domain's edge and outside, rising to 1 at ``cells`` grid cells inside."""
    south, north, west, east = box
    distance = F.least((lat - south) / lat_step, (F.lit(north) - lat) / lat_step, (lon - west) / lon_step, (F.lit(east) - lon) / lon_step)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), distance / cells))


def anomaly_sign(value: Column) -> Column:
    """warm above 0, cold otherwise, NULL for none."""
    return F.when(value > 0, "warm").when(value.isNotNull(), "cold")


def fmt_coord(lat: Column, lon: Column) -> Column:
    """Degrees, minutes and hemisphere of a point."""

    def one(v: Column, plus: str, minus: str) -> Column:
        whole = F.floor(F.abs(v))
        minutes = F.floor((F.abs(v) - whole) * 60 + 0.5)
        return F.concat(whole.cast("string"), F.lit("°"), minutes.cast("string"), F.lit("′"), F.when(v >= 0, plus).otherwise(minus))

    return F.concat(one(lat, "N", "S"), F.lit(" "), one(lon, "E", "W"))


def fixed(value: Column, decimals: int) -> Column:
    """Text of the value, rounded half away from zero as a double; what rounds to zero from below keeps its sign, as in printf."""
    scale = 10.0**decimals
    return F.format_string(f"%.{decimals}f", F.round(F.abs(value) * scale, 0) / scale * F.signum(value))


def fmt_num(value: Column, decimals: int) -> Column:
    """Fixed decimals with a decimal comma; a dash for a missing value."""
    text = F.replace(fixed(value, decimals), F.lit("."), F.lit(","))
    return F.when(value.isNull(), "—").otherwise(text)


def p_value(r2: Column, n: Column) -> Column:
    """Two-sided p of a regression slope from R² and the number of points, by Student's t with n - 2 degrees of freedom.

    For whole degrees of freedom the distribution is a finite sum in the angle whose sine is r, so no statistics
    library is needed. NULL below 3 points.
    """
    df = (n - 2).cast("int")
    sine, cosine, angle = F.sqrt(r2), F.sqrt(F.greatest(F.lit(0.0), 1 - r2)), F.asin(F.least(F.lit(1.0), F.sqrt(r2)))
    odd = df % 2 == 1
    terms = F.when(odd, (df - 3) / 2).otherwise((df - 2) / 2).cast("int")
    steps = F.when(terms >= 1, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))
    step = lambda k: F.when(odd, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k)) * cosine * cosine
    first = F.when(odd, cosine).otherwise(F.lit(1.0))
    total = F.aggregate(steps, F.struct(first.alias("term"), first.alias("total")), lambda a, k: F.struct((a["term"] * step(k)).alias("term"), (a["total"] + a["term"] * step(k)).alias("total")), lambda a: a["total"])
    inside = F.when(df == 1, 2 * angle / pi).when(odd, (angle + sine * total) * (2 / pi)).otherwise(sine * total)
    return F.when(df >= 1, F.greatest(F.lit(0.0), 1 - inside))
