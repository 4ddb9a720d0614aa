"""Projection, sun position and formats as column expressions."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of EPSG:25833: GRS80 axis and flattening, central meridian, scale, false easting.
A, FLAT, LON0, K0, EAST0 = 6378137.0, 1 / 298.257222101, 15.0, 0.9996, 500000.0
N = FLAT / (2 - FLAT)
RADIUS = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
FORWARD = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16, 13 * N**2 / 48 - 3 * N**3 / 5, 61 * N**3 / 240)
ECC = 2 * sqrt(N) / (1 + N)


def utm33(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing by the Krueger series."""
    phi, lam = F.radians(lat), F.radians(lon - LON0)
    t = F.sinh(F.atanh(F.sin(phi)) - ECC * F.atanh(ECC * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    north = xi + sum((c * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, c in enumerate(FORWARD, 1)), F.lit(0.0))
    east = eta + sum((c * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, c in enumerate(FORWARD, 1)), F.lit(0.0))
    return EAST0 + K0 * RADIUS * east, K0 * RADIUS * north


#: The inverse series and that from conformal to geodetic latitude.
INVERSE = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96, N**2 / 48 + N**3 / 15, 17 * N**3 / 480)
GEODETIC = (2 * N - 2 * N**2 / 3 - 2 * N**3, 7 * N**2 / 3 - 8 * N**3 / 5, 56 * N**3 / 15)


def lonlat(east: Column, north: Column) -> tuple[Column, Column]:
    """Longitude and latitude of an easting and northing: the series back."""
    xi, eta = north / (K0 * RADIUS), (east - EAST0) / (K0 * RADIUS)
    x = xi - sum((b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(INVERSE, 1)), F.lit(0.0))
    y = eta - sum((b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(INVERSE, 1)), F.lit(0.0))
    chi = F.asin(F.sin(x) / F.cosh(y))
    phi = chi + sum((d * F.sin(2 * j * chi) for j, d in enumerate(GEODETIC, 1)), F.lit(0.0))
    return LON0 + F.degrees(F.atan2(F.sinh(y), F.cos(x))), F.degrees(phi)


def envelope(west: Column, south: Column, east: Column, north: Column) -> list[Column]:
    """Least and greatest longitude and latitude of a square's four corners: west, south, east, north."""
    corners = [lonlat(x, y) for x in (west, east) for y in (south, north)]
    lon, lat = [c[0] for c in corners], [c[1] for c in corners]
    return [F.least(*lon), F.least(*lat), F.greatest(*lon), F.greatest(*lat)]


def convergence(lon: Column, lat: Column) -> Column:
    """Degrees between grid north and true north."""
    return F.degrees(F.atan(F.tan(F.radians(lon - LON0)) * F.sin(F.radians(lat))))


def cell_of(x: Column, y: Column, west: float, north: float, rows: Column, cols: Column, res: float = 10.0) -> tuple[Column, Column]:
    """Row and column of a point, both null outside of the raster."""
    r, c = F.floor((north - y) / res).cast("int"), F.floor((x - west) / res).cast("int")
    inside = (r >= 0) & (r < rows) & (c >= 0) & (c < cols)
    return F.when(inside, r), F.when(inside, c)


def finite(x: Column) -> Column:
    """Two places; what is no number is unknown."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.round(x, 2))


def octile(dr: Column, dc: Column) -> Column:
    """Metres between cells by straight and diagonal steps."""
    a, b = F.abs(dr), F.abs(dc)
    return 10.0 * (F.greatest(a, b) + (2**0.5 - 1) * F.least(a, b))


def portal(low: Column, size: Column, to_low: Column, to_size: Column) -> tuple[Column, Column]:
    """Along one axis, the cells where two blocks meet: the facing edges, or the middle of what they share."""
    high, to_high = low + size - 1, to_low + to_size - 1
    middle = F.floor((F.greatest(low, to_low) + F.least(high, to_high)) / 2)
    return F.when(high < to_low, high).when(to_high < low, low).otherwise(middle), F.when(high < to_low, to_low).when(to_high < low, to_high).otherwise(middle)


def local_instant(day: Column, hour: Column, zone: str = "Europe/Oslo") -> Column:
    """The UTC time of a wall-clock hour, also on days that change between summer and winter time."""
    return F.to_utc_timestamp(F.timestamp_seconds(F.unix_seconds(day.cast("timestamp")) + (hour * 3600).cast("long")), zone)


def incidence(slope: Column, aspect: Column, azimuth: Column, elevation: Column) -> Column:
    """Sine of the sun's height over a slope; flat ground takes that over the horizon."""
    up, s = F.radians(elevation), F.radians(slope)
    return F.when(slope < 0.001, F.sin(up)).otherwise(F.sin(up) * F.cos(s) + F.cos(up) * F.sin(s) * F.cos(F.radians(azimuth) - F.radians(aspect)))


def quadrant(degrees: Column) -> Column:
    d = F.pmod(degrees, F.lit(360.0))
    return F.when((d >= 315) | (d < 45), "N").when(d < 135, "E").when(d < 225, "S").when(d < 315, "W")


def duration(hours: Column) -> Column:
    """Hours as 'h h mm min'."""
    minutes = F.floor(hours * 60 + 0.5)
    return F.format_string("%d h %02d min", F.floor(minutes / 60), minutes % 60)


def expositions(bits: Column) -> Column:
    """The sectors of an eight-place string of 0 and 1, from north on; none if all are 0."""
    names = F.array(*[F.lit(x) for x in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")])
    chosen = F.filter(F.transform(names, lambda x, i: F.when(F.substring(bits, i + 1, F.lit(1)) == "1", x)), lambda x: x.isNotNull())
    return F.when(F.size(chosen) == 0, "none").otherwise(F.array_join(chosen, ", "))


def height_text(kind: Column, low: Column, high: Column) -> Column:
    """Which heights an exposed zone has: above, below, between two, or outside of them."""
    return (
        F.when(kind == 1, F.format_string("above %d m", low)).when(kind == 2, F.format_string("below %d m", low))
        .when(kind == 3, F.format_string("above %d m and below %d m", high, low)).when(kind == 4, F.format_string("%d-%d m", low, high)).otherwise("all heights")
    )


def solar(lat: Column, lon: Column, unix_seconds: Column) -> tuple[Column, Column]:
    """Azimuth and elevation in degrees without refraction, by the low-precision almanac series."""
    d = unix_seconds / 86400.0 - 10957.5
    g = F.radians(357.529 + 0.98560028 * d)
    q = 280.459 + 0.98564736 * d
    ecliptic = F.radians(q + 1.915 * F.sin(g) + 0.020 * F.sin(2 * g))
    tilt = F.radians(23.439 - 0.00000036 * d)
    right = F.atan2(F.cos(tilt) * F.sin(ecliptic), F.cos(ecliptic))
    declination = F.asin(F.sin(tilt) * F.sin(ecliptic))
    hour = F.radians(280.46061837 + 360.98564736629 * d + lon) - right
    phi = F.radians(lat)
    up = F.asin(F.sin(phi) * F.sin(declination) + F.cos(phi) * F.cos(declination) * F.cos(hour))
    around = F.atan2(F.sin(hour), F.cos(hour) * F.sin(phi) - F.tan(declination) * F.cos(phi))
    return F.pmod(F.degrees(around) + 180, F.lit(360.0)), F.degrees(up)


def compass(degrees: Column) -> Column:
    names = F.array(*[F.lit(x) for x in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")])
    return F.when(degrees.isNull(), "Unknown").otherwise(F.element_at(names, (F.pmod(F.floor(degrees / 45 + 0.5), F.lit(8)) + 1).cast("int")))


def clock(hour: Column) -> Column:
    """Hours as HH:MM."""
    minutes = F.floor(hour * 60 + 0.5)
    return F.format_string("%02d:%02d", F.floor(minutes / 60), minutes % 60)


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", "")


def block_of(node: Column) -> Column:
    """What stands before the last underscore, if there are two; else x."""
    return F.when(F.size(F.split(node, "_")) >= 3, F.regexp_replace(node, "_[^_]*$", "")).otherwise("x")
