"""UTM on WGS84 by the Krueger series, as Column expressions and as SQL text."""

from __future__ import annotations

from math import sqrt

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 and UTM.
SEMI_MAJOR, FLATTENING, SCALE, FALSE_EAST, FALSE_NORTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0

_N = FLATTENING / (2 - FLATTENING)
_A = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_E = 2 * sqrt(_N) / (1 + _N)
ALPHA = [_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280]
BETA = [_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280]
DELTA = [2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630]


def utm_zone(lon: Column) -> Column:
    """1 + the number of whole 6-degree strips east of -180; 180 itself gives 61, as in the source rule."""
    return F.floor(1 + (lon + 180) / 6).cast("int")


def is_northern(lat: Column) -> Column:
    return F.when(lat < 0, 0).otherwise(1)


def utm_forward(lon: Column, lat: Column, zone: Column | None = None) -> Column:
    """STRUCT<zone, northern, easting, northing> in metres; the zone may be given, as for a whole frame."""
    zone = utm_zone(lon) if zone is None else zone
    lam, phi = F.radians(lon - (zone * 6 - 183)), F.radians(lat)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - _E * F.atanh(_E * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    north = is_northern(lat)
    return F.struct(zone.cast("int").alias("zone"), north.alias("northern"), (FALSE_EAST + SCALE * _A * x).alias("easting"), (SCALE * _A * y + F.when(north == 1, 0.0).otherwise(FALSE_NORTH)).alias("northing"))


def utm_inverse(easting: Column, northing: Column, zone: Column, northern: Column) -> Column:
    """STRUCT<lon, lat> in degrees."""
    xi = (northing - F.when(northern == 1, 0.0).otherwise(FALSE_NORTH)) / (SCALE * _A)
    eta = (easting - FALSE_EAST) / (SCALE * _A)
    u, v = xi, eta
    for j, b in enumerate(BETA, 1):
        u = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    phi = chi
    for j, d in enumerate(DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.struct((F.degrees(F.atan2(F.sinh(v), F.cos(u))) + zone * 6 - 183).alias("lon"), F.degrees(phi).alias("lat"))


def utm_proj(lon: Column, lat: Column) -> Column:
    """The zone's PROJ text."""
    return F.concat(F.lit("+proj=utm +zone="), utm_zone(lon).cast("string"), F.when(is_northern(lat) == 1, " +north").otherwise(" +south"), F.lit(" +datum=WGS84 +units=m +no_defs"))


def utm_crs(lon: Column, lat: Column) -> Column:
    """STRUCT<proj, ellps, datum, units, zone, no_defs> of the zone on NAD83 / GRS80, whatever the hemisphere."""
    f = {"proj": F.lit("utm"), "ellps": F.lit("GRS80"), "datum": F.lit("NAD83"), "units": F.lit("m"), "zone": utm_zone(lon), "no_defs": F.lit(True)}
    return F.when(lon.isNotNull() & lat.isNotNull(), F.struct(*[v.alias(k) for k, v in f.items()]))


def forward_sql(lon: str, lat: str, zone: str) -> dict[str, str]:
    """easting and northing of utm_forward as SQL over the given SQL expressions."""
    lam, phi = f"radians({lon} - ({zone} * 6 - 183))", f"radians({lat})"
    t = f"sinh(atanh(sin({phi})) - {_E!r} * atanh({_E!r} * sin({phi})))"
    xi, eta = f"atan2({t}, cos({lam}))", f"atanh(sin({lam}) / sqrt(1 + {t} * {t}))"
    x = " + ".join([eta, *(f"{a!r} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, a in enumerate(ALPHA, 1))])
    y = " + ".join([xi, *(f"{a!r} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate(ALPHA, 1))])
    return {"easting": f"{FALSE_EAST} + {SCALE * _A!r} * ({x})", "northing": f"{SCALE * _A!r} * ({y}) + CASE WHEN {lat} < 0 THEN {FALSE_NORTH} ELSE 0 END"}


def forward_array(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(zone, easting, northing) of utm_forward for arrays."""
    zone = np.floor(1 + (lon + 180) / 6)
    lam, s = np.radians(lon - (zone * 6 - 183)), np.sin(np.radians(lat))
    t = np.sinh(np.arctanh(s) - _E * np.arctanh(_E * s))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
    x, y = eta.copy(), xi.copy()
    for j, a in enumerate(ALPHA, 1):
        x += a * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        y += a * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
    return zone, FALSE_EAST + SCALE * _A * x, SCALE * _A * y + np.where(lat < 0, FALSE_NORTH, 0.0)


def inverse_array(easting: np.ndarray, northing: np.ndarray, zone: np.ndarray, south: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lon, lat) of utm_inverse for arrays that broadcast."""
    xi, eta = (northing - np.where(south, FALSE_NORTH, 0.0)) / (SCALE * _A), (easting - FALSE_EAST) / (SCALE * _A)
    u, v = xi.copy(), eta.copy()
    for j, b in enumerate(BETA, 1):
        u -= b * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        v -= b * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
    chi = np.arcsin(np.sin(u) / np.cosh(v))
    phi = chi + sum(d * np.sin(2 * j * chi) for j, d in enumerate(DELTA, 1))
    return np.degrees(np.arctan2(np.sinh(v), np.cos(u))) + zone * 6 - 183, np.degrees(phi)


def circle_box_sql(name: str, table: str, key: str, lon: str, lat: str, radius: float) -> str:
    """CTEs that end in name_box (key, xmin, ymin, xmax, ymax): the envelope of 64 vertices around each position, taken back from UTM one by one."""
    f = forward_sql(lon, lat, "zone")
    terms = lambda coefficients, a, b, x, y: " ".join(f"- {c!r} * {a}({2 * j} * {x}) * {b}({2 * j} * {y})" for j, c in enumerate(coefficients, 1))
    phi = " ".join(f"+ {d!r} * sin({2 * j} * chi)" for j, d in enumerate(DELTA, 1))
    return f"""{name}_z AS (SELECT *, CAST(floor(1 + ({lon} + 180) / 6) AS INTEGER) AS zone FROM {table}),
{name}_u AS (SELECT {key}, zone, {lat} < 0 AS south, {f["easting"]} AS e, {f["northing"]} AS n FROM {name}_z),
{name}_v AS (SELECT {key}, zone, (n + {radius} * sin(k * pi() / 32) - CASE WHEN south THEN {FALSE_NORTH} ELSE 0 END) / {SCALE * _A!r} AS xi, (e + {radius} * cos(k * pi() / 32) - {FALSE_EAST}) / {SCALE * _A!r} AS eta FROM {name}_u, range(0, 64) ks(k)),
{name}_w AS (SELECT {key}, zone, xi {terms(BETA, "sin", "cosh", "xi", "eta")} AS u, eta {terms(BETA, "cos", "sinh", "xi", "eta")} AS v FROM {name}_v),
{name}_x AS (SELECT {key}, degrees(atan2(sinh(v), cos(u))) + zone * 6 - 183 AS x, asin(sin(u) / cosh(v)) AS chi FROM {name}_w),
{name}_box AS (SELECT {key}, min(x) AS xmin, min(degrees(chi {phi})) AS ymin, max(x) AS xmax, max(degrees(chi {phi})) AS ymax FROM {name}_x GROUP BY {key})"""
