"""Map projection and datum shifts as Column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class TransverseMercator:
    """Parameters of one transverse-Mercator grid; defaults are the WGS84 ellipsoid."""

    lon0: float
    k0: float
    false_easting: float = 500_000.0
    false_northing: float = 0.0
    a: float = 6378137.0
    inv_f: float = 298.257223563


UTM_51N = TransverseMercator(lon0=123.0, k0=0.9996)
# The sampling windows name their grid by an EPSG number whose registry entry has its central meridian
# at 114 E; descriptions of the data speak of 120 E. The meridian is a parameter, the registry value the default.
SAMPLING_GRID = TransverseMercator(lon0=114.0, k0=1.0, inv_f=298.257222101)


def _series(tm: TransverseMercator) -> dict:
    """Krüger series coefficients to third order in the third flattening."""
    f = 1.0 / tm.inv_f
    n = f / (2.0 - f)
    big_a = tm.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    return {
        "n": n,
        "A": big_a,
        "alpha": (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240),
        "beta": (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480),
        "delta": (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15),
    }


def _atanh(x: Column) -> Column:
    return F.lit(0.5) * F.log((F.lit(1.0) + x) / (F.lit(1.0) - x))


def to_metric(lon: Column, lat: Column, tm: TransverseMercator = UTM_51N) -> tuple[Column, Column]:
    """Longitude/latitude in degrees to easting/northing in metres."""
    s = _series(tm)
    k = 2.0 * math.sqrt(s["n"]) / (1.0 + s["n"])
    sin_phi = F.sin(F.radians(lat))
    t = F.sinh(_atanh(sin_phi) - F.lit(k) * _atanh(F.lit(k) * sin_phi))
    dlon = F.radians(lon - F.lit(tm.lon0))
    xi = F.atan2(t, F.cos(dlon))
    eta = _atanh(F.sin(dlon) / F.sqrt(F.lit(1.0) + t * t))
    e_sum, n_sum = eta, xi
    for j, a in enumerate(s["alpha"], 1):
        e_sum = e_sum + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        n_sum = n_sum + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    scale = tm.k0 * s["A"]
    return F.lit(tm.false_easting) + F.lit(scale) * e_sum, F.lit(tm.false_northing) + F.lit(scale) * n_sum


def to_geographic(x: Column, y: Column, tm: TransverseMercator = UTM_51N) -> tuple[Column, Column]:
    """Easting/northing in metres back to longitude/latitude in degrees."""
    s = _series(tm)
    scale = tm.k0 * s["A"]
    xi = (y - F.lit(tm.false_northing)) / F.lit(scale)
    eta = (x - F.lit(tm.false_easting)) / F.lit(scale)
    xi1, eta1 = xi, eta
    for j, b in enumerate(s["beta"], 1):
        xi1 = xi1 - F.lit(b) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - F.lit(b) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi
    for j, d in enumerate(s["delta"], 1):
        phi = phi + F.lit(d) * F.sin(2 * j * chi)
    lon = F.lit(tm.lon0) + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1)))
    return lon, F.degrees(phi)


# Fixed values of the published Chinese datum shift: ellipsoid, polynomial and sine terms, validity box.
DATUM_A = 6378245.0
DATUM_E2 = 0.00669342162296594323
LAT_POLY = {"1": -100.0, "x": 2.0, "y": 3.0, "yy": 0.2, "xx": 0.0, "xy": 0.1, "sqrt": 0.2}
LON_POLY = {"1": 300.0, "x": 1.0, "y": 2.0, "yy": 0.0, "xx": 0.1, "xy": 0.1, "sqrt": 0.1}
# (amplitude, period divisor) of sin(pi * v / divisor); v is y for latitude, x for longitude
LAT_SINES = [(20.0, 1.0), (40.0, 3.0), (160.0, 12.0), (320.0, 30.0)]
LON_SINES = [(20.0, 1.0), (40.0, 3.0), (150.0, 12.0), (300.0, 30.0)]
CHINA_BOX = {"lon": (72.004, 137.8347), "lat": (0.8293, 55.8271)}
BD_OFFSET = {"lon": 0.0065, "lat": 0.006, "z": 0.00002, "theta": 0.000003}


def _shift_term(x: Column, y: Column, v: Column, poly: dict, sines: list) -> Column:
    pi = math.pi
    base = (
        F.lit(poly["1"])
        + poly["x"] * x
        + poly["y"] * y
        + poly["yy"] * y * y
        + poly["xx"] * x * x
        + poly["xy"] * x * y
        + poly["sqrt"] * F.sqrt(F.abs(x))
    )
    waves = 20.0 * F.sin(6.0 * pi * x) + 20.0 * F.sin(2.0 * pi * x)
    for amp, div in sines:
        waves = waves + amp * F.sin(v / div * pi)
    return base + waves * (2.0 / 3.0)


def wgs84_to_gcj02(lon: Column, lat: Column, passthrough: bool = True) -> tuple[Column, Column]:
    """WGS84 to GCJ-02; points outside the validity box stay unchanged when ``passthrough``."""
    x, y = lon - 105.0, lat - 35.0
    dlat = _shift_term(x, y, y, LAT_POLY, LAT_SINES)
    dlon = _shift_term(x, y, x, LON_POLY, LON_SINES)
    phi = F.radians(lat)
    m = F.lit(1.0) - DATUM_E2 * F.sin(phi) * F.sin(phi)
    glat = lat + F.degrees(dlat * m * F.sqrt(m) / (DATUM_A * (1.0 - DATUM_E2)))
    glon = lon + F.degrees(dlon * F.sqrt(m) / (DATUM_A * F.cos(phi)))
    if not passthrough:
        return glon, glat
    inside = lon.between(*CHINA_BOX["lon"]) & lat.between(*CHINA_BOX["lat"])
    return F.when(inside, glon).otherwise(lon), F.when(inside, glat).otherwise(lat)


def gcj02_to_wgs84(lon: Column, lat: Column, steps: int = 1) -> tuple[Column, Column]:
    """GCJ-02 back to WGS84: one correction step, or more for a tighter inverse."""
    if steps == 1:
        glon, glat = wgs84_to_gcj02(lon, lat, passthrough=False)
        return lon + lon - glon, lat + lat - glat

    def refine(acc: Column, _: Column) -> Column:
        glon, glat = wgs84_to_gcj02(acc.lon, acc.lat, passthrough=False)
        return F.struct((acc.lon + lon - glon).alias("lon"), (acc.lat + lat - glat).alias("lat"))

    # a fold binds the running point once per step; nested expressions would double in size each time
    start = F.struct(lon.cast("double").alias("lon"), lat.cast("double").alias("lat"))
    out = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, refine)
    return out.lon, out.lat


def gcj02_to_bd09(lon: Column, lat: Column) -> tuple[Column, Column]:
    w = math.pi * 3000.0 / 180.0
    z = F.sqrt(lon * lon + lat * lat) + BD_OFFSET["z"] * F.sin(lat * w)
    theta = F.atan2(lat, lon) + BD_OFFSET["theta"] * F.cos(lon * w)
    return z * F.cos(theta) + BD_OFFSET["lon"], z * F.sin(theta) + BD_OFFSET["lat"]


def wgs84_to_bd09(lon: Column, lat: Column) -> tuple[Column, Column]:
    return gcj02_to_bd09(*wgs84_to_gcj02(lon, lat))


# Fixed values of the map-link format.
MARKER_URL = "https://api.map.baidu.com/marker"
MARKER_CONTENT = "UBEM"
MARKER_SOURCE = "ubem.validation"


def marker_link(lon: Column, lat: Column, title: Column, coord_type: str = "wgs84") -> Column:
    """Map deep link with 7-decimal coordinates; ``bd09ll`` shifts the point first."""
    if coord_type == "bd09ll":
        lon, lat = wgs84_to_bd09(lon, lat)
    elif coord_type != "wgs84":
        raise ValueError(f"unsupported coord_type: {coord_type}")
    return F.concat(
        F.lit(f"{MARKER_URL}?location="),
        F.url_encode(F.format_string("%.7f,%.7f", lat, lon)),
        F.lit("&title="),
        F.url_encode(title),
        F.lit(f"&content={MARKER_CONTENT}&coord_type={coord_type}&output=html&src={MARKER_SOURCE}"),
    )


def cell_polygon_text(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Closed 5-corner box in GCJ-02 as ``lon,lat|lon,lat|...`` with six decimals."""
    corners = [(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin)]
    text = [F.format_string("%.6f,%.6f", *wgs84_to_gcj02(x, y, passthrough=False)) for x, y in corners]
    return F.concat_ws("|", *text)
