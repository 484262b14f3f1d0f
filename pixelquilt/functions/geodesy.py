"""Grid, distance and projection formulas as column expressions."""
from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from ..schema import CELL_M, ORIGIN_TOLERANCE, RES

# fixed values: sphere of the terrain operator, WGS84 ellipsoid, UTM and Web Mercator constants
EARTH_RADIUS = 6371008.8
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
UTM_SCALE, UTM_EASTING, UTM_NORTHING_SOUTH = 0.9996, 500000.0, 10000000.0
METRES_PER_DEGREE_LON, METRES_PER_DEGREE_LAT = 111320.0, 110574.0
SNAP = 0.01


def cell_name(x0: Column, y1: Column) -> Column:
    return F.format_string("x%dy%d", F.rint(x0).cast("long"), F.rint(y1).cast("long"))


def snap_origin_x(minx: Column) -> Column:
    return F.floor(minx / RES + SNAP) * RES


def snap_origin_y(maxy: Column) -> Column:
    return F.ceil(maxy / RES - SNAP) * RES


def pixel_centre(origin: Column, index: Column, res: float = RES, downwards: bool = False) -> Column:
    return origin - (index + 0.5) * res if downwards else origin + (index + 0.5) * res


def fractional_index(affine: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """(column, row) of a point in the pixel-centre convention of the affine [a, b, c, d, e, f]."""
    a, b, c, d, e, f = (affine[i] for i in range(6))
    det = a * e - b * d
    dx, dy = x - c, y - f
    return (e * dx - b * dy) / det - 0.5, (a * dy - d * dx) / det - 0.5


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), F.lit(2)) + F.cos(p) * F.cos(q) * F.pow(
        F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2))
    return F.lit(2 * EARTH_RADIUS) * F.asin(F.sqrt(h))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p, q, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2) - F.radians(lon1)
    return F.degrees(F.atan2(F.sin(dl) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(dl)))


def utm_epsg(lon: Column, lat: Column) -> Column:
    zone = F.least(F.greatest(F.floor((lon + 180.0) / 6.0) + 1, F.lit(1)), F.lit(60))
    return (F.when(lat >= 0, 32600).otherwise(32700) + zone).cast("int")


def resolution_m(rx: Column, ry: Column, geographic: Column, lat: Column, unit: Column | None = None) -> Column:
    """Pixel size in metres: the coarser axis; geographic pixels shrink with cos(latitude)."""
    planar = F.greatest(F.abs(rx), F.abs(ry)) * (unit if unit is not None else F.lit(1.0))
    degrees = F.greatest(F.abs(rx) * METRES_PER_DEGREE_LON * F.cos(F.radians(lat)),
                         F.abs(ry) * METRES_PER_DEGREE_LAT)
    return F.when(geographic, degrees).otherwise(planar)


def on_grid(same_crs: Column, res_x: Column, res_y: Column, x: Column, y: Column, x0: Column, y1: Column) -> Column:
    """The raster corner lies on the 10 m grid of (x0, y1), within the origin tolerance."""
    dx, dy = (x - x0) / RES, (y - y1) / RES
    return (same_crs & (F.abs(res_x - RES) <= 1e-6) & (F.abs(res_y + RES) <= 1e-6)
            & (F.abs(dx - F.rint(dx)) * RES <= ORIGIN_TOLERANCE) & (F.abs(dy - F.rint(dy)) * RES <= ORIGIN_TOLERANCE))


def grid_position(x0: Column, y1: Column, gx0, gy1) -> Column:
    """STRUCT<row, col> of a cell corner on the grid, NULL when it is off the grid."""
    c, r = (x0 - gx0) / CELL_M, (F.lit(gy1) - y1) / CELL_M if not isinstance(gy1, Column) else (gy1 - y1) / CELL_M
    fits = ((F.abs(c - F.rint(c)) * CELL_M <= ORIGIN_TOLERANCE) & (F.abs(r - F.rint(r)) * CELL_M <= ORIGIN_TOLERANCE))
    return F.when(fits, F.struct(F.rint(r).cast("int").alias("row"), F.rint(c).cast("int").alias("col")))


# ---- Krueger series of the transverse Mercator projection (third-flattening expansion to order 4) ----
_N = WGS84_F / (2 - WGS84_F)
_RADIUS = WGS84_A / (1 + _N) * (1 + _N ** 2 / 4 + _N ** 4 / 64)
_FORWARD = (_N / 2 - 2 * _N ** 2 / 3 + 5 * _N ** 3 / 16 + 41 * _N ** 4 / 180,
            13 * _N ** 2 / 48 - 3 * _N ** 3 / 5 + 557 * _N ** 4 / 1440,
            61 * _N ** 3 / 240 - 103 * _N ** 4 / 140,
            49561 * _N ** 4 / 161280)
_INVERSE = (_N / 2 - 2 * _N ** 2 / 3 + 37 * _N ** 3 / 96 - _N ** 4 / 360,
            _N ** 2 / 48 + _N ** 3 / 15 - 437 * _N ** 4 / 1440,
            17 * _N ** 3 / 480 - 37 * _N ** 4 / 840,
            4397 * _N ** 4 / 161280)
_LATITUDE = (2 * _N - 2 * _N ** 2 / 3 - 2 * _N ** 3 + 116 * _N ** 4 / 45,
             7 * _N ** 2 / 3 - 8 * _N ** 3 / 5 - 227 * _N ** 4 / 45,
             56 * _N ** 3 / 15 - 136 * _N ** 4 / 35,
             4279 * _N ** 4 / 630)


def _central_meridian(zone: Column) -> Column:
    return F.radians(zone * 6.0 - 183.0)


def utm_forward(lon: Column, lat: Column, epsg: Column) -> tuple[Column, Column]:
    """(easting, northing) of a WGS84 lon / lat in the UTM zone of the EPSG code (326zz north, 327zz south)."""
    zone, south = epsg % 100, epsg >= 32700
    e = 2 * math.sqrt(_N) / (1 + _N)
    s, dl = F.sin(F.radians(lat)), F.radians(lon) - _central_meridian(zone)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    north, east = xi, eta
    for j, a in enumerate(_FORWARD, 1):
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    k = UTM_SCALE * _RADIUS
    return UTM_EASTING + k * east, F.when(south, UTM_NORTHING_SOUTH).otherwise(0.0) + k * north


def utm_inverse(x: Column, y: Column, epsg: Column) -> tuple[Column, Column]:
    """(lon, lat) in degrees of a UTM easting / northing."""
    zone, south = epsg % 100, epsg >= 32700
    k = UTM_SCALE * _RADIUS
    xi = (y - F.when(south, UTM_NORTHING_SOUTH).otherwise(0.0)) / k
    eta = (x - UTM_EASTING) / k
    xi0, eta0 = xi, eta
    for j, b in enumerate(_INVERSE, 1):
        xi0 = xi0 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta0 = eta0 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi0) / F.cosh(eta0))
    lat = chi
    for j, d in enumerate(_LATITUDE, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.degrees(_central_meridian(zone) + F.atan2(F.sinh(eta0), F.cos(xi0))), F.degrees(lat)


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return (F.radians(lon) * WGS84_A,
            F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * WGS84_A)


_E2 = WGS84_F * (2 - WGS84_F)        # squared eccentricity


def _authalic(sin_lat: Column | float) -> Column:
    """Area between the equator and a latitude, in units that give the pole _authalic(1)."""
    s, e = sin_lat if isinstance(sin_lat, Column) else F.lit(sin_lat), _E2 ** 0.5
    return (1 - _E2) * (s / (1 - _E2 * s * s) + F.log((1 + e * s) / (1 - e * s)) / (2 * e))


def area_to_equator(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Signed area in square metres between the equator and the shorter way from one point (degrees) to the other:
    the spherical excess on the sphere with the ellipsoid's areas."""
    pole = _authalic(1.0)

    def half(lat: Column) -> Column:
        ratio = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), _authalic(F.sin(F.radians(lat))) / pole))
        return F.tan(F.asin(ratio) / 2)

    t1, t2 = half(lat1), half(lat2)
    turn = F.pmod(lon2 - lon1 + 180.0, F.lit(360.0)) - 180.0
    return F.atan(F.tan(F.radians(turn) / 2) * (t1 + t2) / (1 + t1 * t2)) * pole * (WGS84_A * WGS84_A)
