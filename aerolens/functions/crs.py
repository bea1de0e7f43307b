"""Coordinate systems: Kentucky Single Zone (EPSG:3089, US survey feet), WGS84 degrees, Web Mercator."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from aerolens.functions.angles import initial_bearing, js_round

# Fixed values of EPSG:3089: Lambert conformal conic with two standard parallels on GRS80.
SEMI_MAJOR_M = 6378137.0
INVERSE_FLATTENING = 298.257222101
STANDARD_PARALLELS = (37.08333333333334, 38.66666666666666)
ORIGIN_LAT, ORIGIN_LON = 36.33333333333334, -85.75
FALSE_EASTING_M, FALSE_NORTHING_M = 1500000.0, 999999.9998983998
FEET_PER_METRE = 3937 / 1200
METRES_PER_FOOT = 1200 / 3937

# Fixed values of the map scale: metres per 256-px-tile pixel at level 0, photo-native scale, Earth's girth in metres.
LEVEL0_METRES_PER_PIXEL = 156543.03392
NATIVE_SCALE = 256.0
EQUATOR_M = 40075016.686

_ECC = math.sqrt(2 / INVERSE_FLATTENING - 1 / INVERSE_FLATTENING**2)


def _cone() -> tuple[float, float, float]:
    """Cone constant, radius scale and radius of the origin (metres)."""

    def parallel(deg: float) -> tuple[float, float]:
        phi = math.radians(deg)
        s = _ECC * math.sin(phi)
        return math.cos(phi) / math.sqrt(1 - s * s), math.tan(math.pi / 4 - phi / 2) * math.exp(_ECC * math.atanh(s))

    (m1, t1), (m2, t2) = (parallel(p) for p in STANDARD_PARALLELS)
    n = math.log(m1 / m2) / math.log(t1 / t2)
    scale = SEMI_MAJOR_M * m1 / (n * t1**n)
    return n, scale, scale * parallel(ORIGIN_LAT)[1] ** n


CONE, RADIUS_SCALE, ORIGIN_RADIUS = _cone()


def _isometric(phi: Column) -> Column:
    return F.tan(F.lit(math.pi / 4) - phi / 2) * F.exp(F.lit(_ECC) * F.atanh(F.lit(_ECC) * F.sin(phi)))


def lonlat_to_grid(lon: Column, lat: Column) -> tuple[Column, Column]:
    """WGS84 degrees to grid feet."""
    radius = F.lit(RADIUS_SCALE) * F.pow(_isometric(F.radians(lat)), F.lit(CONE))
    theta = F.radians(lon - F.lit(ORIGIN_LON)) * F.lit(CONE)
    x = (F.lit(FALSE_EASTING_M) + radius * F.sin(theta)) * F.lit(FEET_PER_METRE)
    y = (F.lit(FALSE_NORTHING_M + ORIGIN_RADIUS) - radius * F.cos(theta)) * F.lit(FEET_PER_METRE)
    return x, y


def grid_to_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    """Grid feet to WGS84 degrees.

    Each latitude round shrinks the error by e^2 (below 0.007), so six rounds from the spherical start are beyond
    double precision. With the eccentricity term as exp(-e atanh(e sin)) a round reads the last one once, so the six
    are one flat chain of generated code: no loop, no array, no user function.
    """
    east = x / F.lit(FEET_PER_METRE) - F.lit(FALSE_EASTING_M)
    south = F.lit(ORIGIN_RADIUS + FALSE_NORTHING_M) - y / F.lit(FEET_PER_METRE)
    iso = F.pow(F.sqrt(east * east + south * south) / F.lit(RADIUS_SCALE), F.lit(1 / CONE))
    half_pi = F.lit(math.pi / 2)
    phi = half_pi - F.lit(2.0) * F.atan(iso)
    for _ in range(6):
        phi = half_pi - F.lit(2.0) * F.atan(iso * F.exp(F.lit(-_ECC) * F.atanh(F.lit(_ECC) * F.sin(phi))))
    return F.degrees(F.atan2(east, south) / F.lit(CONE)) + F.lit(ORIGIN_LON), F.degrees(phi)


def lonlat_to_world(lon: Column, lat: Column) -> tuple[Column, Column]:
    """WGS84 degrees to the Web Mercator unit square, y southward."""
    y = F.lit(0.5) - F.atanh(F.sin(F.radians(lat))) / F.lit(2 * math.pi)
    return (lon + F.lit(180.0)) / F.lit(360.0), y


def world_to_lonlat(wx: Column, wy: Column) -> tuple[Column, Column]:
    """Web Mercator unit square to WGS84 degrees."""
    lat = F.degrees(F.atan(F.sinh((F.lit(0.5) - wy) * F.lit(2 * math.pi))))
    return wx * F.lit(360.0) - F.lit(180.0), lat


def world_per_metre(lat: Column) -> Column:
    """Unit-square length of one metre at a latitude."""
    return F.lit(1.0) / (F.lit(EQUATOR_M) * F.cos(F.radians(lat)))


def grid_bearing_to_true(x: Column, y: Column, bearing: Column, step: float = 1000.0) -> Column:
    """A grid bearing as a true one, from a step of 1,000 ft along it."""
    b = F.radians(bearing)
    lon1, lat1 = grid_to_lonlat(x, y)
    lon2, lat2 = grid_to_lonlat(x + F.lit(step) * F.sin(b), y + F.lit(step) * F.cos(b))
    return initial_bearing(lon1, lat1, lon2, lat2)


def tile_level(zoom: Column) -> Column:
    """Zoom of 512-px tiles as the level of 256-px tiles."""
    return zoom + F.lit(1)


def map_scale(zoom: Column, lat: Column, dpi: Column | float = 96.0) -> Column:
    """Denominator N of the map scale 1:N."""
    dpi = dpi if isinstance(dpi, Column) else F.lit(float(dpi))
    per_pixel = F.lit(LEVEL0_METRES_PER_PIXEL) * F.cos(F.radians(lat)) / F.pow(F.lit(2.0), tile_level(zoom))
    return per_pixel * dpi / F.lit(0.0254)


def native_state(scale: Column) -> tuple[Column, Column]:
    """(coarser | native | enlarged within 5%, enlargement factor) of a map scale against the photos' own."""
    times = F.lit(NATIVE_SCALE) / scale
    state = F.when(times > 1.05, "enlarged").when(times >= 1 / 1.05, "native").otherwise("coarser")
    return state, times


def scale_text(zoom: Column, lat: Column) -> Column:
    """One-line readout of level, scale and native state."""
    scale = map_scale(zoom, lat)
    state, times = native_state(scale)
    tail = (
        F.when(state == "native", " · native")
        .when(state == "enlarged", F.concat(F.lit(" · enlarged "), F.format_string("%.1f", times), F.lit("×")))
        .otherwise("")
    )
    head = F.concat(F.lit("Level "), F.format_string("%.1f", tile_level(zoom).cast("double")), F.lit(" · 1:"))
    return F.concat(head, F.format_number(js_round(scale), 0), tail)
