"""Bearings and angle arithmetic, degrees clockwise from north."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Compass names by eighth of a turn, and how each oblique camera looks relative to the flight.
WINDS = ["north", "northeast", "east", "southeast", "south", "southwest", "west", "northwest"]
LOOK_OFFSET = {"Fwd": 0, "Bwd": 180, "Left": -90, "Right": 90}


def js_round(value: Column) -> Column:
    """Nearest whole number, halves toward +infinity."""
    return F.floor(value + F.lit(0.5))


def round_to(value: Column, digits: int) -> Column:
    """Decimal rounding with halves toward +infinity, NULL kept."""
    scale = float(10**digits)
    return js_round(value * F.lit(scale)).cast("double") / F.lit(scale)


def full_turn(angle: Column) -> Column:
    """The same direction in [0, 360)."""
    turn = F.lit(360.0)
    return (angle % turn + turn) % turn


def half_turn(angle: Column) -> Column:
    """The same direction in [-180, 180)."""
    return (angle % F.lit(360.0) + F.lit(540.0)) % F.lit(360.0) - F.lit(180.0)


def bearing_gap(a: Column, b: Column) -> Column:
    """Unsigned difference of two bearings, in [0, 180]."""
    shifted = a - b + F.lit(540.0)
    return F.abs(shifted - F.lit(360.0) * F.floor(shifted / F.lit(360.0)) - F.lit(180.0))


def initial_bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle bearing at the first place toward the second."""
    dlon = F.radians(lon2 - lon1)
    p, q = F.radians(lat1), F.radians(lat2)
    east = F.sin(dlon) * F.cos(q)
    north = F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(dlon)
    return full_turn(F.degrees(F.atan2(east, north)))


def compass_name(bearing: Column) -> Column:
    """Nearest of the eight winds."""
    slot = js_round(full_turn(bearing) / F.lit(45.0)).cast("int") % F.lit(8)
    return F.element_at(F.array(*[F.lit(w) for w in WINDS]), slot + F.lit(1))


def look_offset(camera: Column) -> Column:
    """Offset of a camera's look from the direction of flight; NULL for the nadir camera."""
    out = F.lit(None).cast("double")
    for name, offset in LOOK_OFFSET.items():
        out = F.when(camera == name, F.lit(float(offset))).otherwise(out)
    return out


def flight_heading(camera: Column, look: Column, track: Column) -> Column:
    """Grid heading of the aircraft: from an oblique's look where known, otherwise the ground track."""
    return F.coalesce(full_turn(look - look_offset(camera)), track)
