"""Numbers as words."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from aerolens.functions.crs import METRES_PER_FOOT

# Fixed values.
SQUARE_FEET_PER_ACRE = 43560.0
FEET_PER_MILE = 5280.0


def grouped(value: Column, digits: int) -> Column:
    """Thousands separators and a fixed number of decimals, halves away from zero."""
    return F.format_number(F.round(value, digits), digits)


def fixed(value: Column, digits: int) -> Column:
    """Fixed decimals of a number from 0 up to 256, rounded on its exact binary value, halves up.

    The formatter rounds the shortest decimal form instead, which differs for every 0.xx5.
    """
    scale, unit = 10**digits, 2**55
    exact = (value * F.lit(float(unit))).cast("long").cast("decimal(38,0)")
    doubled = exact * F.lit(2 * scale).cast("decimal(8,0)") + F.lit(unit).cast("decimal(20,0)")
    whole = F.lit(2 * unit).cast("decimal(20,0)")
    steps = ((doubled - doubled % whole).cast("decimal(38,0)") / whole).cast("long")
    return F.format_string(f"%.{digits}f", steps.cast("double") / F.lit(float(scale)))


def _by_size(value: Column, limit: float, small: int, large: int) -> Column:
    return F.when(F.abs(value) < limit, grouped(value, small)).otherwise(grouped(value, large))


def length_text(feet: Column) -> Column:
    metres = feet * F.lit(METRES_PER_FOOT)
    small = F.abs(feet) < 1000
    pick = lambda v: F.when(small, grouped(v, 1)).otherwise(grouped(v, 0))
    miles = F.when(
        F.abs(feet) >= FEET_PER_MILE, F.concat(F.lit(" · "), grouped(feet / F.lit(FEET_PER_MILE), 2), F.lit(" mi"))
    ).otherwise("")
    return F.concat(pick(feet), F.lit(" ft ("), pick(metres), F.lit(" m"), miles, F.lit(")"))


def area_text(square_feet: Column) -> Column:
    acres = square_feet / F.lit(SQUARE_FEET_PER_ACRE)
    metres = square_feet * F.lit(METRES_PER_FOOT) * F.lit(METRES_PER_FOOT)
    return F.concat(
        F.when(square_feet < 1000, grouped(square_feet, 1)).otherwise(grouped(square_feet, 0)),
        F.lit(" ft² ("),
        F.when(acres < 10, grouped(acres, 3)).otherwise(grouped(acres, 1)),
        F.lit(" acres · "),
        F.when(metres < 1000, grouped(metres, 1)).otherwise(grouped(metres, 0)),
        F.lit(" m²)"),
    )


def short_area_text(square_feet: Column) -> Column:
    acres = F.concat(grouped(square_feet / F.lit(SQUARE_FEET_PER_ACRE), 2), F.lit(" acres"))
    feet = F.concat(F.when(square_feet < 1000, grouped(square_feet, 1)).otherwise(grouped(square_feet, 0)), F.lit(" ft²"))
    return F.when(square_feet >= SQUARE_FEET_PER_ACRE, acres).otherwise(feet)


def feet_text(feet: Column) -> Column:
    return F.concat(_by_size(feet, 1000.0, 1, 0), F.lit(" ft"))


def rise_text(feet: Column) -> Column:
    sign = F.when(feet > 0, "+").when(feet < 0, "−").otherwise("")
    size = F.abs(feet)
    pick = lambda v: F.when(size < 1000, grouped(v, 1)).otherwise(grouped(v, 0))
    return F.concat(sign, pick(size), F.lit(" ft ("), sign, pick(size * F.lit(METRES_PER_FOOT)), F.lit(" m)"))


def percent_text(fraction: Column) -> Column:
    return F.concat(grouped(fraction * F.lit(100.0), 1), F.lit("%"))


def iso_utc(ts: Column) -> Column:
    """A zoneless UTC timestamp as ISO text."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


def sidecar(url: Column) -> Column:
    """Address of the elevation patch next to a photo."""
    return F.regexp_replace(url, r"\.tif$", ".json")
