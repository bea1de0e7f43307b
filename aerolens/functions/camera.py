"""Pinhole camera: ground to photo and back, as columns.

`Rig` names the columns of one photo: position, the nine rotation terms (see `rotation`) and the lens.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from aerolens.functions.angles import initial_bearing
from aerolens.functions.crs import grid_to_lonlat

ROTATION = [f"r{i}{j}" for i in range(3) for j in range(3)]
EDGE_FADE = 0.02


def rotation(omega: Column, phi: Column, kappa: Column) -> dict[str, Column]:
    """World-to-camera rotation from the three orientation angles in degrees."""
    so, co = F.sin(F.radians(omega)), F.cos(F.radians(omega))
    sp, cp = F.sin(F.radians(phi)), F.cos(F.radians(phi))
    sk, ck = F.sin(F.radians(kappa)), F.cos(F.radians(kappa))
    terms = [
        ck * cp, sk * co + ck * sp * so, sk * so - ck * sp * co,
        -sk * cp, ck * co - sk * sp * so, ck * so + sk * sp * co,
        sp, -cp * so, cp * co,
    ]
    return dict(zip(ROTATION, terms))


def with_rotation(frames: DataFrame) -> DataFrame:
    """Add the rotation once per photo, so that pairs of photo and point only multiply and add."""
    return frames.withColumns(rotation(F.col("omega"), F.col("phi"), F.col("kappa")))


def mounted_at_angle(prefix: str = "") -> Column:
    """Photos the model does not apply to: a lens mounted at an angle."""
    return sum((F.coalesce(F.col(prefix + c), F.lit(0.0)) != 0).cast("int") for c in ("cam_omega_dg", "cam_phi_dg", "cam_kappa_dg")) > 0


@dataclass(frozen=True)
class Rig:
    """The columns of a photo, under an optional prefix such as `f.`."""

    prefix: str = ""

    def __getitem__(self, name: str) -> Column:
        return F.col(self.prefix + name)

    @property
    def width(self) -> Column:
        return self["cam_width_px"]

    @property
    def height(self) -> Column:
        return self["cam_height_px"]

    @property
    def pixel_mm(self) -> Column:
        return self["cam_ccd_res_u"] / F.lit(1000.0)

    def to_pixel(self, x: Column, y: Column, z: Column) -> tuple[Column, Column]:
        """Column and row in the full-size photo; NULL for a place behind the camera."""
        d = [x - self["x"], y - self["y"], z - self["z"]]
        v = [sum(self[f"r{i}{j}"] * d[j] for j in range(3)) for i in range(3)]
        ahead = F.when(v[2] < 0, v[2])
        f = self["cam_focal_mm"]
        col = self.width / F.lit(2.0) + (-f * v[0] / ahead + self["cam_ppx_mm"]) / self.pixel_mm
        row = self.height / F.lit(2.0) - (-f * v[1] / ahead + self["cam_ppy_mm"]) / self.pixel_mm
        return col, row

    def to_ground(self, col: Column, row: Column, z: Column) -> tuple[Column, Column]:
        """Place where a pixel's ray meets the level plane at `z`; NULL when it does not."""
        v = [
            (col - self.width / F.lit(2.0)) * self.pixel_mm - self["cam_ppx_mm"],
            (self.height / F.lit(2.0) - row) * self.pixel_mm - self["cam_ppy_mm"],
            -self["cam_focal_mm"],
        ]
        d = [sum(self[f"r{j}{i}"] * v[j] for j in range(3)) for i in range(3)]
        s = (z - self["z"]) / F.nullif(d[2], F.lit(0.0))
        s = F.when(s > 0, s)
        return self["x"] + s * d[0], self["y"] + s * d[1]

    def corner_pixels(self) -> list[tuple[Column, Column]]:
        zero = F.lit(0.0)
        w, h = self.width.cast("double"), self.height.cast("double")
        return [(zero, zero), (w, zero), (w, h), (zero, h)]

    def corners_lonlat(self, z: Column) -> list[tuple[Column, Column]]:
        """The photo's corners on the plane as degrees, in photo order."""
        return [grid_to_lonlat(*self.to_ground(c, r, z)) for c, r in self.corner_pixels()]

    def up_bearing(self, z: Column) -> Column:
        """True bearing from the middle of the bottom edge to the middle of the top edge, on the plane."""
        half = self.width / F.lit(2.0)
        low = grid_to_lonlat(*self.to_ground(half, self.height.cast("double"), z))
        high = grid_to_lonlat(*self.to_ground(half, F.lit(0.0), z))
        return initial_bearing(*low, *high)

    def fade(self, col: Column, row: Column) -> Column:
        """How much of the photo shows at a pixel: 0 at its edge, rising smoothly to 1 within 2% of its short side."""
        w, h = self.width, self.height
        within = (col >= 0) & (col <= w) & (row >= 0) & (row <= h)
        t = F.least(col, w - col, row, h - row) / (F.lit(EDGE_FADE) * F.least(w, h))
        t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
        return F.coalesce(F.when(within, t * t * (F.lit(3.0) - F.lit(2.0) * t)), F.lit(0.0))
