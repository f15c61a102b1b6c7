"""Lambert conformal conic projection with two standard parallels."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LambertConic:
    """Projection parameters; angles in degrees, lengths in metres."""

    semi_major: float
    inverse_flattening: float
    parallel_1: float
    parallel_2: float
    origin_latitude: float
    central_meridian: float
    false_easting: float = 0.0
    false_northing: float = 0.0

    @property
    def eccentricity(self) -> float:
        f = 1.0 / self.inverse_flattening
        return math.sqrt(2.0 * f - f * f)

    def constants(self) -> tuple[float, float, float]:
        """Cone constant ``n``, scale ``a*F`` and radius at the origin."""
        e = self.eccentricity

        def parallel_radius(lat: float) -> float:
            return math.cos(lat) / math.sqrt(1.0 - (e * math.sin(lat)) ** 2)

        def conformal(lat: float) -> float:
            s = e * math.sin(lat)
            return math.tan(math.pi / 4 - lat / 2) / ((1 - s) / (1 + s)) ** (e / 2)

        p1, p2, p0 = (
            math.radians(v)
            for v in (self.parallel_1, self.parallel_2, self.origin_latitude)
        )
        n = math.log(parallel_radius(p1) / parallel_radius(p2)) / math.log(
            conformal(p1) / conformal(p2)
        )
        scale = self.semi_major * parallel_radius(p1) / (n * conformal(p1) ** n)
        return n, scale, scale * conformal(p0) ** n

    def project(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """Easting and northing of a longitude/latitude pair in degrees."""
        n, scale, radius_0 = self.constants()
        e = self.eccentricity
        phi = F.radians(lat)
        s = F.sin(phi) * e
        conformal = F.tan(math.pi / 4 - phi / 2.0) / F.pow((1.0 - s) / (1.0 + s), F.lit(e / 2))
        radius = F.pow(conformal, F.lit(n)) * scale
        angle = F.radians(lon - self.central_meridian) * n
        easting = radius * F.sin(angle) + self.false_easting
        northing = radius_0 - radius * F.cos(angle) + self.false_northing
        return easting, northing


# EPSG 3112 on the GRS80 ellipsoid.
GDA94_AUSTRALIA_LAMBERT = LambertConic(
    semi_major=6378137.0,
    inverse_flattening=298.257222101,
    parallel_1=-18.0,
    parallel_2=-36.0,
    origin_latitude=0.0,
    central_meridian=134.0,
)


# Halving masks that move the bits of a 32-bit number to every second place.
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def morton(x: Column, y: Column, x0: float | None, y0: float | None, x1: float | None, y1: float | None) -> Column:
    """Place of a point on a Z-order curve over the given extent, a non-negative BIGINT.

    31 bits per axis; points outside the extent count as on its edge. NULL if a
    coordinate or the extent is missing.
    """

    def bits(value: Column, lo: float | None, hi: float | None) -> Column:
        if lo is None or hi is None:
            return F.lit(None).cast("bigint")
        width = (hi - lo) or 1.0
        part = F.least(F.greatest((value - lo) / width, F.lit(0.0)), F.lit(1.0))
        cell = F.when(value.isNotNull(), F.floor(part * (2**31 - 1)).cast("bigint"))
        for shift, mask in _SPREAD:
            cell = cell.bitwiseOR(F.shiftleft(cell, shift)).bitwiseAND(F.lit(mask))
        return cell

    return bits(x, x0, x1).bitwiseOR(F.shiftleft(bits(y, y0, y1), 1))
