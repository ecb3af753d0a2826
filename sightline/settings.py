"""Parameters of a run and their checks."""

from __future__ import annotations

import math
from dataclasses import dataclass

NODATA = -32768
#: One degree in radians, as a single-precision constant; surfaces are sums of distance times it.
DEGREE = 0.0174533
EARTH_DIAMETER = 12_756_274.0
#: A slope below every visible one.
LOWEST_SLOPE = -2000.0


@dataclass(frozen=True)
class Settings:
    """width: cells along a side of the square grid. scale: metres between cells. subdivisions: angles per degree."""

    width: int
    scale: float = 1.0
    observer_height: float = 1.65
    refraction: float = 0.13
    subdivisions: int = 1
    neighbourhood: int | None = None
    centre: tuple[float, float] = (0.0, 0.0)

    def __post_init__(self):
        if self.width < 3 or self.width % 3:
            raise ValueError("the width must be a multiple of three")
        if not 1 <= self.subdivisions <= 100:
            raise ValueError("subdivisions must be in 1..100")
        if self.neighbourhood is not None and (self.neighbourhood < 1 or math.isqrt(self.neighbourhood) ** 2 != self.neighbourhood):
            raise ValueError("a neighbourhood must be a perfect square")
        if self.neighbourhood is not None and self.width % math.isqrt(self.neighbourhood):
            raise ValueError("the side of a neighbourhood must divide the width")
        if self.scale <= 0:
            raise ValueError("the scale must be positive")

    @property
    def reach(self) -> int:
        """Longest line of sight, in cells."""
        return self.width // 3

    @property
    def angles(self) -> int:
        return 360 * self.subdivisions
