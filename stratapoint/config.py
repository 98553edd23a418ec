"""Settings of index building and of level-of-detail selection, checked on construction."""

from __future__ import annotations

import math
from dataclasses import dataclass


def clamped(value, fallback: float, low: float | None = None, high: float | None = None) -> float:
    """A number given as text or number, between the limits; the fallback for what is no finite number."""
    try:
        number = float(value)
    except (TypeError, ValueError):
        return fallback
    if not math.isfinite(number):
        return fallback
    number = number if low is None else max(low, number)
    return number if high is None else min(high, number)


@dataclass(frozen=True)
class IndexConfig:
    """How deep a tile tree goes and how many points a tile's sample holds."""

    tile_sample_points: int = 25_000
    grid_cells: int = 32
    min_diagonal: float = 100.0
    max_depth: int = 8

    def __post_init__(self):
        if not 1 <= self.min_diagonal <= 5000:
            raise ValueError("min_diagonal lies between 1 and 5000 metres")
        object.__setattr__(self, "max_depth", max(1, math.floor(self.max_depth + 0.5)))
        if self.max_depth > 16:
            raise ValueError("max_depth is 16 at most")
        if self.tile_sample_points < 1 or self.grid_cells < 1:
            raise ValueError("samples need at least one point and one cell")

    def depth_for(self, diagonal: float) -> int:
        """The least depth at which a root of this diagonal has small enough tiles."""
        depth = 0
        while depth < self.max_depth and diagonal / 2**depth > self.min_diagonal:
            depth += 1
        return depth


@dataclass(frozen=True)
class LodConfig:
    """From which angle on a tile is refined, and how much smaller the angle must get before it is closed again."""

    threshold_degrees: float = 15.0
    hysteresis: float = 0.1

    def __post_init__(self):
        if not 1 <= self.threshold_degrees <= 90:
            raise ValueError("the threshold lies between 1 and 90 degrees")
        if not 0 <= self.hysteresis <= 0.5:
            raise ValueError("the hysteresis lies between 0 and 0.5")


@dataclass(frozen=True)
class Bounds:
    """A box in metres. Reversed limits are swapped and an axis without extent is widened by a centimetre each way."""

    min_x: float
    min_y: float
    max_x: float
    max_y: float
    min_z: float | None = None
    max_z: float | None = None

    def __post_init__(self):
        for axis in "xyz":
            lo, hi = getattr(self, f"min_{axis}"), getattr(self, f"max_{axis}")
            if lo is None:
                continue
            lo, hi = min(lo, hi), max(lo, hi)
            if lo == hi:
                lo, hi = lo - 0.01, hi + 0.01
            object.__setattr__(self, f"min_{axis}", lo)
            object.__setattr__(self, f"max_{axis}", hi)

    @property
    def solid(self) -> bool:
        return self.min_z is not None

    @property
    def diagonal(self) -> float:
        return math.hypot(self.max_x - self.min_x, self.max_y - self.min_y, self.max_z - self.min_z if self.solid else 0.0)
