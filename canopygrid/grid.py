"""Grid geometry shared by every layer of a run."""

from __future__ import annotations

from dataclasses import dataclass

# Side of a square tile in pixels.  A tile is the unit of grouped work wherever
# an operator needs neighbourhoods, so one task never holds more than
# TILE * TILE pixels of a layer.
TILE = 256


@dataclass(frozen=True)
class GridSpec:
    """Size, pixel size and position of a co-registered grid."""

    height: int
    width: int
    pixel_x: float = 30.0
    pixel_y: float = 30.0
    origin_x: float = 0.0
    origin_y: float = 0.0
    crs: str = "EPSG:32618"

    @property
    def pixel_ha(self) -> float:
        """Area of one pixel in hectares."""
        return abs(self.pixel_x * self.pixel_y) / 10000.0

    @property
    def step(self) -> int:
        """Pixel size as a whole number of map units (bin width, lowest class edge)."""
        return int(self.pixel_x)

    def square(self) -> float:
        """Pixel side; distances need square pixels."""
        if abs(self.pixel_x) != abs(self.pixel_y):
            raise ValueError("distances need square pixels")
        return abs(self.pixel_x)
