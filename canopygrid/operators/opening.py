"""Morphological opening of strata: isolated pixels drop out before allocation.

Each tile receives a halo wide enough for all erosion and dilation steps, so
one shuffle of the pixels answers everything.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopygrid.grid import TILE
from canopygrid.operators.tiles import unpack, with_halo


def stratum_key(area: str = "area", region: str = "region") -> Column:
    """Stratum number of a forest pixel."""
    return (F.coalesce(F.col(area), F.lit(0)).cast("long") * 100000 + F.col(region) * 100 + 1).alias("stratum")


def _shifted(a: np.ndarray):
    """The four direct neighbours; 0 beyond the border."""
    wide = np.pad(a, 1)
    return wide[:-2, 1:-1], wide[2:, 1:-1], wide[1:-1, :-2], wide[1:-1, 2:]


def _open(labels: np.ndarray, steps: int) -> np.ndarray:
    """Per-label opening with a cross of ``steps`` iterations."""
    core = labels
    for _ in range(steps):
        keep = core != 0
        for near in _shifted(core):
            keep = keep & (near == core)
        core = np.where(keep, core, 0)
    for _ in range(steps):
        grown = core
        for near in _shifted(core):
            grown = np.where((grown == 0) & (near == labels), labels, grown)
        core = grown
    return core != 0


def _make_survivors(steps: int, halo: int, tile: int):
    def run(key: tuple[pa.Scalar, ...], pixels: pa.Table) -> pa.Table:
        tile_r, tile_c = unpack(key[0].as_py())
        top, left = tile_r * tile - halo, tile_c * tile - halo
        row = pixels.column("row").to_numpy().astype(np.int64) - top
        col = pixels.column("col").to_numpy().astype(np.int64) - left
        size = tile + 2 * halo
        values, codes = np.unique(pixels.column("stratum").to_numpy(), return_inverse=True)
        labels = np.zeros((size, size), dtype=np.int64)
        labels[row, col] = codes + 1
        alive = _open(labels, steps)[row, col]
        own = (row >= halo) & (row < size - halo) & (col >= halo) & (col < size - halo)
        return pixels.select(["row", "col", "stratum"]).filter(pa.array(alive & own))

    return run


def opened_pixels(pixels: DataFrame, kernel: int, tile: int = TILE) -> DataFrame:
    """``row, col, stratum`` of the pixels that survive opening with the given kernel size.

    The input holds one row per eligible pixel with its ``stratum``.
    """
    steps = int(kernel) // 2
    narrow = pixels.select("row", "col", F.col("stratum").cast("long").alias("stratum"))
    if steps == 0:
        return narrow
    halo = 2 * steps
    return (
        with_halo(narrow, halo, tile)
        .groupBy("tile")
        .applyInArrow(_make_survivors(steps, halo, tile), "row int, col int, stratum long")
    )
