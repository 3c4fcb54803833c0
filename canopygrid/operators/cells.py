"""Square evaluation cells of a regular sample grid.

Sample points sit at pixel-corner multiples of the spacing ``g``, starting one
spacing outside the grid.  Their Thiessen cells are squares centred on the
points, so a pixel's cell is plain integer arithmetic and every zonal
statistic is a group-by on ``(cell_r, cell_c)``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopygrid.grid import GridSpec
from canopygrid.lineage import cut

# A cell stays when it keeps more than this share of the fullest cell.
FULL_SHARE = 0.999


def spacing(grid_area_ha: float, grid: GridSpec) -> int:
    """Distance between sample points in pixels for a cell area in hectares."""
    g = int(math.sqrt(grid_area_ha * 10000)) // grid.step
    if g < 1:
        raise ValueError("the evaluation cell is smaller than a pixel")
    return g


def cell_index(position: str, g: int) -> Column:
    """Cell that holds a pixel row or column; a centre on a border goes to the higher cell."""
    return F.floor((F.col(position) * 2 + 1 + g) / (2 * g)).cast("int")


def with_cell(pixels: DataFrame, g: int, grid: GridSpec) -> DataFrame:
    """Add ``cell_r`` and ``cell_c``; pixels of unbounded border cells are dropped."""
    rows, cols = -(-grid.height // g), -(-grid.width // g)
    return (
        pixels.withColumn("cell_r", cell_index("row", g))
        .withColumn("cell_c", cell_index("col", g))
        .filter(F.col("cell_r").between(0, rows - 1) & F.col("cell_c").between(0, cols - 1))
    )


def zonal_sums(pixels: DataFrame, values: dict[str, str]) -> DataFrame:
    """Sum of each value per cell, NULL ignored, empty cells 0."""
    return pixels.groupBy("cell_r", "cell_c").agg(
        *[F.coalesce(F.sum(F.col(v).cast("double")), F.lit(0.0)).alias(name) for name, v in values.items()]
    )


def cell_coverage(pixels: DataFrame, area: str = "area", component: str | None = None) -> DataFrame:
    """Pixels of the area mask per cell, or per cell and mask component."""
    keys = ["cell_r", "cell_c"] + ([component] if component else [])
    return pixels.filter(F.col(area) == 1).groupBy(*keys).agg(F.count("*").alias("area_px"))


def edge_filter(coverage: DataFrame) -> DataFrame:
    """Cells that keep more than 99.9 % of the fullest cell's area."""
    fullest = coverage.agg(F.max("area_px")).scalar()
    full = coverage.filter(F.col("area_px") / fullest > FULL_SHARE)
    return full.groupBy("cell_r", "cell_c").agg(F.max("area_px").alias("area_px"))


def number_cells(cells: DataFrame) -> DataFrame:
    """Add ``cell_id``, consecutive from 1 in row-major order.

    Cells are numbered inside their cell row and shifted by the count of all
    rows above, so no window ever spans the whole table.
    """
    per_row = cells.groupBy("cell_r").agg(F.count("*").alias("_n"))
    # One entry per cell row: at most grid height / spacing.
    above = Window.orderBy("cell_r").rowsBetween(Window.unboundedPreceding, -1)
    shift = per_row.select("cell_r", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("cell_r").orderBy("cell_c")
    return (
        cells.join(shift, "cell_r")
        .withColumn("cell_id", (F.col("_shift") + F.row_number().over(inside)).cast("int"))
        .drop("_shift")
    )


def part_coverage(parts: DataFrame, g: int, grid: GridSpec) -> DataFrame:
    """Pixels per cell and connected part of the area mask (``row, col, component``)."""
    inside = with_cell(parts, g, grid).withColumn("area", F.lit(1))
    return cell_coverage(inside, "area", "component")


def evaluation_grid(
    pixels: DataFrame,
    grid: GridSpec,
    grid_area_ha: float,
    area: str = "area",
    mask: str = "mask",
    loss: str = "loss",
    density: str = "density",
    coverage: DataFrame | None = None,
) -> DataFrame:
    """Cells with area, actual, predicted and residual hectares.

    Whole cells are kept by the area mask without exclusions; the statistics
    then run over the mask with exclusions, and cells emptied by it vanish.
    Everything comes from one aggregation of the pixels, written out before its
    maximum is taken so that the pixels are read once.  ``coverage`` replaces
    the coverage per cell, for instance by ``part_coverage``.
    """
    inside = F.col(mask) == 1
    cells = cut(
        with_cell(pixels, spacing(grid_area_ha, grid), grid)
        .groupBy("cell_r", "cell_c")
        .agg(
            F.count(F.when(F.col(area) == 1, 1)).alias("area_px"),
            F.count(F.when(inside, 1)).alias("mask_px"),
            F.coalesce(F.sum(F.when(inside, F.col(loss))), F.lit(0)).alias("loss_px"),
            F.coalesce(F.sum(F.when(inside, F.col(density))), F.lit(0.0)).alias("pred_ha"),
        )
    )
    whole = edge_filter(cells if coverage is None else coverage)
    kept = cells.join(whole.select("cell_r", "cell_c"), ["cell_r", "cell_c"], "left_semi").filter("mask_px > 0")
    actual = F.col("loss_px") * grid.pixel_ha
    return number_cells(kept).select(
        "cell_id",
        "cell_r",
        "cell_c",
        (F.col("mask_px") * grid.pixel_ha).alias("area_ha"),
        actual.alias("actual_ha"),
        F.col("pred_ha"),
        (F.col("pred_ha") - actual).alias("residual_ha"),
    )
