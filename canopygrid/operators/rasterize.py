"""Division polygons to pixels by the pixel-centre rule.

A scanline form of the even-odd rule: every polygon edge is expanded to the
pixel rows whose centre line it crosses, and crossings of a row are paired into
column spans.  One sweep along each grid row turns its overlapping spans into
disjoint runs of the feature on top, painted into blocks of columns.  Pixels meet
their block by an equi-join and read their place in it, however many polygons overlap there.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopygrid.grid import GridSpec

# Id inside the mask without a polygon, and of the first polygon.
BACKGROUND = 1
FIRST_DIVISION = 2
COLUMN_BLOCK = 256


def polygon_spans(polygons: DataFrame, grid: GridSpec) -> DataFrame:
    """``seq, row, first_col, last_col`` covered by each polygon.

    ``polygons`` has ``seq`` (feature order from 0) and ``ring``, an array of
    ``struct<x, y>``; several rings with one ``seq`` form holes or parts.
    """
    edges = polygons.select(
        "seq",
        F.posexplode(F.arrays_zip(F.col("ring").alias("p"), F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1)).alias("q"))),
    ).select(
        "seq",
        # Pixel coordinates: centre of pixel (r, c) is (c + 0.5, r + 0.5).
        ((F.col("col.p.x") - grid.origin_x) / abs(grid.pixel_x)).alias("x0"),
        ((grid.origin_y - F.col("col.p.y")) / abs(grid.pixel_y)).alias("y0"),
        ((F.col("col.q.x") - grid.origin_x) / abs(grid.pixel_x)).alias("x1"),
        ((grid.origin_y - F.col("col.q.y")) / abs(grid.pixel_y)).alias("y1"),
    )
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    first = F.greatest(F.ceil(low - 0.5), F.lit(0))
    last = F.least(F.ceil(high - 0.5) - 1, F.lit(grid.height - 1))
    crossings = (
        edges.withColumn("_first", first)
        .withColumn("_last", last)
        .filter("_first <= _last")
        .withColumn("row", F.explode(F.sequence(F.col("_first").cast("int"), F.col("_last").cast("int"))))
        .select(
            "seq",
            "row",
            (F.col("x0") + (F.col("row") + 0.5 - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))).alias("x"),
        )
    )
    order = Window.partitionBy("seq", "row").orderBy("x")
    paired = crossings.withColumn("n", F.row_number().over(order)).withColumn("end", F.lead("x").over(order))
    return (
        paired.filter("n % 2 = 1")
        .select(
            "seq",
            "row",
            F.greatest(F.ceil(F.col("x") - 0.5), F.lit(0)).cast("int").alias("first_col"),
            F.least(F.ceil(F.col("end") - 0.5) - 1, F.lit(grid.width - 1)).cast("int").alias("last_col"),
        )
        .filter("first_col <= last_col")
    )


def top_runs(first: np.ndarray, last: np.ndarray, seq: np.ndarray) -> list[tuple[int, int, int]]:
    """Disjoint runs ``(first, last, seq)`` of the greatest ``seq`` among spans that cover a column."""
    order = np.argsort(first, kind="stable")
    starts, ends, tops = first[order].tolist(), last[order].tolist(), seq[order].tolist()
    open_: list[tuple[int, int]] = []
    out = []
    at, col = 0, 0
    while at < len(starts) or open_:
        if not open_:
            col = starts[at]
        while at < len(starts) and starts[at] <= col:
            heapq.heappush(open_, (-tops[at], ends[at]))
            at += 1
        while open_ and open_[0][1] < col:
            heapq.heappop(open_)
        if open_:
            top, end = open_[0]
            # Until it ends, or until the next span begins.
            end = min(end, starts[at] - 1) if at < len(starts) else end
            out.append((col, end, -top))
            col = end + 1
    return out


def _painted(spans: pa.Table) -> pa.Table:
    """The blocks of one grid row: the feature on top of each column, or nothing."""
    runs = top_runs(*(spans.column(c).to_numpy() for c in ("first_col", "last_col", "seq")))
    block = runs[0][0] // COLUMN_BLOCK
    left = block * COLUMN_BLOCK
    line = np.full((runs[-1][1] // COLUMN_BLOCK + 1) * COLUMN_BLOCK - left, -1, dtype=np.int32)
    for first, last, seq in runs:
        line[first - left : last - left + 1] = seq
    tops = line.reshape(-1, COLUMN_BLOCK)
    used = np.flatnonzero((tops >= 0).any(axis=1))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(used) + 1) * COLUMN_BLOCK, COLUMN_BLOCK, dtype=np.int32)), pa.array(tops[used].ravel()))
    row = np.full(len(used), spans.column("row")[0].as_py(), dtype=np.int32)
    return pa.table({"row": pa.array(row), "block": pa.array(used + block, pa.int64()), "tops": lists})


def rasterize_divisions(
    pixels: DataFrame, polygons: DataFrame, grid: GridSpec, mask: str = "mask", output: str = "division"
) -> DataFrame:
    """Add the division id: 2, 3, … in feature order, later features on top.

    Inside the mask without a polygon the id is 1; outside the mask NULL.
    """
    spans = polygon_spans(polygons, grid).select("row", F.col("seq").cast("int").alias("seq"), "first_col", "last_col")
    blocks = spans.groupBy("row").applyInArrow(_painted, "row int, block long, tops array<int>")
    cover = blocks.select(F.col("row").alias("_row"), F.col("block").alias("_block"), F.col("tops").alias("_tops"))
    here = (F.col("row") == F.col("_row")) & (F.floor(F.col("col") / COLUMN_BLOCK) == F.col("_block"))
    joined = pixels.join(cover, here, "left")
    found = F.get("_tops", F.pmod("col", F.lit(COLUMN_BLOCK)))
    top = F.when(found >= 0, found)
    value = F.when(F.col(mask) == 1, F.coalesce(top + FIRST_DIVISION, F.lit(BACKGROUND)).cast("int"))
    return joined.withColumn(output, value).select(*pixels.columns, output)
