"""4-connected components of a binary mask.

Pixels are labelled inside tiles first; only tile-border contacts become graph
edges.  The edges are then contracted by alternating star rounds, which need a
logarithmic number of steps, each checkpointed.  Where only counts of parts are wanted,
tiles hand on their counts and their border pixels; no other pixel meets its root.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopygrid.grid import TILE, GridSpec
from canopygrid.lineage import cut, materialise
from canopygrid.operators.tiles import unpack, with_tile


def _label_runs(flags: np.ndarray) -> np.ndarray:
    """Component number per tile pixel: runs per row, merged where rows touch."""
    padded = np.zeros((flags.shape[0], flags.shape[1] + 1), dtype=bool)
    padded[:, 1:] = flags
    starts = padded[:, 1:] & ~padded[:, :-1]
    run = np.cumsum(starts.ravel()).reshape(starts.shape) - 1
    run[~flags] = -1
    touch = flags[1:] & flags[:-1]
    final = _smallest_linked(run.max() + 1, run[:-1][touch], run[1:][touch])
    return np.where(run >= 0, final[run], -1)


def _smallest_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` numbers the smallest one that links lead to: every round hangs roots below smaller ones, then shortens all paths."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return root
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _local_names(key: tuple[pa.Scalar, ...], pixels: pa.Table, width: int, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and local component of a tile's pixels."""
    tile_r, tile_c = unpack(key[0].as_py())
    top, left = tile_r * tile, tile_c * tile
    row = pixels.column("row").to_numpy().astype(np.int64)
    col = pixels.column("col").to_numpy().astype(np.int64)
    flags = np.zeros((tile, tile), dtype=bool)
    flags[row - top, col - left] = True
    label = _label_runs(flags)[row - top, col - left]
    # Name a component after its smallest pixel position in the whole grid.
    smallest = np.full(label.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(smallest, label, row * width + col)
    return row, col, smallest[label]


def _make_local(width: int, tile: int):
    schema = pa.schema([("row", pa.int32()), ("col", pa.int32()), ("local", pa.int64())])

    def run(key: tuple[pa.Scalar, ...], pixels: pa.Table) -> pa.Table:
        row, col, local = _local_names(key, pixels, width, tile)
        return pa.table([pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)), pa.array(local)], schema=schema)

    return run


def _make_counted(width: int, tile: int, g: int):
    schema = pa.schema([("border", pa.bool_()), ("row", pa.int32()), ("col", pa.int32()), ("local", pa.int64()), ("n", pa.int64())])

    def run(key: tuple[pa.Scalar, ...], pixels: pa.Table) -> pa.Table:
        row, col, local = _local_names(key, pixels, width, tile)
        edge = (row % tile == 0) | (row % tile == tile - 1) | (col % tile == 0) | (col % tile == tile - 1)
        cells = np.stack([(2 * row + 1 + g) // (2 * g), (2 * col + 1 + g) // (2 * g), local])
        cells, n = np.unique(cells, axis=1, return_counts=True)
        outer, inner = int(edge.sum()), len(n)
        return pa.table(
            [
                pa.array(np.r_[np.ones(outer, dtype=bool), np.zeros(inner, dtype=bool)]),
                pa.array(np.r_[row[edge], cells[0]].astype(np.int32)),
                pa.array(np.r_[col[edge], cells[1]].astype(np.int32)),
                pa.array(np.r_[local[edge], cells[2]]),
                pa.array(np.r_[np.ones(outer, dtype=np.int64), n]),
            ],
            schema=schema,
        )

    return run


def _links(local: DataFrame, tile: int) -> DataFrame:
    """Contacts ``u, v`` of local components across tile borders."""
    links = None
    for axis in ("row", "col"):
        # Last line of a tile against the first line of the next tile.
        near = local.filter((F.col(axis) + 1) % tile == 0).select("row", "col", F.col("local").alias("u"))
        far = local.filter((F.col(axis) % tile == 0) & (F.col(axis) > 0)).select(
            *[(F.col(a) - 1 if a == axis else F.col(a)).alias(a) for a in ("row", "col")], F.col("local").alias("v")
        )
        pair = near.join(far, ["row", "col"]).select("u", "v")
        links = pair if links is None else links.unionByName(pair)
    return links.distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over edges ``u > v``.

    The minimum is a partially combined aggregate.  It is stored before it is joined
    back on the node: both sides of that join are then plain shuffles, which the
    adaptive skew join can split for a node with very many neighbours.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
    joined = both.join(low, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
    return out.filter("u <> v").distinct()


def contract(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``u -> v`` with ``v`` the smallest node connected to ``u``, for every non-minimal node."""
    ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    current = cut(ordered.distinct())
    mark = None
    for _ in range(max_rounds):
        current = cut(_star(_star(current, True), False))
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            return current
        mark = tuple(now)
    raise RuntimeError("components did not settle")


def mask_components(pixels: DataFrame, grid: GridSpec, mask: str = "mask", tile: int = TILE) -> DataFrame:
    """``row, col, component`` for mask pixels; the id is the component's first pixel position."""
    inside = with_tile(pixels.filter(F.col(mask) == 1).select("row", "col"), tile)
    local = materialise(
        inside.groupBy("tile").applyInArrow(
            _make_local(grid.width, tile), "row int, col int, local long"
        )
    )
    roots = contract(_links(local, tile))
    return local.join(roots, local.local == roots.u, "left").select(
        "row", "col", F.coalesce("v", "local").alias("component")
    )


def parts_of_cells(pixels: DataFrame, grid: GridSpec, g: int, mask: str = "mask", tile: int = TILE) -> DataFrame:
    """``cell_r, cell_c, component, area_px``: mask pixels of each evaluation cell by connected part.

    Cells are those of spacing ``g`` that lie whole in the sample grid.  A tile
    is reduced to its counts by cell and local part and to its border pixels;
    the counts, not the pixels, meet the roots.
    """
    inside = with_tile(pixels.filter(F.col(mask) == 1).select("row", "col"), tile)
    parts = materialise(
        inside.groupBy("tile").applyInArrow(_make_counted(grid.width, tile, g), "border boolean, row int, col int, local long, n long")
    )
    roots = contract(_links(parts.filter("border"), tile))
    rows, cols = -(-grid.height // g), -(-grid.width // g)
    counts = parts.filter("NOT border").filter(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1))
    named = counts.join(roots, F.col("local") == F.col("u"), "left")
    return named.groupBy(F.col("row").alias("cell_r"), F.col("col").alias("cell_c"), F.coalesce("v", "local").alias("component")).agg(F.sum("n").alias("area_px"))
