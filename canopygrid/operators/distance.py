"""Exact Euclidean distance to the nearest target pixel.

The transform is separable: the squared distance of a pixel is the minimum over
columns ``c`` of ``(col - c)^2 + dy(c)^2``, where ``dy(c)`` is the vertical
distance to the nearest target in column ``c``.  Work is split into square
tiles so that no task ever holds a whole row or column of the grid:

1. each (column, tile row) is reduced to its first and last target, and one
   window over the tile rows carries the nearest target above and below;
2. each tile turns targets plus carried values into the few parabolas per row
   that can win outside the tile;
3. per grid row the lower envelope of these parabolas tells each tile which of
   them can win inside it;
4. each tile combines its own targets with the carried values and the incoming
   parabolas.

Pixels are shuffled once, into a table bucketed by tile that steps 2 and 4 both
read where it lies; a layer that is stored so already is not shuffled at all.  All
arithmetic is on integers, so results do not depend on the tiling; the square root
is taken last.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopygrid.grid import TILE, GridSpec
from canopygrid.lineage import materialise
from canopygrid.operators.tiles import block_of, clustered, tile_key, unpack

FAR = np.int64(2**62)


def _ints(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _filled(table: pa.Table, name: str, default: int) -> np.ndarray:
    return table.column(name).cast(pa.int64()).fill_null(default).to_numpy(zero_copy_only=False)


def _vertical(flags: np.ndarray, top: int, above: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Squared vertical distance per tile pixel; FAR where the column has no target."""
    rows = np.arange(top, top + flags.shape[0], dtype=np.int64)[:, None]
    last = np.where(flags, rows, -FAR)
    last[0] = np.maximum(last[0], above)
    last = np.maximum.accumulate(last, axis=0)
    nxt = np.where(flags, rows, FAR)
    nxt[-1] = np.minimum(nxt[-1], below)
    nxt = np.minimum.accumulate(nxt[::-1], axis=0)[::-1]
    gap = np.minimum(np.where(last == -FAR, FAR, rows - last), np.where(nxt == FAR, FAR, nxt - rows))
    known = gap < FAR
    return np.where(known, np.where(known, gap, 0) ** 2, FAR)


def _carried(hints: pa.Table, layer: int, left: int, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest target row above and below the tile, per tile column."""
    above = np.full(tile, -FAR)
    below = np.full(tile, FAR)
    use = (_ints(hints, "kind") == 0) & (_ints(hints, "layer") == layer)
    col = _ints(hints, "x")[use] - left
    above[col] = _filled(hints, "a", -FAR)[use]
    below[col] = _filled(hints, "b", FAR)[use]
    return above, below


def _flags(pixels: pa.Table, layer: int, top: int, left: int, tile: int) -> np.ndarray:
    flags = np.zeros((tile, tile), dtype=bool)
    hit = (_ints(pixels, "targets") >> layer) & 1 == 1
    flags[_ints(pixels, "row")[hit] - top, _ints(pixels, "col")[hit] - left] = True
    return flags


def _outgoing(square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tile pixels whose parabola can win left or right of the tile.

    A parabola loses everywhere beyond a border if another one starting nearer
    to that border is no higher at the border.
    """
    width = square.shape[1]
    known = square < FAR
    offset = np.arange(width, dtype=np.int64)[None, :]
    keep = np.zeros_like(known)
    for reach, order in ((width - offset, slice(None, None, -1)), (offset + 1, slice(None))):
        height = np.where(known, square + reach**2, FAR)[:, order]
        best = np.minimum.accumulate(height, axis=1)
        first = np.empty_like(known)
        first[:, 0] = True
        first[:, 1:] = height[:, 1:] < best[:, :-1]
        keep |= first[:, order] & known
    return np.nonzero(keep)


def _horizontal(square: np.ndarray) -> np.ndarray:
    """Minimum over tile columns of squared offset plus vertical square."""
    out = square.copy()
    width = square.shape[1]
    for k in range(1, width):
        # No pixel farther than the farthest one so far can still gain.
        if k % 8 == 1 and k * k >= out.max():
            break
        step = np.int64(k * k)
        np.minimum(out[:, k:], square[:, :-k] + step, out=out[:, k:])
        np.minimum(out[:, :-k], square[:, k:] + step, out=out[:, :-k])
    return out


def _envelope(c: list[int], g: list[int]) -> tuple[list[int], list[float]]:
    """Lower envelope of parabolas ``(x - c)^2 + g`` for ascending ``c``.

    Returns the winning indices and the positions where each starts to win.
    """
    keep: list[int] = []
    start: list[float] = []
    for i in range(len(c)):
        begin = float("-inf")
        while keep:
            j = keep[-1]
            begin = ((g[i] + c[i] * c[i]) - (g[j] + c[j] * c[j])) / (2.0 * (c[i] - c[j]))
            if begin > start[-1]:
                break
            keep.pop()
            start.pop()
            begin = float("-inf")
        keep.append(i)
        start.append(begin)
    return keep, start


def _make_outgoing(layers: int, tile: int):
    schema = pa.schema([("layer", pa.int32()), ("row", pa.int32()), ("c", pa.int32()), ("g", pa.int64())])

    def run(key, pixels: pa.Table, hints: pa.Table) -> pa.Table:
        top, left = (block * tile for block in unpack(key[0].as_py()))
        parts = []
        for layer in range(layers):
            above, below = _carried(hints, layer, left, tile)
            square = _vertical(_flags(pixels, layer, top, left, tile), top, above, below)
            r, c = _outgoing(square)
            parts.append(
                pa.table(
                    [
                        pa.array(np.full(len(r), layer, dtype=np.int32)),
                        pa.array((r + top).astype(np.int32)),
                        pa.array((c + left).astype(np.int32)),
                        pa.array(square[r, c]),
                    ],
                    schema=schema,
                )
            )
        return pa.concat_tables(parts)

    return run


def _make_incoming(tile: int, blocks: int):
    schema = pa.schema(
        [("tile", pa.int64()), ("layer", pa.int32()), ("row", pa.int32()), ("c", pa.int32()), ("g", pa.int64())]
    )

    def run(key: tuple[pa.Scalar, ...], lines: pa.Table) -> pa.Table:
        layer, row = key[0].as_py(), key[1].as_py()
        c, g = _ints(lines, "c"), _ints(lines, "g")
        order = np.argsort(c, kind="stable")
        c, g = c[order].tolist(), g[order].tolist()
        keep, start = _envelope(c, g)
        tiles: list[int] = []
        cols: list[int] = []
        squares: list[int] = []
        for n, i in enumerate(keep):
            # Tiles in which this parabola wins, with one pixel to spare on each side.
            end = start[n + 1] if n + 1 < len(keep) else float("inf")
            low = 0 if start[n] == float("-inf") else max(0, int((start[n] - 1) // tile))
            high = blocks - 1 if end == float("inf") else min(blocks - 1, int((end + 1) // tile))
            home = c[i] // tile
            for b in range(low, high + 1):
                if b != home:
                    tiles.append(b)
                    cols.append(c[i])
                    squares.append(g[i])
        n = len(tiles)
        return pa.table(
            [
                pa.array(np.array(tiles, dtype=np.int64) + (row // tile << 32)),
                pa.array(np.full(n, layer, dtype=np.int32)),
                pa.array(np.full(n, row, dtype=np.int32)),
                pa.array(np.array(cols, dtype=np.int32)),
                pa.array(np.array(squares, dtype=np.int64)),
            ],
            schema=schema,
        )

    return run


def _make_combine(layers: int, tile: int, passed: list[str]):
    def run(key, pixels: pa.Table, hints: pa.Table) -> pa.Table:
        top, left = (block * tile for block in unpack(key[0].as_py()))
        row, col = _ints(pixels, "row") - top, _ints(pixels, "col") - left
        out = pixels.select(passed)
        if not pixels.num_rows:
            # A tile without pixels, known only through its carried values.
            for layer in range(layers):
                out = out.append_column(f"_d{layer}", pa.array([], pa.int64()))
            return out
        kind, which = _ints(hints, "kind"), _ints(hints, "layer")
        span = np.arange(left, left + tile, dtype=np.int64)[None, :]
        for layer in range(layers):
            above, below = _carried(hints, layer, left, tile)
            best = _horizontal(_vertical(_flags(pixels, layer, top, left, tile), top, above, below))
            lines = np.nonzero((kind == 1) & (which == layer))[0]
            if len(lines):
                line_row = _filled(hints, "a", 0)[lines] - top
                order = np.argsort(line_row, kind="stable")
                line_row, lines = line_row[order], lines[order]
                c, g = _ints(hints, "x")[lines], _filled(hints, "b", 0)[lines]
                # At most a few rows' worth of parabolas at a time.
                for begin in range(0, len(lines), 4096):
                    part = slice(begin, begin + 4096)
                    height = (span - c[part, None]) ** 2 + g[part, None]
                    rows, first = np.unique(line_row[part], return_index=True)
                    best[rows] = np.minimum(best[rows], np.minimum.reduceat(height, first, axis=0))
            value = best[row, col]
            out = out.append_column(f"_d{layer}", pa.array(value, mask=value >= FAR))
        return out

    return run


def squared_distances(
    pixels: DataFrame, targets: Mapping[str, Column], grid: GridSpec, tile: int = TILE, tiled: bool = False
) -> DataFrame:
    """``pixels`` plus one BIGINT column per target: squared distance in pixels, NULL without targets.

    ``targets`` maps output names to boolean columns; all of them share the
    single shuffle of the pixels.  Every other column of ``pixels`` is kept.  With
    ``tiled``, pixels come with their ``tile`` from a table bucketed by it.
    """
    names = list(targets)
    bands = -(-grid.height // tile)
    blocks = -(-grid.width // tile)
    passed = pixels.columns
    bits = F.lit(0)
    for i, name in enumerate(names):
        bits = bits + F.when(targets[name], 1 << i).otherwise(0)
    flagged = pixels.withColumn("targets", bits)
    if not tiled:
        flagged = clustered(flagged, tile)
    hit = flagged.select("row", "col", "targets", "tile").filter("targets > 0")

    # 1. First and last target per layer, column and tile row, then carried across tile rows.
    layer_of = F.explode(F.array(*[F.when(F.col("targets").bitwiseAND(1 << i) != 0, i) for i in range(len(names))]))
    ends = (
        hit.withColumn("layer", layer_of)
        .filter("layer IS NOT NULL")
        .groupBy("layer", "col", block_of("row", tile).alias("tile_r"))
        .agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"))
    )
    # Each end knows its neighbours in the column and serves its own tile row and the
    # empty tile rows up to the next end, so every (column, tile row) appears once.
    column = Window.partitionBy("layer", "col").orderBy("tile_r")
    linked = ends.select(
        "*",
        F.lag("last_row").over(column).alias("before"),
        F.lead("first_row").over(column).alias("after"),
        F.lead("tile_r").over(column).alias("next_r"),
    )
    served = F.sequence(
        F.when(F.col("before").isNull(), 0).otherwise(F.col("tile_r")),
        F.coalesce(F.col("next_r") - 1, F.greatest(F.lit(bands - 1), F.col("tile_r"))),
    )
    own, at = F.col("tile_r"), F.col("at")
    carry = linked.withColumn("at", F.explode(served)).select(
        tile_key(at, block_of("col", tile)).alias("tile"),
        F.lit(0).alias("kind"),
        "layer",
        F.col("col").alias("x"),
        F.when(at > own, F.col("last_row")).when(at == own, F.col("before")).cast("long").alias("a"),
        F.when(at < own, F.col("first_row")).otherwise(F.col("after")).cast("long").alias("b"),
    )

    # 2. and 3. Parabolas that cross tile borders.  The carried values (one row per
    # tile column and tile row) are read twice from here on, so they are written out.
    hints = carry
    if blocks > 1:
        # With one column of tiles no parabola crosses a border.
        carry = materialise(carry)
        lines = (
            hit.groupBy("tile")
            .cogroup(carry.groupBy("tile"))
            .applyInArrow(_make_outgoing(len(names), tile), "layer int, row int, c int, g long")
        )
        incoming = lines.groupBy("layer", "row").applyInArrow(
            _make_incoming(tile, blocks), "tile long, layer int, row int, c int, g long"
        )
        hints = carry.unionByName(
            incoming.select(
                "tile",
                F.lit(1).alias("kind"),
                "layer",
                F.col("c").alias("x"),
                F.col("row").cast("long").alias("a"),
                F.col("g").alias("b"),
            )
        )

    # 4. One pass over the pixels.
    schema = T.StructType(list(pixels.schema.fields) + [T.StructField(f"_d{i}", T.LongType()) for i in range(len(names))])
    done = (
        flagged.groupBy("tile")
        .cogroup(hints.groupBy("tile"))
        .applyInArrow(_make_combine(len(names), tile, passed), schema)
    )
    return done.select(*passed, *[F.col(f"_d{i}").alias(name) for i, name in enumerate(names)])


def euclidean_distances(
    pixels: DataFrame, targets: Mapping[str, Column], grid: GridSpec, mask: str | None = None, tile: int = TILE, tiled: bool = False
) -> DataFrame:
    """``pixels`` plus one distance column per target in map units, NULL outside ``mask``."""
    side = grid.square()
    out = squared_distances(pixels, targets, grid, tile, tiled)
    for name in targets:
        value = F.sqrt(F.col(name).cast("double")) * side
        out = out.withColumn(name, value if mask is None else F.when(F.col(mask) == 1, value))
    return out


def distance_to(
    pixels: DataFrame, layer: str, value: int, grid: GridSpec, output: str = "distance", mask: str | None = None, tile: int = TILE
) -> DataFrame:
    """Distance to the nearest pixel whose ``layer`` equals ``value``."""
    hit = F.coalesce(F.col(layer) == value, F.lit(False))
    return euclidean_distances(pixels, {output: hit}, grid, mask, tile)
