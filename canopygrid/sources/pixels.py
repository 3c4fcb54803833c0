"""Pixel tables and tile tables: reading, writing and layer co-registration."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopygrid.functions.algebra import OUTPUT_TYPES, to_storage
from canopygrid.grid import TILE
from canopygrid.operators.tiles import block_of

FILE_COLUMNS = 1024 * TILE


def sentinel(dtype: str) -> float:
    """NoData value stored for an output type."""
    return OUTPUT_TYPES[dtype][3]


def drop_sentinel(value: str, nodata: float | None) -> Column:
    """NULL in place of the NoData sentinel and of NaN."""
    column = F.col(value)
    number = ~F.isnan(column.cast("double"))
    return F.when(number if nodata is None else (column != nodata) & number, column)


def read_layer(spark: SparkSession, path: str, value: str = "value", nodata: float | None = None) -> DataFrame:
    """A layer stored as a pixel table: ``row, col, value``."""
    df = spark.read.parquet(path)
    return df.select(F.col("row").cast("int"), F.col("col").cast("int"), drop_sentinel(value, nodata).alias(value))


def tiles_to_pixels(
    tiles: DataFrame, tile_height: int, tile_width: int, value: str = "value", nodata: float | None = None
) -> DataFrame:
    """Tile rows (``tile_r, tile_c, data`` row-major) to one row per pixel."""
    flat = tiles.select("tile_r", "tile_c", F.posexplode("data").alias("pos", value))
    return flat.select(
        (F.col("tile_r") * tile_height + F.floor(F.col("pos") / tile_width)).cast("int").alias("row"),
        (F.col("tile_c") * tile_width + F.col("pos") % tile_width).cast("int").alias("col"),
        drop_sentinel(value, nodata).alias(value),
    ).filter(F.col(value).isNotNull())


def pixels_to_tiles(
    pixels: DataFrame, tile_height: int, tile_width: int, value: str = "value", nodata: float = -9999.0
) -> DataFrame:
    """Dense row-major tiles; missing and NULL pixels take the sentinel.

    A tile gathers at most ``tile_height * tile_width`` pixels.
    """
    size = tile_height * tile_width

    def fill(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        dense = np.full(size, float(nodata))
        dense[part.column("pos").to_numpy()] = part.column("v").to_numpy()
        data = pa.array([dense], type=pa.list_(pa.float64()))
        return pa.table({"tile_r": [key[0].as_py()], "tile_c": [key[1].as_py()], "data": data}).cast(
            pa.schema([("tile_r", pa.int32()), ("tile_c", pa.int32()), ("data", pa.list_(pa.float64()))])
        )

    placed = pixels.select(
        block_of("row", tile_height).alias("tile_r"),
        block_of("col", tile_width).alias("tile_c"),
        ((F.col("row") % tile_height) * tile_width + F.col("col") % tile_width).cast("int").alias("pos"),
        F.coalesce(F.col(value).cast("double"), F.lit(float(nodata))).alias("v"),
    )
    return placed.groupBy("tile_r", "tile_c").applyInArrow(fill, "tile_r int, tile_c int, data array<double>")


def encode_layer(pixels: DataFrame, value: str, dtype: str) -> DataFrame:
    """``row, col, value`` in storage type, NoData as the type's sentinel."""
    stored = to_storage(F.col(value), dtype)
    fill = F.lit(sentinel(dtype)).cast(OUTPUT_TYPES[dtype][0])
    return pixels.select("row", "col", F.coalesce(stored, fill).alias(value))


def write_layer(pixels: DataFrame, path: str, value: str, dtype: str = "uint8", mode: str = "errorifexists") -> None:
    """Write a layer partitioned by bands of ``TILE`` rows, sorted for min/max pruning.

    A band is cut into files of at most ``FILE_COLUMNS`` columns (67 million pixels).
    """
    out = encode_layer(pixels, value, dtype).withColumn("block_r", block_of("row", TILE))
    (
        out.repartition("block_r", block_of("col", FILE_COLUMNS))
        .sortWithinPartitions("block_r", "row", "col")
        .write.mode(mode)
        .partitionBy("block_r")
        .parquet(path)
    )


def coregister(template: DataFrame, layers: Mapping[str, DataFrame]) -> DataFrame:
    """Wide pixel table: the template's pixels with one column per layer.

    ``layers`` maps output names to ``row, col, <value>`` tables.  All joins
    share the key, so the template's partitioning is reused by each of them.
    """
    wide = template
    for name, layer in layers.items():
        value = next(c for c in layer.columns if c not in ("row", "col"))
        wide = wide.join(layer.select("row", "col", F.col(value).alias(name)), ["row", "col"], "left")
    return wide
