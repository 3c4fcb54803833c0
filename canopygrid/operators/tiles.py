"""Square tiles: the unit of grouped work for neighbourhood operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopygrid.grid import TILE
from canopygrid.lineage import scratch_path


def block_of(column: str, tile: int = TILE) -> Column:
    """Index of the tile row or tile column that holds a pixel row or column."""
    return F.floor(F.col(column) / tile).cast("int")


def tile_key(tile_r: Column, tile_c: Column) -> Column:
    """Tile row and column packed into one BIGINT.

    Grouping sorts rows by the key; a single number lets Spark use its radix sort.
    """
    return F.shiftleft(tile_r.cast("long"), 32) + tile_c


def unpack(key: int) -> tuple[int, int]:
    """Tile row and column of a key."""
    tile_c = (key + 2**31) % 2**32 - 2**31
    return (key - tile_c) >> 32, tile_c


def with_tile(df: DataFrame, tile: int = TILE) -> DataFrame:
    """Add ``tile``, the key of the tile that holds a pixel."""
    return df.withColumn("tile", tile_key(block_of("row", tile), block_of("col", tile)))


def write_tiled(pixels: DataFrame, path: str, buckets: int, tile: int = TILE) -> None:
    """Write ``pixels`` with their ``tile``, bucketed and sorted by it: every tile lies whole in one file."""
    placed = with_tile(pixels, tile).repartition(buckets, "tile")
    placed.write.bucketBy(buckets, "tile").sortBy("tile").option("path", path).saveAsTable(f"tiled_{uuid.uuid4().hex}")


def read_tiled(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """What :func:`write_tiled` wrote, also by another session; grouping it by ``tile`` needs no shuffle."""
    name = f"tiled_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    place = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (tile) SORTED BY (tile) INTO {buckets} BUCKETS LOCATION '{place}'")
    return spark.table(name)


def clustered(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """``pixels`` with their ``tile``, stored below the checkpoint folder and read where the tiles lie."""
    spark = pixels.sparkSession
    path, buckets = scratch_path(spark, "tiled"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    write_tiled(pixels, path, buckets, tile)
    return read_tiled(spark, path, buckets)


def with_halo(df: DataFrame, halo: int, tile: int = TILE) -> DataFrame:
    """Like ``with_tile``, with pixels near a border repeated in the tiles they border.

    A tile receives at most ``(tile + 2 * halo) ** 2`` rows.
    """
    if halo >= tile:
        raise ValueError("the halo must be narrower than a tile")

    def reach(column: str) -> Column:
        first = F.floor((F.col(column) - halo) / tile).cast("int")
        last = F.floor((F.col(column) + halo) / tile).cast("int")
        return F.explode(F.sequence(first, last))

    spread = df.withColumn("_tile_r", reach("row")).withColumn("_tile_c", reach("col"))
    return spread.withColumn("tile", tile_key(F.col("_tile_r"), F.col("_tile_c"))).drop("_tile_r", "_tile_c")
