"""Raster layers derived from the relational test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopygrid.grid import GridSpec

WIDTH = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid_of(spark: SparkSession, sf_dir: str) -> GridSpec:
    """Grid that holds one pixel per order: 128 columns of 30 m."""
    last = table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    return GridSpec(height=int(last) // WIDTH + 1, width=WIDTH, origin_y=0.0)


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide pixel table: change class, area, exclusions, division and two potentials."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    key = F.col("o_orderkey")
    change = 1 + (F.floor(key / 1024) * 7 + F.floor((key % WIDTH) / 8) * 13 + key % 3) % 8
    price, balance = F.col("o_totalprice") / 500000.0, (F.col("c_acctbal") + 1000.0) / 11000.0
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.floor(key / WIDTH).cast("int").alias("row"),
        (key % WIDTH).cast("int").alias("col"),
        change.cast("int").alias("fcbm"),
        F.when(key % WIDTH < 112, 1).otherwise(2).alias("aoi"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("excl"),
        (F.col("c_nationkey") + 2).alias("division"),
        price.alias("etp_cal"),
        balance.alias("etp_cnf"),
        price.alias("etp_hrp"),
        balance.alias("etp_vp"),
    )


def allocation_layers(spark: SparkSession, sf_dir: str, pixel_ha: float) -> DataFrame:
    """Cover, density, potential, region and area of every pixel.

    The potential is a customer's balance: it ties for all orders of a customer
    and is not positive for some.
    """
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    base = layers(spark, sf_dir).join(nation, F.col("division") - 2 == F.col("n_nationkey"))
    return base.select(
        "row",
        "col",
        F.col("fcbm").alias("lulc"),
        F.col("division").alias("region"),
        F.col("n_regionkey").alias("area"),
        (F.col("etp_cal") * (pixel_ha / 5)).alias("density"),
        (F.col("etp_cnf") * 11000.0 - 1000.0).alias("etp"),
    )


def class_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class-definition table with the usual faults, from ``part``."""
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part"),
        F.when(size == 1, F.lit("n/a"))
        .when(size == 2, F.concat(F.lit("-"), key.cast("string")))
        .when(size == 3, F.concat(key.cast("string"), F.lit(".5")))
        .otherwise(F.concat(F.lit(" "), (key % 997).cast("string")))
        .alias("id"),
        F.col("p_brand").alias("label"),
        F.when(size == 50, F.concat(F.col("p_brand"), F.lit("-x"))).otherwise(F.col("p_brand")).alias("label_reclass"),
        F.when(size == 7, "").otherwise(F.col("p_type")).alias("category"),
        (size * 6).cast("string").alias("r"),
        F.when(size == 9, "red").otherwise(size.cast("string")).alias("g"),
        (size - 3).cast("string").alias("b"),
        F.when(size < 10, "YES").when(size < 40, "no").otherwise("maybe").alias("confusion"),
    )


def transition_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions between labels; some ends are no label."""
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.when(size == 11, F.concat(F.col("p_type"), F.lit("?"))).otherwise(F.col("p_brand")).alias("from_class"),
        F.when(size == 12, F.col("p_name")).otherwise(F.col("p_brand")).alias("to_class"),
    )


def division_polygons(spark: SparkSession, sf_dir: str, grid: GridSpec) -> DataFrame:
    """One diamond per supplier, larger with the account balance; neighbours overlap.

    ``seq`` follows the supplier key, so later suppliers lie on top.
    """
    supplier = table(spark, sf_dir, "supplier")
    side = grid.pixel_x
    rows = F.lit(grid.height)
    cx = (F.col("s_suppkey") * 37 % WIDTH + 0.2) * side
    cy = -(F.col("s_suppkey") * 53 % rows + 0.25) * side
    half = (3.0 + F.floor((F.col("s_acctbal") + 1000.0) / 1000.0)) * side

    def point(dx, dy):
        return F.struct((cx + dx).alias("x"), (cy + dy).alias("y"))

    ring = F.array(
        point(half, F.lit(0.0)), point(F.lit(0.0), half), point(-half, F.lit(0.0)), point(F.lit(0.0), -half)
    )
    return supplier.select(F.col("s_suppkey").cast("int").alias("seq"), ring.alias("ring"))


def grid_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid metadata of layers laid out from four tables with different extents."""
    keys = {
        "orders": ("o_orderkey", 30.0, "EPSG:32618", True),
        "lineitem": ("l_orderkey", 30.0, "EPSG:32618", True),
        "customer": ("c_custkey", 30.0, "EPSG:32619", True),
        "part": ("p_partkey", 10.0, "EPSG:4326", False),
    }
    parts = []
    for name, (key, size, crs, projected) in keys.items():
        last = table(spark, sf_dir, name).agg(F.max(key).alias("k"))
        parts.append(
            last.select(
                F.lit(name).alias("layer"),
                (F.floor(F.col("k") / WIDTH) + 1).cast("int").alias("height"),
                F.lit(WIDTH).alias("width"),
                F.lit(size).alias("pixel_x"),
                F.lit(size).alias("pixel_y"),
                F.lit(0.0).alias("origin_x"),
                F.lit(0.0).alias("origin_y"),
                F.lit(crs).alias("crs"),
                F.lit(projected).alias("projected"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def extent_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extent per event type (user id by value) in one CRS, ``layer`` = event type."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.concat_ws("-", "event_type", F.floor(F.col("value") / 100).cast("string")).alias("layer"))
        .agg(
            F.min(F.lit("EPSG:32618")).alias("crs"),
            F.min("user_id").cast("double").alias("min_x"),
            F.min("value").alias("min_y"),
            F.max("user_id").cast("double").alias("max_x"),
            F.max("value").alias("max_y"),
        )
    )
