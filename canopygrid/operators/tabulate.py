"""Relative-frequency tables by region, lookups and imputation.

Region tables hold at most classes x divisions rows (254 x 1000), whatever the
size of the layers, which is the bound that makes them safe to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopygrid.operators.classify import DIVISION_BASE, MAX_CLASSES, zone_of

# Proven ceiling of a region table; far below any executor's memory.
MAX_REGIONS = MAX_CLASSES * DIVISION_BASE


def is_loss(loss: str) -> Column:
    """Pixels counted as lost: valid and not zero."""
    return F.coalesce(F.col(loss) != 0, F.lit(False))


def region_counts(pixels: DataFrame, region: str = "region_id") -> DataFrame:
    """Pixels per region; pixels without a region are left out."""
    return pixels.filter(F.col(region).isNotNull()).groupBy(region).agg(F.count("*").alias("area_px"))


def loss_counts(pixels: DataFrame, region: str = "region_id", loss: str = "loss") -> DataFrame:
    """Lost pixels per region."""
    return (
        pixels.filter(F.col(region).isNotNull() & is_loss(loss))
        .groupBy(region)
        .agg(F.count("*").alias("defor_px"))
    )


def merge_counts(losses: DataFrame, areas: DataFrame, region: str = "region_id") -> DataFrame:
    """Full outer merge of two region tables, missing counts as 0."""
    return losses.join(areas, region, "full_outer").fillna(0, ["defor_px", "area_px"])


def frequency_table(pixels: DataFrame, region: str = "region_id", loss: str = "loss") -> DataFrame:
    """``region_id, defor_px, area_px, rel_freq, imputed`` from one aggregation pass.

    Counts are combined inside each input partition first, so a region holding
    a third of all pixels still reaches the shuffle as one row per task.
    """
    return (
        pixels.filter(F.col(region).isNotNull())
        .groupBy(F.col(region).alias("region_id"))
        .agg(F.count(F.when(is_loss(loss), 1)).alias("defor_px"), F.count("*").alias("area_px"))
        .select(
            "region_id",
            "defor_px",
            "area_px",
            (F.col("defor_px") / F.col("area_px")).alias("rel_freq"),
            F.lit(False).alias("imputed"),
        )
    )


def distinct_regions(pixels: DataFrame, region: str = "region_id") -> DataFrame:
    """Ids of the regions that occur."""
    return pixels.filter(F.col(region).isNotNull()).select(F.col(region).alias("region_id")).distinct()


def region_total(pixels: DataFrame, region: str = "region_id") -> DataFrame:
    """One row: number of distinct regions."""
    return distinct_regions(pixels, region).agg(F.count("*").alias("n_regions"))


def missing_regions(predicted: DataFrame, fitted: DataFrame) -> DataFrame:
    """Region ids that occur in prediction but not in fitting."""
    return predicted.select("region_id").distinct().join(fitted.select("region_id"), "region_id", "left_anti")


def unseen_zones(predicted: DataFrame, fitted: DataFrame) -> DataFrame:
    """Zones of missing regions that fitting never saw."""
    missing = missing_regions(predicted, fitted).select(zone_of().alias("zone")).distinct()
    return missing.join(fitted.select(zone_of().alias("zone")).distinct(), "zone", "left_anti")


def zone_rows(fitted: DataFrame, missing: DataFrame) -> DataFrame:
    """Fitted rows in the zones of missing regions."""
    zones = missing.select(zone_of().alias("zone")).distinct()
    return fitted.withColumn("zone", zone_of()).join(zones, "zone", "left_semi")


def zone_averages(rows: DataFrame) -> DataFrame:
    """Area-weighted frequency per zone, from observed rows only."""
    return (
        rows.filter(~F.col("imputed"))
        .groupBy("zone")
        .agg(
            F.sum(F.col("area_px") * F.col("rel_freq")).alias("zone_defor"),
            F.sum("area_px").alias("zone_area"),
        )
        .withColumn("zone_freq", F.col("zone_defor") / F.col("zone_area"))
    )


def impute_regions(fitted: DataFrame, predicted: DataFrame) -> DataFrame:
    """Fitted table plus one row per missing region.

    A missing region takes its zone's area-weighted frequency and carries the
    zone's totals; a zone never seen in fitting gives 0.  Added rows are
    flagged ``imputed`` so that later sums can leave them out.
    """
    missing = missing_regions(predicted, fitted)
    # Averages of every zone (at most MAX_CLASSES rows): cheaper than reading the
    # missing regions twice to keep only their zones.
    averages = zone_averages(fitted.withColumn("zone", zone_of()))
    added = (
        missing.withColumn("zone", zone_of())
        .join(averages, "zone", "left")
        .select(
            "region_id",
            F.coalesce(F.round("zone_defor").cast("long"), F.lit(0).cast("long")).alias("defor_px"),
            F.coalesce("zone_area", F.lit(0)).cast("long").alias("area_px"),
            F.coalesce("zone_freq", F.lit(0.0)).alias("rel_freq"),
            F.lit(True).alias("imputed"),
        )
    )
    return fitted.select("region_id", "defor_px", "area_px", "rel_freq", "imputed").unionByName(added)


def with_background(table: DataFrame) -> DataFrame:
    """The table plus a zero row for the background id 0."""
    zero = table.sparkSession.range(1).select(
        F.lit(0).cast("int").alias("region_id"),
        F.lit(0).cast("long").alias("defor_px"),
        F.lit(0).cast("long").alias("area_px"),
        F.lit(0.0).alias("rel_freq"),
        F.lit(False).alias("imputed"),
    )
    return table.unionByName(zero)


def lookup(pixels: DataFrame, table: DataFrame, value: str, output: str, region: str = "region_id") -> DataFrame:
    """Exact-match lookup of a region value per pixel; background and absent regions give 0."""
    return lookups(pixels, table, {output: value}, region)


def lookups(pixels: DataFrame, table: DataFrame, values: dict[str, str], region: str = "region_id") -> DataFrame:
    """Several region values per pixel (output name to table column) by one join.

    The table has at most ``MAX_REGIONS`` rows by construction, so it is broadcast
    and the pixels stay where they are.
    """
    small = table.select(F.col("region_id").alias("_region"), *[F.col(v).alias(f"_{name}") for name, v in values.items()])
    return (
        pixels.join(F.broadcast(small), F.col(region) == F.col("_region"), "left")
        .withColumns({name: F.coalesce(f"_{name}", F.lit(0.0)) for name in values})
        .drop("_region", *[f"_{name}" for name in values])
    )
