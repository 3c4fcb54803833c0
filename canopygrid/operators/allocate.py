"""Allocation of expected loss to pixels, with deficits moved inside an area."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopygrid.lineage import cut, materialise
from canopygrid.operators.opening import opened_pixels, stratum_key
from canopygrid.operators.ranking import at_or_before, cut_keys

# Guard against float noise just above a whole number of pixels.
EPSILON_PX = 1e-9


def pixels_for(hectares: Column, pixel_ha: float) -> Column:
    """Whole pixels that cover ``hectares``."""
    return F.greatest(F.ceil(hectares / pixel_ha - EPSILON_PX), F.lit(0)).cast("long")


def stratum_targets(
    pixels: DataFrame, years: float, pixel_ha: float, area: str = "area", region: str = "region", density: str = "density"
) -> DataFrame:
    """``area, region, target_ha, target_px`` over all pixels, before any filtering."""
    return (
        pixels.filter(F.col(density).isNotNull() & F.col(region).isNotNull() & F.col(area).isNotNull())
        .groupBy(F.col(area).alias("area"), F.col(region).alias("region"))
        .agg((F.sum(density) * years).alias("target_ha"))
        .withColumn("target_px", pixels_for(F.col("target_ha"), pixel_ha))
    )


def score_column(pixels: DataFrame, etp: str | None, density: str = "density") -> str:
    """Ranking layer: the potential when there is one, else the density."""
    return etp if etp is not None and etp in pixels.columns else density


def eligible(pixels: DataFrame, forest_classes: Sequence[int], score: str, cover: str = "lulc") -> DataFrame:
    """Forest pixels with a positive score."""
    return pixels.filter(F.col(cover).isin(*forest_classes) & (F.col(score) > 0) & ~F.isnan(F.col(score).cast("double")))


def first_pass_report(targets: DataFrame, available: DataFrame, pixel_ha: float) -> DataFrame:
    """Per stratum: allocated pixels and hectares, and the deficit left over."""
    joined = targets.join(available.select("area", "region", "available"), ["area", "region"], "left")
    allocated = F.least("target_px", F.coalesce("available", F.lit(0).cast("long")))
    return joined.select(
        "area",
        "region",
        "target_ha",
        "target_px",
        F.coalesce("available", F.lit(0).cast("long")).alias("available_px"),
        allocated.alias("allocated_px"),
        (allocated * pixel_ha).alias("allocated_ha"),
        F.greatest(F.lit(0.0), F.col("target_ha") - allocated * pixel_ha).alias("deficit_ha"),
    )


def area_deficits(report: DataFrame, pixel_ha: float) -> DataFrame:
    """``area, deficit_ha, deficit_px`` summed over an area's strata."""
    return (
        report.groupBy("area")
        .agg(F.sum("deficit_ha").alias("deficit_ha"))
        .withColumn("deficit_px", pixels_for(F.col("deficit_ha"), pixel_ha))
    )


@dataclass
class Allocation:
    """``pixels`` carries ``first_pass``, ``allocated`` (1/0) and ``modified_lulc``."""

    pixels: DataFrame
    report: DataFrame
    deficits: DataFrame


def allocate(
    pixels: DataFrame,
    pixel_ha: float,
    years: float,
    forest_classes: Sequence[int],
    non_forest_class: int = 0,
    etp: str | None = None,
    kernel: int | None = None,
    cover: str = "lulc",
) -> Allocation:
    """Two passes: top pixels per (area, region), then the area's deficit from its leftovers.

    ``pixels`` needs ``row, col, area, region, density`` and the cover layer.
    Give it materialised: it is scanned once per counting round.
    """
    score = score_column(pixels, etp)
    targets = cut(stratum_targets(pixels, years, pixel_ha))
    candidates = eligible(pixels, forest_classes, score, cover).filter("area IS NOT NULL")
    flagged = pixels
    if kernel is not None and kernel // 2 > 0:
        keyed = candidates.filter("region IS NOT NULL").select("row", "col", stratum_key())
        alive = materialise(opened_pixels(keyed, kernel).select("row", "col")).withColumn("_alive", F.lit(True))
        flagged = pixels.join(alive, ["row", "col"], "left")
        candidates = candidates.join(alive, ["row", "col"], "left_semi")
    narrow = candidates.select("row", "col", "area", "region", score)
    if "_alive" in flagged.columns:
        narrow = materialise(narrow)

    first = cut_keys(narrow, ["area", "region"], score, targets, "target_px")
    report = cut(first_pass_report(targets, first, pixel_ha))
    cuts = first.select("area", "region", *[F.col(f"cut{i}").alias(f"first{i}") for i in range(3)])
    leftover = (
        narrow.join(cuts, ["area", "region"], "left")
        .filter(~at_or_before(score, "first"))
        .select(narrow.columns)
    )
    deficits = cut(area_deficits(report, pixel_ha))
    second = cut_keys(leftover, ["area"], score, deficits, "deficit_px")
    again = second.select("area", *[F.col(f"cut{i}").alias(f"second{i}") for i in range(3)])

    usable = F.col(cover).isin(*forest_classes) & (F.col(score) > 0) & ~F.isnan(F.col(score).cast("double"))
    if "_alive" in flagged.columns:
        usable = usable & F.col("_alive").isNotNull()
    taken_first = F.coalesce(usable, F.lit(False)) & at_or_before(score, "first")
    taken_second = F.coalesce(usable, F.lit(False)) & ~taken_first & at_or_before(score, "second")
    out = (
        flagged.join(cuts, ["area", "region"], "left")
        .join(again, ["area"], "left")
        .withColumn("first_pass", taken_first.cast("int"))
        .withColumn("allocated", (taken_first | taken_second).cast("int"))
        .withColumn("modified_lulc", F.when(F.col("allocated") == 1, F.lit(non_forest_class)).otherwise(F.col(cover)))
    )
    return Allocation(out.select(*pixels.columns, "first_pass", "allocated", "modified_lulc"), report, deficits)
