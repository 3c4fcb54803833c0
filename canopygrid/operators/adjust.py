"""Density maps and their iterative, capped rescaling to a known total.

Density is constant within a region, so the loop runs on the region table
(``region_id, n_px, density``) and touches the pixels once, at the end.  After any
number of rounds a density is ``min(factor * density, ceiling)``: a round multiplies both
numbers by the ratio and lowers the ceiling to the cap.  With regions in the order of
their densities, the total of a round follows from two running sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopygrid.lineage import cut
from canopygrid.operators.tabulate import lookup, lookups

# Default loop limits.
MAX_ITERATIONS = 5
TOLERANCE = 1.00001


def frequency_map(pixels: DataFrame, table: DataFrame, loss: str = "loss", output: str = "rel_freq") -> DataFrame:
    """Per-pixel frequency of its region, NULL where the loss layer has no data."""
    found = lookup(pixels, table, "rel_freq", output)
    return found.withColumn(output, F.when(F.col(loss).isNotNull(), F.col(output)))


def density_map(
    pixels: DataFrame, table: DataFrame, pixel_ha: float, risk_class: str = "risk_class", output: str = "density"
) -> DataFrame:
    """Hectares of expected loss per pixel, NULL where the class layer has no data."""
    found = lookup(pixels, table, "rel_freq", output)
    return found.withColumn(output, F.when(F.col(risk_class).isNotNull(), F.col(output) * pixel_ha))


def region_densities(counts: DataFrame, table: DataFrame, pixel_ha: float) -> DataFrame:
    """``region_id, n_px, density`` for the predicted regions (at most classes x divisions rows)."""
    return counts.join(table.select("region_id", "rel_freq"), "region_id", "left").select(
        "region_id",
        F.col("area_px").alias("n_px"),
        (F.coalesce("rel_freq", F.lit(0.0)) * pixel_ha).alias("density"),
    )


def modelled_total(regions: DataFrame, density: Column | str = "density") -> float:
    """Sum of density over all pixels, from the region table."""
    d = F.col(density) if isinstance(density, str) else density
    return float(regions.agg(F.sum(F.col("n_px") * d)).first()[0] or 0.0)


def actual_total(pixels: DataFrame, loss: str, pixel_ha: float) -> float:
    """Hectares of observed loss (value 1)."""
    return pixels.agg(F.count(F.when(F.col(loss) == 1, 1))).first()[0] * pixel_ha


def adjustment_ratio(md: float, ad: float | None) -> float:
    """Actual over modelled total; both must be known and the model not empty."""
    if ad is None:
        raise ValueError("give an observed-loss layer or the expected hectares")
    if not md:
        raise ValueError("modelled total is 0: the adjustment ratio is undefined")
    return ad / md


def capped(density: Column | str, ratio: float, cap: float) -> Column:
    """``density * ratio``, at most ``cap``."""
    d = F.col(density) if isinstance(density, str) else density
    return F.least(d * ratio, F.lit(cap))


class _Modelled:
    """Totals of rescaled densities, from the pixels of each density.

    Regions number at most ``MAX_CLASSES * DIVISION_BASE``, which bounds what comes to the driver.
    """

    def __init__(self, regions: DataFrame) -> None:
        profile = regions.groupBy(F.col("density").cast("double").alias("density")).agg(F.sum("n_px").cast("double").alias("n_px")).orderBy("density").toArrow()
        self.density, n = (profile.column(c).to_numpy() for c in ("density", "n_px"))
        self.n, self.ha = np.r_[0.0, np.cumsum(n)], np.r_[0.0, np.cumsum(n * self.density)]

    def total(self, factor: float, ceiling: float) -> float:
        """Sum of ``min(factor * density, ceiling)`` over all pixels."""
        below = int(np.searchsorted(self.density * factor, ceiling, side="right"))
        above = self.n[-1] - self.n[below]
        return float(factor * self.ha[below] + (ceiling * above if above else 0.0))


@dataclass
class Adjustment:
    """Outcome of the loop: region table with ``adjusted``, and one log row per step."""

    regions: DataFrame
    log: list[tuple[int, float, float, float]]
    converged: bool

    def log_table(self) -> DataFrame:
        """``iter, md, ad, ar, converged`` (at most ``max_iterations + 1`` rows)."""
        rows = [entry + (self.converged,) for entry in self.log]
        return self.regions.sparkSession.createDataFrame(
            rows, "iter int, md double, ad double, ar double, converged boolean"
        )


def adjust(
    regions: DataFrame,
    ad: float | None,
    cap: float,
    max_iterations: int = MAX_ITERATIONS,
    tolerance: float = TOLERANCE,
    years: float | None = None,
) -> Adjustment:
    """Rescale densities until the modelled total meets ``ad`` or the rounds run out.

    Each round multiplies the current densities by the current ratio and caps
    them.  All rounds together cost one aggregation over the region table, which
    is written to the checkpoint folder so that pixels are never re-read.
    """
    table = cut(regions)
    modelled = _Modelled(table)
    factor, ceiling = 1.0, float("inf")
    md = modelled.total(factor, ceiling)
    ratio = adjustment_ratio(md, ad)
    log = [(0, md, float(ad), ratio)]
    step = 0
    while (ratio > tolerance or ratio < 1 / tolerance) and step < max_iterations:
        step += 1
        factor, ceiling = factor * ratio, min(ceiling * ratio, cap)
        md = modelled.total(factor, ceiling)
        ratio = adjustment_ratio(md, ad)
        log.append((step, md, float(ad), ratio))
    density = capped("density", factor, ceiling) if step else F.col("density")
    final = density / years if years is not None and years > 0 else density
    return Adjustment(
        regions=table.withColumn("adjusted", final),
        log=log,
        converged=1 / tolerance <= ratio <= tolerance,
    )


def adjusted_map(
    pixels: DataFrame, adjustment: Adjustment, risk_class: str = "risk_class", output: str = "adjusted"
) -> DataFrame:
    """Adjusted density per pixel, NULL where the class layer has no data."""
    found = lookup(pixels, adjustment.regions, "adjusted", output)
    return found.withColumn(output, F.when(F.col(risk_class).isNotNull(), F.col(output)))


def predicted_maps(pixels: DataFrame, frequency: DataFrame, adjustment: Adjustment, pixel_ha: float, risk_class: str = "risk_class") -> DataFrame:
    """``density`` and ``adjusted`` per pixel by one lookup, NULL where the class layer has no data."""
    table = frequency.select("region_id", (F.col("rel_freq") * pixel_ha).alias("density"))
    table = table.join(adjustment.regions.select("region_id", "adjusted"), "region_id", "full")
    names = ("density", "adjusted")
    found = lookups(pixels, table, {name: name for name in names})
    return found.withColumns({name: F.when(F.col(risk_class).isNotNull(), F.col(name)) for name in names})


__all__ = [
    "Adjustment",
    "actual_total",
    "adjust",
    "adjusted_map",
    "adjustment_ratio",
    "capped",
    "density_map",
    "frequency_map",
    "modelled_total",
    "predicted_maps",
    "region_densities",
]
