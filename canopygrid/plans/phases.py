"""Fitting, prediction and evaluation phases of both models.

Phases are DataFrame functions over one wide pixel table (``prepare``).  They
stay lazy except for three small driver values: the risk threshold, the
adjustment ratio of each round and the evaluation sample size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopygrid.grid import GridSpec
from canopygrid.lineage import cut, materialise
from canopygrid.operators import adjust as adj
from canopygrid.operators import cells as cel
from canopygrid.operators import classify as cls
from canopygrid.operators import tabulate as tab
from canopygrid.operators.components import parts_of_cells
from canopygrid.operators.distance import euclidean_distances
from canopygrid.operators.layers import DERIVED_MAPS, area_mask, combined_mask, derived_map
from canopygrid.operators.metrics import evaluation_metrics


@dataclass(frozen=True)
class Params:
    """Parameters of a run with the usual defaults."""

    area_value: int = 1
    n_classes: int = 30
    max_iterations: int = 5
    tolerance: float = 1.00001
    evaluation_grid_area: float = 100000
    expected_deforestation: float | None = None
    vp_years: float | None = None
    # Whole evaluation cells must be covered by one connected part of the area.
    strict_cells: bool = True


@dataclass(frozen=True)
class PhaseLayers:
    """Layers that a phase reads."""

    distance: str
    forest: str
    potential: str
    loss: str | None


# Start-of-period layers and observed loss per phase.
PHASES = {
    "CAL": PhaseLayers("t1_distance", "t1_forest", "etp_cal", "t1t2_deforestation"),
    "CNF": PhaseLayers("t2_distance", "t2_forest", "etp_cnf", "t2t3_deforestation"),
    "HRP": PhaseLayers("t1_distance", "t1_forest", "etp_hrp", "hrp_deforestation"),
    "VP": PhaseLayers("t3_distance", "t3_forest", "etp_vp", None),
}
FITTED_BY = {"CNF": "CAL", "VP": "HRP"}
DISTANCE_SOURCES = {"t1_distance": "t1_non_forest", "t2_distance": "t2_non_forest", "t3_distance": "t3_non_forest"}


def with_masks(layers: DataFrame, area_value: int = 1) -> DataFrame:
    """Add ``mask`` (area without exclusions), ``area`` and the change layer cut to the mask."""
    return (
        layers.withColumn("mask", combined_mask(area_value))
        .withColumn("area", area_mask(area_value))
        .withColumn("fcbm", F.when(F.col("mask") == 1, F.col("fcbm")))
    )


def with_derived_maps(pixels: DataFrame) -> DataFrame:
    """Add the nine 1/0 maps of the change layer."""
    return pixels.withColumns({name: derived_map(name) for name in DERIVED_MAPS})


def prepare(
    layers: DataFrame, grid: GridSpec, area_value: int = 1, distances: tuple[str, ...] = tuple(DISTANCE_SOURCES)
) -> DataFrame:
    """Wide pixel table of a run, written once and scanned by every phase.

    Distances start from non-forest inside the mask only.  All periods share
    one pass of the distance operator.
    """
    # The masks replace the layers they come from; fewer columns go through the shuffle.
    masked = with_masks(layers, area_value).drop("aoi", "excl")
    if distances:
        targets = {d: F.coalesce(derived_map(DISTANCE_SOURCES[d]) == 1, F.lit(False)) for d in distances}
        masked = euclidean_distances(masked, targets, grid, mask="mask")
    return with_derived_maps(materialise(masked))


def loss_distances(pixels: DataFrame) -> DataFrame:
    """Distances at which loss was observed over the historical period."""
    return cls.observed_loss(pixels, "t1_distance", "mask", "hrp_deforestation")


def distance_histogram(pixels: DataFrame, grid: GridSpec) -> DataFrame:
    """Histogram of these distances from one scan of the pixels.

    Distances are roots of whole numbers, so few of them differ: pixels are
    counted by distance, and bins come from the stored counts.
    """
    counts = materialise(loss_distances(pixels).groupBy("t1_distance").agg(F.count("*").alias("n")))
    return cls.histogram(counts, "t1_distance", grid.step, "n")


def threshold(pixels: DataFrame, grid: GridSpec) -> DataFrame:
    """One-row risk threshold from first-period distances and historical loss."""
    return cls.risk_threshold(distance_histogram(pixels, grid))


def risk_class(pixels: DataFrame, model: str, phase: str, grid: GridSpec, n_classes: int, nrt: int | None) -> DataFrame:
    """Add ``risk_class`` and ``region_id`` for a model and phase."""
    names = PHASES[phase]
    if model == "benchmark":
        if nrt is None:
            raise ValueError("the benchmark model needs the risk threshold")
        value: Column = cls.benchmark_class(names.distance, nrt, n_classes, grid.step)
    elif model == "alternative":
        if names.potential not in pixels.columns:
            raise ValueError(f"the alternative model needs the layer {names.potential}")
        # A column of its own, so that the class expression reads it instead of repeating it.
        pixels = pixels.withColumn("_rescaled", cls.rescale(pixels, names.potential))
        value = cls.alternative_class("_rescaled", n_classes, "mask", names.forest)
    else:
        raise ValueError(f"unknown model: {model}")
    return pixels.withColumn("risk_class", value).withColumn("region_id", cls.region_id()).drop("_rescaled")


@dataclass
class Fit:
    """Fitted phase: pixels with class, region and density; the frequency table."""

    pixels: DataFrame
    frequency: DataFrame


def fit(
    pixels: DataFrame, model: str, phase: str, grid: GridSpec, n_classes: int = 30, nrt: int | None = None
) -> Fit:
    """Frequency table by region and fitted density of a phase (CAL or HRP)."""
    loss = PHASES[phase].loss
    classed = risk_class(pixels, model, phase, grid, n_classes, nrt)
    frequency = cut(tab.frequency_table(classed, loss=loss))
    dense = adj.density_map(classed, frequency, grid.pixel_ha)
    return Fit(dense, frequency)


@dataclass
class Prediction:
    """Predicted phase: pixels with density and adjusted density, tables and log."""

    pixels: DataFrame
    frequency: DataFrame
    unseen: DataFrame
    adjustment: adj.Adjustment


def predict(
    pixels: DataFrame,
    frequency: DataFrame,
    model: str,
    phase: str,
    grid: GridSpec,
    n_classes: int = 30,
    nrt: int | None = None,
    expected_ha: float | None = None,
    years: float | None = None,
    max_iterations: int = adj.MAX_ITERATIONS,
    tolerance: float = adj.TOLERANCE,
) -> Prediction:
    """Density of a prediction phase (CNF or VP), imputed and rescaled to a known total."""
    classed = risk_class(pixels, model, phase, grid, n_classes, nrt)
    loss = PHASES[phase].loss
    # One scan gives pixels per region and, over all regions and none, the observed loss.
    lost = F.count(F.when(F.col(loss) == 1, 1)) if loss is not None else F.lit(0).cast("long")
    tallies = cut(classed.groupBy("region_id").agg(F.count("*").alias("area_px"), lost.alias("lost_px")))
    counts = tallies.filter("region_id IS NOT NULL").select("region_id", "area_px")
    complete = cut(tab.impute_regions(frequency, counts))
    total = expected_ha
    if total is None and loss is not None:
        total = (tallies.agg(F.sum("lost_px")).first()[0] or 0) * grid.pixel_ha
    outcome = adj.adjust(
        adj.region_densities(counts, complete, grid.pixel_ha), total, grid.pixel_ha, max_iterations, tolerance, years
    )
    unseen = tab.unseen_zones(counts, frequency)
    return Prediction(adj.predicted_maps(classed, complete, outcome, grid.pixel_ha), complete, unseen, outcome)


@dataclass
class Evaluation:
    """Evaluation cells and one row of metrics."""

    cells: DataFrame
    metrics: DataFrame


def strict_coverage(pixels: DataFrame, grid: GridSpec, grid_area_ha: float) -> DataFrame:
    """Cell coverage per connected part of the area mask, shared by all evaluations of a run."""
    return cut(parts_of_cells(pixels, grid, cel.spacing(grid_area_ha, grid), "area"))


def evaluate(
    pixels: DataFrame, phase: str, grid: GridSpec, grid_area_ha: float, density: str, coverage: DataFrame | None = None
) -> Evaluation:
    """Cells and metrics of a phase: fitted density for CAL, adjusted density for CNF."""
    cells = cut(
        cel.evaluation_grid(pixels, grid, grid_area_ha, "area", "mask", PHASES[phase].loss, density, coverage)
    )
    return Evaluation(cells, evaluation_metrics(cells, grid_area_ha))
