"""One named query per operator, over the whole test tables.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame; floating-point
results are rounded so that engines agree on the last digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopygrid.catalog import bindings as data
from canopygrid.functions import algebra, scalars
from canopygrid.lineage import cut, materialise, scratch_path
from canopygrid.operators import adjust as adj
from canopygrid.operators import allocate as alloc
from canopygrid.operators import cells as cel
from canopygrid.operators import classify as cls
from canopygrid.operators import layers as lay
from canopygrid.operators import quality as qual
from canopygrid.operators import tabulate as tab
from canopygrid.operators.components import mask_components, parts_of_cells
from canopygrid.operators.distance import euclidean_distances
from canopygrid.operators.metrics import evaluation_metrics, regression_sample
from canopygrid.operators.opening import opened_pixels, stratum_key
from canopygrid.operators.order_stats import exact_median, theil_sen_slope
from canopygrid.operators.ranking import top_n
from canopygrid.operators.rasterize import rasterize_divisions
from canopygrid.operators.tiles import read_tiled, write_tiled
from canopygrid.plans import phases as ph
from canopygrid.plans import run as runs
from canopygrid.sources import pixels as src
from canopygrid.sources.results import ResultStore, named, write_csv

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Evaluation cells of 24 ha are 16 x 16 pixels of 30 m.
CELL_HA = 24
# Number of classes that leaves gaps between fitting and prediction.
FINE = 254
FOREST = (5, 8)
YEARS = 1.5


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ph.with_masks(data.layers(spark, sf_dir))


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ph.with_derived_maps(masked(spark, sf_dir))


def measured(spark: SparkSession, sf_dir: str, *distances: str) -> tuple[DataFrame, ph.GridSpec]:
    """The prepared pixel table with the named distances."""
    grid = data.grid_of(spark, sf_dir)
    return ph.prepare(data.layers(spark, sf_dir), grid, 1, distances), grid


def fitted(spark: SparkSession, sf_dir: str) -> tuple[ph.Fit, DataFrame, ph.GridSpec, int]:
    """Benchmark CAL phase."""
    pixels, grid = measured(spark, sf_dir, "t1_distance", "t2_distance")
    nrt = cls.threshold_value(ph.threshold(pixels, grid))
    return ph.fit(pixels, "benchmark", "CAL", grid, nrt=nrt), pixels, grid, nrt


def predicted(spark: SparkSession, sf_dir: str, **options) -> tuple[ph.Prediction, ph.GridSpec]:
    """Benchmark CNF phase."""
    fit, pixels, grid, nrt = fitted(spark, sf_dir)
    return ph.predict(pixels, fit.frequency, "benchmark", "CNF", grid, nrt=nrt, **options), grid


def fine_regions(spark: SparkSession, sf_dir: str, phase: str) -> DataFrame:
    """Alternative-model regions of a phase with many narrow classes."""
    grid = data.grid_of(spark, sf_dir)
    return ph.risk_class(derived(spark, sf_dir), "alternative", phase, grid, FINE, None)


def fine_gap(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A frequency table fitted on the smaller forest of CNF, and the regions of CAL."""
    fit = cut(tab.frequency_table(fine_regions(spark, sf_dir, "CNF"), loss="t2t3_deforestation"))
    return fit, tab.distinct_regions(fine_regions(spark, sf_dir, "CAL"))


# Sources and projections


@query
def coregistered_layers(spark, sf_dir):
    """Two layer tables joined to a template; the second lacks many pixels."""
    base = data.layers(spark, sf_dir)
    lost = base.filter(F.col("fcbm") >= 6).select("row", "col", F.lit(1).alias("value"))
    wide = src.coregister(
        base.select("row", "col"), {"lost": lost, "division": base.select("row", "col", "division")}
    )
    return wide.select("row", "col", F.col("lost").cast("int"), "division")


@query
def tile_layer(spark, sf_dir):
    """Pixels gathered into dense 16 x 16 tiles, sentinel where there is no loss."""
    base = data.layers(spark, sf_dir).withColumn("v", F.when(F.col("fcbm") >= 6, F.col("fcbm")))
    return src.pixels_to_tiles(base, 16, 16, "v", 255.0).select(
        "tile_r",
        "tile_c",
        F.size("data").alias("n_cells"),
        F.aggregate("data", F.lit(0.0), lambda a, x: a + x).cast("long").alias("total"),
        F.get("data", 0).cast("int").alias("first_cell"),
        F.get("data", 255).cast("int").alias("last_cell"),
    )


@query
def tile_layer_values(spark, sf_dir):
    """Every value of the dense tiles by its place."""
    base = data.layers(spark, sf_dir).withColumn("v", F.when(F.col("fcbm") >= 6, F.col("fcbm")))
    tiles = src.pixels_to_tiles(base, 16, 16, "v", 255.0)
    return tiles.select("tile_r", "tile_c", F.posexplode("data").alias("pos", "v")).withColumn("v", F.col("v").cast("int"))


@query
def tile_pixels(spark, sf_dir):
    """The same tiles exploded back to pixels with the sentinel dropped."""
    base = data.layers(spark, sf_dir).withColumn("v", F.when(F.col("fcbm") >= 6, F.col("fcbm")))
    tiles = src.pixels_to_tiles(base, 16, 16, "v", 255.0)
    return src.tiles_to_pixels(tiles, 16, 16, "v", 255.0).select("row", "col", F.col("v").cast("int"))


@query
def encoded_layer(spark, sf_dir):
    """A potential in storage type with its sentinel where it is low."""
    base = data.layers(spark, sf_dir).withColumn("v", F.when(F.col("etp_cal") > 0.2, F.col("etp_cal") * 300))
    return src.encode_layer(base, "v", "uint8")


@query
def combined_mask(spark, sf_dir):
    return data.layers(spark, sf_dir).select("row", "col", lay.combined_mask().alias("mask"))


@query
def area_mask(spark, sf_dir):
    return data.layers(spark, sf_dir).select("row", "col", lay.area_mask(2).alias("area"))


@query
def masked_change(spark, sf_dir):
    return masked(spark, sf_dir).select("row", "col", "fcbm")


@query
def derived_maps(spark, sf_dir):
    return derived(spark, sf_dir).select("row", "col", *lay.DERIVED_MAPS)


@query
def applied_masks(spark, sf_dir):
    """The fills of a mask application, and values kept by a template."""
    base = masked(spark, sf_dir).withColumn("zero_mask", lay.combined_mask())
    return base.select(
        "row",
        "col",
        lay.apply_mask("division", "fcbm", "auto").alias("to_zero"),
        lay.apply_mask("division", "fcbm", "nodata", value_nodata=-1).alias("to_null"),
        lay.apply_mask("division", "fcbm", -9999).alias("to_number"),
        lay.apply_mask("division", "zero_mask", 0, mask_declares_nodata=False).alias("by_zero_mask"),
        lay.keep_where_valid("division", "fcbm").alias("by_template"),
    )


@query
def review_map(spark, sf_dir):
    value = lay.review_map("t1_forest", "t1t2_deforestation", "t2t3_deforestation")
    return derived(spark, sf_dir).select("row", "col", value.alias("review"))


@query
def map_algebra_conditions(spark, sf_dir):
    base = masked(spark, sf_dir)
    expressions = {
        "lost": "if(map1[1] == 8, 1, if(map1[1] == no_data, no_data, 0))",
        "valid": "if(map1[1] != no_data, map2[1], no_data)",
        "either": "(map1[1] == 6) | (map1[1] == 7)",
        "product": "map2[1] * (map3[1] > 0.5)",
        "not_five": "if(map1[1] != 5 and map3[1] <= 0.5, 2, 1)",
    }
    for name, text in expressions.items():
        base = algebra.map_algebra(base, text, ["fcbm", "division", "etp_cal"], name)
    return base.select("row", "col", *expressions)


@query
def map_algebra_functions(spark, sf_dir):
    base = data.layers(spark, sf_dir)
    expressions = {
        "v_ln": "ln(map1[1])",
        "v_log10": "log10(map1[1])",
        "v_sqrt": "sqrt(map1[1] - 0.5)",
        "v_square": "square(map1[1])",
        "v_trig": "sin(map1[1]) + cos(map1[1]) - tan(map1[1])",
        "v_arc": "arcsin(map1[1]) + arccos(map1[1]) * arctan(map1[1])",
        "v_abs": "abs(-map1[1])",
        "v_round": "round_up(map1[1] * 10) - round_down(map1[1] * 10)",
        "v_ratio": "map1[1] / (map2[1] - 5)",
        "v_power": "map1[1] ** 2 + 1",
    }
    for name, text in expressions.items():
        base = algebra.map_algebra(base, text, ["etp_cal", "fcbm"], name, "float64")
    return rounded(base.select("row", "col", *expressions), *expressions, digits=9)


@query
def map_algebra_no_numbers(spark, sf_dir):
    """Roots of negative values, logarithms of zero, divisors of zero and NoData inside expressions."""
    base = masked(spark, sf_dir)
    flags = {
        "root_above": "if(sqrt(map1[1] - 5) > 1, 1, 0)",
        "root_equal": "if(sqrt(map1[1] - 5) == sqrt(map1[1] - 5), 1, 0)",
        "root_missing": "if(sqrt(map1[1] - 5) == no_data, 1, 0)",
        "ratio_above": "if(map2[1] / (map1[1] - 5) > 0.5, 1, 0)",
        "log_below": "if(ln(map1[1] - 5) < 0, 1, 0)",
    }
    numbers = {"root_up": "round_up(sqrt(map1[1] - 5))", "huge_up": "round_up(map2[1] * 1e300) / 1e300"}
    for name, text in flags.items():
        base = algebra.map_algebra(base, text, ["fcbm", "etp_cal"], name)
    for name, text in numbers.items():
        base = algebra.map_algebra(base, text, ["fcbm", "etp_cal"], name, "float64")
    return rounded(base.select("row", "col", *flags, *numbers), *numbers, digits=9)


@query
def map_algebra_layer_scalars(spark, sf_dir):
    """Whole-layer minimum and maximum inside an expression."""
    base = algebra.map_algebra(
        data.layers(spark, sf_dir),
        "(map1[1] - min(map1[1])) / (max(map1[1]) - min(map1[1]))",
        ["etp_cal"],
        "stretched",
        "float64",
    )
    return rounded(base.select("row", "col", "stretched"), "stretched")


@query
def storage_types(spark, sf_dir):
    """Clamping and rounding of integer outputs."""
    base = data.layers(spark, sf_dir)
    value = (F.col("etp_cal") - 0.5) * 100000
    return base.select(
        "row", "col", *[algebra.to_storage(value, t).alias(f"as_{t}") for t in ("uint8", "int16", "int32")]
    )


@query
def rescaled_potential(spark, sf_dir):
    base = data.layers(spark, sf_dir)
    return rounded(base.select("row", "col", cls.rescale(base, "etp_cal").alias("rescaled")), "rescaled")


# Distances, thresholds, classes


@query
def euclidean_distance(spark, sf_dir):
    """Distance to non-forest of three periods, in one pass, NULL outside the mask."""
    grid = data.grid_of(spark, sf_dir)
    targets = {
        name: F.coalesce(lay.derived_map(layer) == 1, F.lit(False)) for name, layer in ph.DISTANCE_SOURCES.items()
    }
    base = masked(spark, sf_dir).select("row", "col", "fcbm", "mask")
    out = euclidean_distances(base, targets, grid, "mask").select("row", "col", *targets)
    return rounded(out, *targets)


@query
def euclidean_distance_tiled(spark, sf_dir):
    """The same distance with small tiles, so that it crosses tile borders."""
    grid = data.grid_of(spark, sf_dir)
    base = masked(spark, sf_dir).select("row", "col", "fcbm")
    out = euclidean_distances(base, {"distance": F.coalesce(F.col("fcbm") == 1, F.lit(False))}, grid, None, 48)
    return rounded(out.select("row", "col", "distance"), "distance")


@query
def stored_layer_distance(spark, sf_dir):
    """The same distance on a layer file that is stored by tile, so that its pixels are not shuffled."""
    grid, path = data.grid_of(spark, sf_dir), scratch_path(spark, "layer")
    write_tiled(masked(spark, sf_dir).select("row", "col", "fcbm"), path, 8, 48)
    layer = read_tiled(spark, path, 8)
    out = euclidean_distances(layer, {"distance": F.coalesce(F.col("fcbm") == 1, F.lit(False))}, grid, None, 48, tiled=True)
    return rounded(out.select("row", "col", "distance"), "distance")


@query
def distance_histogram(spark, sf_dir):
    pixels, grid = measured(spark, sf_dir, "t1_distance")
    return ph.distance_histogram(pixels, grid)


@query
def cumulative_share(spark, sf_dir):
    pixels, grid = measured(spark, sf_dir, "t1_distance")
    bins = ph.distance_histogram(pixels, grid)
    return rounded(cls.cumulative_share(bins).select("bin", "cum_n", "cum_share"), "cum_share")


@query
def price_histogram(spark, sf_dir):
    """The generic histogram over a long measure column."""
    return cls.histogram(data.table(spark, sf_dir, "lineitem"), "l_extendedprice", 2500.0)


@query
def risk_threshold(spark, sf_dir):
    pixels, grid = measured(spark, sf_dir, "t1_distance")
    return rounded(ph.threshold(pixels, grid), "cum_share")


@query
def class_edges(spark, sf_dir):
    """Boundaries of the benchmark classes below the threshold of the data."""
    pixels, grid = measured(spark, sf_dir, "t1_distance")
    nrt = cls.threshold_value(ph.threshold(pixels, grid))
    return rounded(cls.edge_table(spark, cls.benchmark_edges(nrt, 30, grid.step)), "upper", "lower")


@query
def geo_classes_benchmark(spark, sf_dir):
    pixels, grid = measured(spark, sf_dir, "t1_distance")
    nrt = cls.threshold_value(ph.threshold(pixels, grid))
    return ph.risk_class(pixels, "benchmark", "CAL", grid, 30, nrt).select("row", "col", "risk_class")


@query
def geo_classes_alternative(spark, sf_dir):
    base = derived(spark, sf_dir)
    return ph.risk_class(base, "alternative", "CAL", data.grid_of(spark, sf_dir), 30, None).select(
        "row", "col", "risk_class"
    )


@query
def region_ids(spark, sf_dir):
    out = fine_regions(spark, sf_dir, "CAL").withColumn("zone", cls.zone_of())
    return out.select("row", "col", "region_id", "zone")


# Tables by region


@query
def frequency_table(spark, sf_dir):
    """Flagship: classes, regions and relative frequencies of the fitting phase."""
    fit, _, _, _ = fitted(spark, sf_dir)
    return rounded(fit.frequency.drop("imputed"), "rel_freq").orderBy("region_id")


@query
def frequency_with_background(spark, sf_dir):
    """The fitted table with a row of zeros for the background."""
    fit, _, _, _ = fitted(spark, sf_dir)
    return rounded(tab.with_background(fit.frequency).drop("imputed"), "rel_freq")


@query
def frequency_table_alternative(spark, sf_dir):
    base = ph.risk_class(derived(spark, sf_dir), "alternative", "CAL", data.grid_of(spark, sf_dir), 30, None)
    return rounded(tab.frequency_table(base, loss="t1t2_deforestation").drop("imputed"), "rel_freq")


@query
def merged_counts(spark, sf_dir):
    """Loss and area counts of different phases, merged by a full outer join."""
    losses = tab.loss_counts(fine_regions(spark, sf_dir, "CAL"), loss="t1t2_deforestation")
    return tab.merge_counts(losses, tab.region_counts(fine_regions(spark, sf_dir, "CNF")))


@query
def region_total(spark, sf_dir):
    return tab.region_total(fine_regions(spark, sf_dir, "CAL"))


@query
def missing_regions(spark, sf_dir):
    fit, ids = fine_gap(spark, sf_dir)
    return tab.missing_regions(ids, fit)


@query
def unseen_zones(spark, sf_dir):
    fit, ids = fine_gap(spark, sf_dir)
    return tab.unseen_zones(ids, fit)


@query
def zone_averages(spark, sf_dir):
    fit, ids = fine_gap(spark, sf_dir)
    rows = tab.zone_rows(fit, tab.missing_regions(ids, fit))
    return rounded(tab.zone_averages(rows), "zone_defor", "zone_freq")


@query
def imputed_frequency(spark, sf_dir):
    fit, ids = fine_gap(spark, sf_dir)
    return rounded(tab.impute_regions(fit, ids), "rel_freq")


@query
def frequency_map(spark, sf_dir):
    fit, _, _, _ = fitted(spark, sf_dir)
    out = adj.frequency_map(fit.pixels.drop("density"), fit.frequency, "t1t2_deforestation")
    return rounded(out.select("row", "col", "rel_freq"), "rel_freq")


@query
def density_fit(spark, sf_dir):
    fit, _, _, _ = fitted(spark, sf_dir)
    return rounded(fit.pixels.select("row", "col", "density"), "density")


@query
def density_predict(spark, sf_dir):
    """Predicted density with imputed regions, alternative model with narrow classes."""
    grid = data.grid_of(spark, sf_dir)
    fit, _ = fine_gap(spark, sf_dir)
    target = fine_regions(spark, sf_dir, "CAL")
    table = tab.impute_regions(fit, tab.distinct_regions(target))
    return rounded(adj.density_map(target, table, grid.pixel_ha).select("row", "col", "density"), "density")


# Adjustment


@query
def adjustment_ratio(spark, sf_dir):
    """Modelled and actual totals before any adjustment."""
    fit, pixels, grid, nrt = fitted(spark, sf_dir)
    target = ph.risk_class(pixels, "benchmark", "CNF", grid, 30, nrt)
    regions = adj.region_densities(tab.region_counts(target), fit.frequency, grid.pixel_ha)
    actual = pixels.agg((F.count(F.when(F.col("t2t3_deforestation") == 1, 1)) * grid.pixel_ha).alias("ad")).scalar()
    out = regions.agg(F.sum(F.col("n_px") * F.col("density")).alias("md")).select(
        "md", actual.alias("ad"), F.try_divide(actual, F.col("md")).alias("ar")
    )
    return rounded(out, "md", "ad", "ar")


@query
def adjustment_log(spark, sf_dir):
    done, _ = predicted(spark, sf_dir)
    return rounded(done.adjustment.log_table(), "md", "ad", "ar")


@query
def adjustment_log_expected(spark, sf_dir):
    """Log of the validity period: a target above what the cap allows never converges."""
    pixels, grid = measured(spark, sf_dir, "t1_distance", "t3_distance")
    nrt = cls.threshold_value(ph.threshold(pixels, grid))
    fit = ph.fit(pixels, "benchmark", "HRP", grid, nrt=nrt)
    expected = adj.actual_total(pixels, "hrp_deforestation", grid.pixel_ha) / 2
    done = ph.predict(
        pixels, fit.frequency, "benchmark", "VP", grid, nrt=nrt, expected_ha=expected, years=10
    )
    return rounded(done.adjustment.log_table(), "md", "ad", "ar")


@query
def adjusted_density(spark, sf_dir):
    done, _ = predicted(spark, sf_dir)
    return rounded(done.pixels.select("row", "col", "adjusted"), "adjusted")


@query
def annual_density(spark, sf_dir):
    """Adjusted density of a ten-year period as a yearly rate."""
    done, _ = predicted(spark, sf_dir, years=10)
    return rounded(done.pixels.select("row", "col", "adjusted"), "adjusted", digits=8)


# Evaluation


@query
def eval_cells(spark, sf_dir):
    """Pixels per Thiessen cell of the sample grid, before any filter."""
    grid = data.grid_of(spark, sf_dir)
    g = cel.spacing(CELL_HA, grid)
    return cel.cell_coverage(cel.with_cell(masked(spark, sf_dir), g, grid))


@query
def edge_filter(spark, sf_dir):
    grid = data.grid_of(spark, sf_dir)
    g = cel.spacing(CELL_HA, grid)
    return cel.edge_filter(cel.cell_coverage(cel.with_cell(masked(spark, sf_dir), g, grid)))


@query
def zonal_sums(spark, sf_dir):
    """Sums of two layers per cell."""
    grid = data.grid_of(spark, sf_dir)
    keyed = cel.with_cell(derived(spark, sf_dir), cel.spacing(CELL_HA, grid), grid)
    out = cel.zonal_sums(keyed, {"potential": "etp_cal", "losses": "hrp_deforestation"})
    return rounded(out, "potential", "losses")


def cells_of(spark, sf_dir) -> DataFrame:
    done, grid = predicted(spark, sf_dir)
    return cut(cel.evaluation_grid(done.pixels, grid, CELL_HA, loss="t2t3_deforestation", density="adjusted"))


@query
def evaluation_cells(spark, sf_dir):
    return rounded(cells_of(spark, sf_dir), "area_ha", "actual_ha", "pred_ha", "residual_ha")


@query
def regression_cells(spark, sf_dir):
    cells = regression_sample(cells_of(spark, sf_dir))
    return rounded(cells.select("cell_id", "actual_ha", "pred_ha"), "actual_ha", "pred_ha")


@query
def evaluation_statistics(spark, sf_dir):
    out = evaluation_metrics(cells_of(spark, sf_dir), CELL_HA)
    return rounded(out, *[c for c in out.columns if c != "n"])


@query
def median_and_slope_distributed(spark, sf_dir):
    """Exact median and Theil-Sen slope by distributed selection, over order values per customer."""
    points = cut(
        data.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
            F.count("*").cast("double").alias("x"), F.sum("o_totalprice").alias("y")
        ).withColumn("x", F.col("x") + F.col("o_custkey") % 97)
    )
    n = points.count()
    out = spark.createDataFrame(
        [(n, exact_median(points, "y"), theil_sen_slope(points, "x", "y", chunk=4096))],
        "n long, med_y double, ts_slope double",
    )
    return rounded(out, "med_y", "ts_slope", digits=3)


@query
def evaluation_cells_strict(spark, sf_dir):
    """Cells whose coverage is measured per connected part of the area mask."""
    grid = data.grid_of(spark, sf_dir)
    pixels = derived(spark, sf_dir).withColumn("density", F.col("etp_cal") * grid.pixel_ha)
    coverage = ph.strict_coverage(pixels, grid, CELL_HA)
    out = cel.evaluation_grid(pixels, grid, CELL_HA, loss="hrp_deforestation", coverage=coverage)
    return rounded(out, "area_ha", "actual_ha", "pred_ha", "residual_ha")


@query
def mask_parts(spark, sf_dir):
    """Connected parts of the forest mask: size and first pixel."""
    grid = data.grid_of(spark, sf_dir)
    parts = mask_components(derived(spark, sf_dir), grid, "t2_forest", tile=48)
    return parts.groupBy("component").agg(F.count("*").alias("n_px"))


@query
def evaluation_stage(spark, sf_dir):
    """Both models evaluated on both testing phases, through whole-run stages."""
    base, grid = data.layers(spark, sf_dir), data.grid_of(spark, sf_dir)
    stages = [s for s, (_, _, phase) in runs.STAGES.items() if phase in ("CAL", "CNF")]
    done = runs.run(stages, base, grid, ph.Params(evaluation_grid_area=CELL_HA))
    out = None
    for (model, phase), found in done.evaluations.items():
        part = found.metrics.select(
            F.lit(model).alias("model"), F.lit(phase).alias("phase"), "n", "ols_slope", "r2", "medae", "ts_slope", "ts_intercept"
        )
        out = part if out is None else out.unionByName(part)
    return rounded(out, "ols_slope", "r2", "medae", "ts_slope", "ts_intercept", digits=5)


@query
def part_coverage(spark, sf_dir):
    """Pixels per evaluation cell and connected part of the forest mask."""
    grid = data.grid_of(spark, sf_dir)
    return parts_of_cells(derived(spark, sf_dir), grid, cel.spacing(CELL_HA, grid), "t2_forest", tile=48)


@query
def evaluation_cells_of_parts(spark, sf_dir):
    """Strict cells of an area in many parts.

    Slanted gaps cut the upper cells into parts, upright ones only trim the lower
    cells: all keep as many pixels, but only the lower ones in one part.
    """
    grid = data.grid_of(spark, sf_dir)
    row, col = F.col("row"), F.col("col")
    gap = F.when(row < 56, (row + col) % 16 == 0).when(row > 56, (col + 8) % 16 == 0).otherwise(F.lit(True))
    pixels = derived(spark, sf_dir).withColumn("area", F.when((F.col("area") == 1) & ~gap, 1).otherwise(0))
    pixels = pixels.withColumn("density", F.col("etp_cal") * grid.pixel_ha)
    coverage = parts_of_cells(pixels, grid, cel.spacing(CELL_HA, grid), "area", tile=48)
    out = cel.evaluation_grid(pixels, grid, CELL_HA, loss="hrp_deforestation", coverage=coverage)
    return rounded(out, "area_ha", "actual_ha", "pred_ha", "residual_ha")


# Allocation


def allocation_base(spark, sf_dir) -> tuple[DataFrame, float]:
    pixel_ha = data.grid_of(spark, sf_dir).pixel_ha
    return materialise(data.allocation_layers(spark, sf_dir, pixel_ha)), pixel_ha


def allocated(spark, sf_dir, **options) -> alloc.Allocation:
    base, pixel_ha = allocation_base(spark, sf_dir)
    return alloc.allocate(base, pixel_ha, YEARS, FOREST, 0, **{"etp": "etp", **options})


@query
def alloc_targets(spark, sf_dir):
    pixel_ha = data.grid_of(spark, sf_dir).pixel_ha
    base = data.allocation_layers(spark, sf_dir, pixel_ha)
    return rounded(alloc.stratum_targets(base, YEARS, pixel_ha), "target_ha")


@query
def alloc_report(spark, sf_dir):
    return rounded(allocated(spark, sf_dir).report, "target_ha", "allocated_ha", "deficit_ha")


@query
def alloc_deficits(spark, sf_dir):
    return rounded(allocated(spark, sf_dir).deficits, "deficit_ha")


@query
def alloc_mask(spark, sf_dir):
    return allocated(spark, sf_dir).pixels.select("row", "col", "first_pass", "allocated")


@query
def alloc_mask_by_density(spark, sf_dir):
    """Without a potential the density ranks the pixels."""
    return allocated(spark, sf_dir, etp=None).pixels.select("row", "col", "allocated")


@query
def alloc_mask_filtered(spark, sf_dir):
    """With isolated pixels removed first."""
    base, pixel_ha = allocation_base(spark, sf_dir)
    wide = base.withColumn("region", F.col("area")).withColumn("lulc", F.when(F.col("lulc") >= 5, 5).otherwise(1))
    wide = wide.withColumn("area", F.floor(F.col("row") / 20).cast("int")).withColumn(
        "region", F.floor(F.col("col") / 24).cast("int")
    )
    done = alloc.allocate(materialise(wide), pixel_ha, 1.0, FOREST, 0, etp="etp", kernel=3)
    return done.pixels.select("row", "col", "allocated")


@query
def modified_cover(spark, sf_dir):
    out = allocated(spark, sf_dir).pixels
    return out.groupBy("area", "region", "lulc", "modified_lulc").agg(F.count("*").alias("n_px"))


@query
def modified_cover_pixels(spark, sf_dir):
    """Cover of every pixel before and after allocation."""
    return allocated(spark, sf_dir).pixels.select("row", "col", "lulc", "modified_lulc")


@query
def stratum_opening(spark, sf_dir):
    """Pixels that survive opening of strata 20 rows by 24 columns wide."""
    base = data.layers(spark, sf_dir).filter(F.col("fcbm") >= 5)
    keyed = base.select(
        "row",
        "col",
        F.floor(F.col("row") / 20).cast("int").alias("area"),
        F.floor(F.col("col") / 24).cast("int").alias("region"),
    ).select("row", "col", stratum_key())
    return opened_pixels(keyed, 3, tile=48)


@query
def top_pixels_per_division(spark, sf_dir):
    """Top-N per group with the N of each group in a table."""
    base = data.layers(spark, sf_dir)
    wanted = base.groupBy("division").agg((F.max("row") + F.min("col")).cast("long").alias("wanted"))
    return top_n(base, ["division"], "etp_cnf", cut(wanted), "wanted").select("row", "col", "division")


@query
def rasterized_divisions(spark, sf_dir):
    grid = data.grid_of(spark, sf_dir)
    polygons = data.division_polygons(spark, sf_dir, grid)
    base = masked(spark, sf_dir).select("row", "col", "mask")
    return rasterize_divisions(base, polygons, grid).select("row", "col", "division")


# Data quality and scalar functions


@query
def layers_aligned(spark, sf_dir):
    return qual.alignment_issues(data.grid_table(spark, sf_dir), "orders")


@query
def layer_crs(spark, sf_dir):
    return qual.crs_issues(data.grid_table(spark, sf_dir), "orders")


@query
def layer_extents(spark, sf_dir):
    return qual.extent_gaps(data.extent_table(spark, sf_dir), "view-0")


@query
def missing_pixels(spark, sf_dir):
    """Positions present in only one of two layers."""
    base = data.layers(spark, sf_dir)
    return qual.missing_pixels(base.filter("excl = 0"), base.filter("aoi = 1"))


@query
def quality_ids(spark, sf_dir):
    return qual.invalid_ids(data.class_table(spark, sf_dir)).select("part", "id", "problem")


@query
def quality_duplicates(spark, sf_dir):
    return qual.duplicate_ids(data.class_table(spark, sf_dir)).select("part", "id", "copies")


@query
def quality_labels(spark, sf_dir):
    return qual.labels_with_many_ids(data.class_table(spark, sf_dir))


@query
def quality_reclass(spark, sf_dir):
    classes = data.class_table(spark, sf_dir)
    return qual.unknown_labels(classes, "label_reclass", classes)


@query
def quality_transitions(spark, sf_dir):
    return qual.unknown_transition_labels(data.transition_table(spark, sf_dir), data.class_table(spark, sf_dir))


@query
def quality_flags(spark, sf_dir):
    return qual.invalid_flags(data.class_table(spark, sf_dir), "confusion").select("part", "confusion")


@query
def quality_colours(spark, sf_dir):
    return qual.invalid_colours(data.class_table(spark, sf_dir)).select("part", "component", "problem")


@query
def quality_clean_rows(spark, sf_dir):
    return qual.clean_rows(data.class_table(spark, sf_dir)).groupBy("category").agg(F.count("*").alias("n"))


@query
def quality_cleaned_table(spark, sf_dir):
    """The rows that cleaning keeps, or an error where it keeps none."""
    return qual.require_rows(qual.clean_rows(data.class_table(spark, sf_dir)))


@query
def quality_null_counts(spark, sf_dir):
    classes = data.class_table(spark, sf_dir)
    blanked = classes.withColumn("category", F.nullif("category", F.lit("")))
    return qual.column_null_counts(blanked)


@query
def quality_schema(spark, sf_dir):
    """Column checks of every class-table row's schema: kind found per expected column."""
    classes = data.class_table(spark, sf_dir)
    issues = qual.schema_issues(classes, {"part": "integer", "id": "integer", "r": "float", "label": "string", "nope": None})
    table = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(p).alias("problem")) for c, p in issues])
    return classes.agg(F.count("*").alias("n_rows")).select(F.explode(table).alias("c"), "n_rows").select(
        "c.column", "c.problem", "n_rows"
    )


@query
def text_numbers(spark, sf_dir):
    """Text to number with defaults, over the class ids."""
    classes = data.class_table(spark, sf_dir)
    return classes.select(
        "part", scalars.to_number(F.col("id"), -1.0).alias("number"), scalars.to_whole(F.col("id"), 0).alias("whole")
    )


@query
def decimal_years(spark, sf_dir):
    """Order dates in four layouts as decimal years, and the span to the ship date."""
    orders = data.table(spark, sf_dir, "orders")
    lines = data.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    layout = F.col("o_orderkey") % 5
    date = F.col("o_orderdate")
    text = (
        F.when(layout == 0, F.date_format(date, "yyyyMMdd"))
        .when(layout == 1, F.date_format(date, "yyyy/MM/dd"))
        .when(layout == 2, F.concat(F.lit(" "), F.date_format(date, "yyyy-MM-dd")))
        .when(layout == 3, F.date_format(date, "yyyy"))
        .otherwise(F.date_format(date, "yyyy-dd"))
    )
    out = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        "o_orderkey",
        scalars.decimal_year(text).alias("ordered"),
        scalars.period_years(text, F.date_format("shipped", "yyyy-MM-dd")).alias("years"),
    )
    return rounded(out, "ordered", "years")


# Whole workflows


def summary(spark, result: runs.RunResult, model: str) -> DataFrame:
    """One row per phase: regions, pixels and hectares."""
    parts = []
    for (name, phase), fit in result.fits.items():
        if name == model:
            parts.append(fit.pixels.agg(
                F.lit(phase).alias("phase"), F.countDistinct("region_id").alias("n_regions"),
                F.count("region_id").alias("n_px"), F.sum("density").alias("total_ha"),
            ))
    for (name, phase), done in result.predictions.items():
        if name == model:
            parts.append(done.pixels.agg(
                F.lit(phase).alias("phase"), F.countDistinct("region_id").alias("n_regions"),
                F.count("region_id").alias("n_px"), F.sum("adjusted").alias("total_ha"),
            ))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return rounded(out, "total_ha", digits=5)


def workflow(spark, sf_dir, model: str, prefix: str) -> DataFrame:
    base, grid = data.layers(spark, sf_dir), data.grid_of(spark, sf_dir)
    lost = masked(spark, sf_dir).agg(F.count(F.when(F.col("fcbm").isin(6, 7, 8), 1))).first()[0]
    params = ph.Params(expected_deforestation=lost * grid.pixel_ha / 4, vp_years=10)
    stages = [s for s, (_, kind, _) in runs.STAGES.items() if s.startswith(prefix) and kind != "evaluate"]
    return summary(spark, runs.run(stages, base, grid, params), model)


@query
def workflow_benchmark(spark, sf_dir):
    """All four phases of the benchmark model."""
    return workflow(spark, sf_dir, "benchmark", "BCM")


@query
def workflow_alternative(spark, sf_dir):
    """All four phases of the alternative model."""
    return workflow(spark, sf_dir, "alternative", "ALT")


# Stored layers and results, read back


@query
def stored_layer(spark, sf_dir):
    """The divisions of lost pixels, written as a layer file and read back."""
    base = data.layers(spark, sf_dir).withColumn("value", F.when(F.col("fcbm") >= 6, F.col("division")))
    path = scratch_path(spark, "layer")
    src.write_layer(base, path, "value", "uint8")
    return src.read_layer(spark, path, nodata=src.sentinel("uint8"))


def staged(spark: SparkSession, sf_dir: str, *stages: str) -> ResultStore:
    """A store after the stages were run, each in a call of its own.

    The potentials change places: fitting on the one with few values leaves zones unseen.
    """
    store = ResultStore(spark, scratch_path(spark, "store"), project="demo", version="2")
    swapped = {"etp_cal": F.col("etp_cnf"), "etp_cnf": F.col("etp_cal")}
    base, grid = materialise(data.layers(spark, sf_dir).withColumns(swapped)), data.grid_of(spark, sf_dir)
    for stage in stages:
        runs.run([stage], base, grid, ph.Params(n_classes=FINE), store)
    return store


@query
def stored_frequency(spark, sf_dir):
    """Both revisions of a table: as fitted, and with the regions that two equal predictions found missing."""
    store = staged(spark, sf_dir, "ALT Calibration (CAL)", *["ALT Confirmation (CNF)"] * 2)
    out = store.overview("frequency").filter("project = 'demo' AND model = 'alternative' AND phase = 'CAL'")
    return rounded(out.select("stage", "revision", "region_id", "defor_px", "area_px", "rel_freq", "imputed"), "rel_freq")


@query
def staged_unseen_zones(spark, sf_dir):
    """Zones that fitting never saw, as a repeated prediction reports them."""
    store = staged(spark, sf_dir, "ALT Calibration (CAL)", *["ALT Confirmation (CNF)"] * 2)
    return store.read("unseen_zones", "alternative", "CNF")


@query
def stored_statistics(spark, sf_dir):
    """Evaluation statistics of one call, read back as a later call finds them."""
    store = ResultStore(spark, scratch_path(spark, "store"), project="demo", version="2")
    base, grid = materialise(data.layers(spark, sf_dir)), data.grid_of(spark, sf_dir)
    for stage in ("ALT Calibration (CAL)", "ALT Evaluation CAL"):
        runs.run([stage], base, grid, ph.Params(evaluation_grid_area=CELL_HA), store)
    out = store.overview("evaluation_metrics").select("stage", "model", "phase", "n", "ols_slope", "r2", "medae", "ts_slope", "ts_intercept")
    return rounded(out, "ols_slope", "r2", "medae", "ts_slope", "ts_intercept", digits=5)


@query
def stored_after_failed_write(spark, sf_dir):
    """A fitted table as readers see it after a second write of it failed half-way."""
    fit, _, _, _ = fitted(spark, sf_dir)
    store = ResultStore(spark, scratch_path(spark, "store"), project="demo", version="2")
    store.write_frequency(fit.frequency, "benchmark", "CAL")
    broken = F.when(F.col("region_id") % 7 == 0, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.lit(2.0))
    try:
        store.write_frequency(fit.frequency.withColumn("rel_freq", broken), "benchmark", "CAL", 1)
    except Exception as error:  # noqa: BLE001
        if "lost" not in str(error):
            raise
    return rounded(store.read_frequency("benchmark", "CAL").drop("imputed"), "rel_freq")


@query
def stored_threshold(spark, sf_dir):
    """The risk threshold of one call, as a later call reads it, with the histogram beside it."""
    store = staged(spark, sf_dir, "BCM Calibration (CAL)")
    bins = store.read("distance_histogram", "benchmark", "CAL")
    return rounded(bins.select("bin", "n", "cum_share", F.lit(store.read_threshold()).alias("nrt")), "cum_share")


@query
def exported_cells(spark, sf_dir):
    """Evaluation cells exported as CSV under the project's name and read back."""
    path = f"{scratch_path(spark, 'export')}/{named('01_cells.csv', 'demo', '2')}"
    cells = evaluation_cells(spark, sf_dir)
    write_csv(cells, path)
    back = spark.read.option("header", True).schema(cells.schema).csv(path)
    return back.withColumn("file", F.element_at(F.split(F.lit(path), "/"), -1))
