"""Regression metrics of predicted against actual hectares over evaluation cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopygrid.operators.order_stats import exact_medians, theil_sen_slope

# Hectares below which both sides of a cell count as empty.
SAMPLE_FLOOR_HA = 0.01

METRICS_SCHEMA = (
    "n long, ols_slope double, ols_intercept double, r2 double, medae double, medae_pct double, "
    "ts_slope double, ts_intercept double, min_actual double, max_actual double, avg_actual double, "
    "sd_actual double, min_pred double, max_pred double, avg_pred double, sd_pred double"
)


def regression_sample(cells: DataFrame) -> DataFrame:
    """Cells where either side exceeds 0.01 ha; all cells when fewer than two remain."""
    valid = (F.col("actual_ha") > SAMPLE_FLOOR_HA) | (F.col("pred_ha") > SAMPLE_FLOOR_HA)
    n_valid = cells.filter(valid).agg(F.count("*")).scalar()
    return cells.filter(valid | (n_valid < 2))


def robust_line(sample: DataFrame) -> tuple[float | None, float | None, float | None]:
    """Median of ``|actual - predicted|``, then the Theil-Sen line: median slope of pairs, ``med(y) - slope * med(x)``."""
    x, y = F.col("actual_ha"), F.col("pred_ha")
    medians = exact_medians(sample, {"error": F.abs(x - y), "x": x, "y": y})
    slope = theil_sen_slope(sample, "actual_ha", "pred_ha")
    return medians["error"], slope, None if slope is None else medians["y"] - slope * medians["x"]


def evaluation_metrics(cells: DataFrame, grid_area_ha: float) -> DataFrame:
    """One row of metrics, or none when there are fewer than two cells.

    Medians and slopes come from distributed selection at every size.  Give
    ``cells`` materialised.
    """
    x, y = F.col("actual_ha"), F.col("pred_ha")
    valid = (x > SAMPLE_FLOOR_HA) | (y > SAMPLE_FLOOR_HA)
    n_cells, n_valid = cells.agg(F.count("*"), F.count(F.when(valid, 1))).first()
    if n_cells < 2:
        return cells.sparkSession.createDataFrame([], METRICS_SCHEMA)
    sample = cells.filter(valid) if n_valid >= 2 else cells
    error, slope, intercept = (F.lit(v).cast("double") for v in robust_line(sample))
    return sample.agg(
        F.count("*").alias("n"),
        F.regr_slope(y, x).alias("ols_slope"),
        F.regr_intercept(y, x).alias("ols_intercept"),
        F.pow(F.corr(x, y), 2).alias("r2"),
        error.alias("medae"),
        (error / (int(grid_area_ha) or grid_area_ha) * 100).alias("medae_pct"),
        slope.alias("ts_slope"),
        intercept.alias("ts_intercept"),
        F.min(x).alias("min_actual"),
        F.max(x).alias("max_actual"),
        F.avg(x).alias("avg_actual"),
        F.stddev_pop(x).alias("sd_actual"),
        F.min(y).alias("min_pred"),
        F.max(y).alias("max_pred"),
        F.avg(y).alias("avg_pred"),
        F.stddev_pop(y).alias("sd_pred"),
    )
