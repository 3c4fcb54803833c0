"""Evaluation cells, metrics, order statistics, mask components."""

import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopygrid.grid import GridSpec
from canopygrid.operators import cells as cel
from canopygrid.operators import metrics as met
from canopygrid.operators.components import contract, mask_components
from canopygrid.functions.ordered import from_ordered, ordered_bits, to_ordered
from canopygrid.operators import order_stats
from canopygrid.operators.order_stats import exact_median, exact_medians, inversions, residuals, theil_sen_slope


def test_spacing():
    assert cel.spacing(50000, GridSpec(10, 10, 10.0, 10.0)) == 2236
    assert cel.spacing(24, GridSpec(10, 10)) == 16
    with pytest.raises(ValueError):
        cel.spacing(0.01, GridSpec(10, 10))


@pytest.mark.parametrize("g", [3, 4, 7])
def test_cells_are_nearest_sample_points(spark, g):
    height, width = 23, 31
    df = spark.createDataFrame([(r, c) for r in range(height) for c in range(width)], "row int, col int")
    points = [(y, x) for y in range(-g, height + g, g) for x in range(-g, width + g, g)]
    for row in df.select("*", cel.cell_index("row", g).alias("a"), cel.cell_index("col", g).alias("b")).collect():
        def gap(p):
            return (row.row + 0.5 - p[0]) ** 2 + (row.col + 0.5 - p[1]) ** 2

        assert gap((row.a * g, row.b * g)) <= min(map(gap, points)) + 1e-9


def grid_pixels(spark, height, width, exclude=()):
    rows = [
        (r, c, 1, int((r, c) not in exclude), int((r + c) % 3 == 0), 0.01 * (r % 5))
        for r in range(height)
        for c in range(width)
    ]
    return spark.createDataFrame(rows, "row int, col int, area int, mask int, loss int, density double")


def test_exclusions_apply_after_edge_filter(spark):
    grid = GridSpec(16, 16, 100.0, 100.0)
    emptied = {(r, c) for r in range(2, 6) for c in range(2, 6)}
    partly = {(6, 6), (6, 7)}
    full = cel.evaluation_grid(grid_pixels(spark, 16, 16), grid, 16).collect()
    got = cel.evaluation_grid(grid_pixels(spark, 16, 16, emptied | partly), grid, 16).collect()
    assert len(full) == 9 and len(got) == 8  # the emptied cell vanishes, the partial one stays
    assert sorted(r.cell_id for r in full) == list(range(1, 10))
    cut_cell = next(r for r in got if (r.cell_r, r.cell_c) == (2, 2))
    assert cut_cell.area_ha == 14.0
    for r in full:
        assert r.residual_ha == pytest.approx(r.pred_ha - r.actual_ha)


def test_strict_coverage_needs_one_component(spark):
    grid = GridSpec(12, 12, 100.0, 100.0)
    base = grid_pixels(spark, 12, 12).withColumn("area", F.when(F.col("col") == 4, 0).otherwise(1))
    coverage = cel.part_coverage(mask_components(base, grid, "area", tile=5), 4, grid)
    assert {(r.cell_c, r.area_px) for r in coverage.filter("cell_r = 1").collect()} == {(0, 8), (1, 8), (1, 4), (2, 16)}
    strict = cel.evaluation_grid(base, grid, 16, coverage=coverage)
    assert {r.cell_c for r in strict.collect()} == {2}
    # A thin gap splits a cell without costing it 0.1 % of its area.
    split = spark.createDataFrame([(0, 0, 1_200_000, 1), (0, 0, 1_200_000, 2), (1, 0, 2_400_500, 1)], "cell_r int, cell_c int, area_px long, component int")
    assert [tuple(r)[:2] for r in cel.edge_filter(split).collect()] == [(1, 0)]
    whole = split.groupBy("cell_r", "cell_c").agg(F.sum("area_px").alias("area_px"))
    assert cel.edge_filter(whole).count() == 2


def cells(spark, xs, ys):
    return spark.createDataFrame(list(zip(map(float, xs), map(float, ys))), "actual_ha double, pred_ha double")


def theil_sen(xs, ys):
    slopes = [(ys[j] - ys[i]) / (xs[j] - xs[i]) for i, j in itertools.permutations(range(len(xs)), 2) if xs[j] > xs[i]]
    slope = float(np.median(slopes))
    return slope, float(np.median(ys)) - slope * float(np.median(xs))


def test_metrics_match_numpy(spark):
    rng = np.random.default_rng(3)
    xs = np.round(rng.random(61) * 20, 1)
    xs[:15] = 0.0
    ys = xs * 0.7 + rng.random(61)
    row = met.evaluation_metrics(cells(spark, xs, ys), 24).first()
    slope, intercept = np.polyfit(xs, ys, 1)
    assert row.n == 61
    assert (row.ols_slope, row.ols_intercept) == (pytest.approx(slope), pytest.approx(intercept))
    assert row.r2 == pytest.approx(np.corrcoef(xs, ys)[0, 1] ** 2)
    assert row.medae == pytest.approx(np.median(abs(xs - ys)))
    assert row.medae_pct == pytest.approx(row.medae / 24 * 100)
    assert (row.ts_slope, row.ts_intercept) == tuple(map(pytest.approx, theil_sen(list(xs), list(ys))))
    assert row.sd_actual == pytest.approx(xs.std()) and row.max_pred == pytest.approx(ys.max())


def test_sample_rules(spark):
    assert met.evaluation_metrics(cells(spark, [1], [1]), 24).count() == 0
    assert met.evaluation_metrics(cells(spark, [1], [1]).limit(0), 24).count() == 0
    # Only one cell above the floor: all cells are used.
    assert met.regression_sample(cells(spark, [5, 0, 0], [4, 0, 0])).count() == 3
    assert met.evaluation_metrics(cells(spark, [5, 0, 0], [4, 0, 0]), 24).first().n == 3
    assert met.regression_sample(cells(spark, [5, 2, 0], [4, 0, 0])).count() == 2


@pytest.mark.parametrize("n,block", [(40, 7), (41, 1000), (9, 3)])
def test_distributed_selection_is_exact(spark, n, block):
    random.seed(n)
    xs = [float(random.randint(0, 12)) for _ in range(n)]
    ys = [random.choice([0.0, random.random() * 1e6, -random.random()]) for _ in range(n)]
    df = spark.createDataFrame(list(zip(xs, ys)), "x double, y double")
    assert exact_median(df, "y") == pytest.approx(float(np.median(ys)), rel=1e-12)
    assert theil_sen_slope(df, "x", "y", block) == pytest.approx(theil_sen(xs, ys)[0], rel=1e-12)
    flat = df.withColumn("x", F.lit(1.0))
    assert theil_sen_slope(flat, "x", "y", block) is None
    assert exact_median(df.filter("y > 1e9"), "y") is None


def flood(flags):
    height, width = flags.shape
    label = -np.ones(flags.shape, dtype=int)
    for r in range(height):
        for c in range(width):
            if flags[r, c] and label[r, c] < 0:
                stack, label[r, c] = [(r, c)], r * width + c
                while stack:
                    a, b = stack.pop()
                    for x, y in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)):
                        if 0 <= x < height and 0 <= y < width and flags[x, y] and label[x, y] < 0:
                            label[x, y] = r * width + c
                            stack.append((x, y))
    return label


@pytest.mark.parametrize("share,tile", [(0.6, 6), (0.5, 64), (0.95, 4)])
def test_components_match_flood_fill(spark, share, tile):
    rng = np.random.default_rng(int(share * 100))
    flags = rng.random((25, 29)) < share
    flags[:, 10] = True
    rows = [(int(r), int(c), int(flags[r, c])) for r in range(25) for c in range(29)]
    df = spark.createDataFrame(rows, "row int, col int, mask int")
    want = flood(flags)
    got = mask_components(df, GridSpec(25, 29), tile=tile).collect()
    assert len(got) == flags.sum()
    assert all(r.component == want[r.row, r.col] for r in got)


def test_contract_long_chain_and_hub(spark):
    chain = [(i, i + 1) for i in range(200)]
    hub = [(1000, 1000 + i) for i in range(1, 300)]
    got = {r.u: r.v for r in contract(spark.createDataFrame(chain + hub, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, **{1000 + i: 1000 for i in range(1, 300)}}


EXTREME = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, math.nextafter(1.0, 2), math.nextafter(1.0, 0), 1.7e308, -1.7e308, math.inf, -math.inf, 2.0**1023, 2.0**-1022, 0.1, 3.0, math.nan]


def test_ordered_bits_are_the_bits(spark):
    rng = np.random.default_rng(1)
    values = [*EXTREME, *rng.integers(-(1 << 63), 1 << 63, 3000).view(np.float64).tolist(), *(2.0 ** rng.integers(-1074, 1024, 300)).tolist()]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = [r.k for r in df.select(ordered_bits(F.col("v")).alias("k")).collect()]
    assert got.pop() is None
    for v, k in zip(values, got, strict=True):
        assert (math.isnan(v) and k == (1 << 63) - 1) or (k == to_ordered(v) and from_ordered(k) == v)


@pytest.mark.parametrize("values", [[math.inf, -math.inf, 1.0], [1.7e308, 1.7e308], [-1.7e308, 1.7e308], [1.7e308, -1.7e308, 3.0, 4.0], [0.1] * 9, [5e-324, 0.0], [math.inf, math.inf, -math.inf]])
def test_medians_of_extreme_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ordered = sorted(values)
    a, b = ordered[(len(values) - 1) // 2], ordered[len(values) // 2]
    assert exact_median(df, "v") == (a if a == b else a / 2 + b / 2)


def test_medians_of_several_columns(spark):
    rng = np.random.default_rng(2)
    table = np.c_[rng.lognormal(0, 9, 501), rng.integers(0, 3, 501), rng.random(501)]
    df = spark.createDataFrame(table.tolist(), "a double, b double, c double").withColumn("d", F.lit(None).cast("double"))
    found = exact_medians(df, {c: F.col(c) for c in "abcd"})
    assert [found[c] for c in "abc"] == np.median(table, axis=0).tolist() and found["d"] is None


def test_inversions_of_lanes():
    rng = np.random.default_rng(3)
    for _ in range(60):
        lanes = np.repeat(np.arange(4), rng.integers(0, 25, 4))
        high, low, w = rng.integers(0, 6, len(lanes)) * 1.0, rng.integers(0, 2, len(lanes)) * 1e-20, rng.integers(1, 5, len(lanes))
        want = [sum(w[i] * w[j] for i, j in itertools.combinations(np.flatnonzero(lanes == k), 2) if (high[i], low[i]) > (high[j], low[j])) for k in range(4)]
        assert inversions(lanes, high, low, w, 4).tolist() == want


def test_residuals_keep_their_error():
    x, y, slope = np.array([3.0, 0.1, 1 / 3]), np.array([1.0, 0.3, -7.0]), np.array([1 / 3, 0.1])
    high, low = residuals(x, y, slope)
    for i, s in enumerate(slope):
        for j in range(3):
            exact = Fraction(float(y[j])) - Fraction(float(s)) * Fraction(float(x[j]))
            assert abs(exact - Fraction(float(high[i, j])) - Fraction(float(low[i, j]))) <= Fraction(2) ** -100


@pytest.mark.parametrize("kind", ["near", "ties", "steep", "copies"])
def test_slopes_of_hard_points(spark, monkeypatch, kind):
    """Nearly equal slopes, tied ones, great ranges and repeated points, with few proposals so that the search goes the whole way."""
    monkeypatch.setattr(order_stats, "SAMPLE", 5)
    monkeypatch.setattr(order_stats, "MANY_SLOPES", 40)
    rng = np.random.default_rng(4)
    x = {"near": rng.random(60) + 1e6, "ties": rng.integers(0, 9, 60) * 1.0, "steep": rng.lognormal(0, 12, 60), "copies": rng.integers(0, 4, 60) * 1.0}[kind]
    y = {"near": x * 0.7 + rng.random(60) * 1e-6, "ties": np.where(rng.random(60) < 0.7, 0.0, 1.0), "steep": rng.lognormal(0, 12, 60), "copies": rng.integers(0, 3, 60) * 1.0}[kind]
    df = spark.createDataFrame(np.c_[x, y].tolist() + [[math.inf, 1.0], [1.0, math.nan]], "x double, y double")
    want = theil_sen(x.tolist(), y.tolist())[0]
    for chunk in (7, 1000):
        assert theil_sen_slope(df, "x", "y", chunk) == pytest.approx(want, rel=1e-12, abs=1e-300)
