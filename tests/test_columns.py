"""Layer projections, map algebra, scalar functions."""

import math

import pytest
from pyspark.sql import functions as F

from canopygrid.functions import algebra, scalars
from canopygrid.operators import layers as lay


def column(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_review_map_golden(spark):
    forest = [[1, 1, 1, 0], [1, 1, 1, 0], [1, 1, 0, 0]]
    first = [[0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 0]]
    second = [[0, 0, 0, 0], [1, 0, 0, 0], [0, 1, 0, 0]]
    want = [[1, 2, 1, 0], [3, 1, 2, 0], [1, 3, 0, 0]]
    rows = [(r, c, forest[r][c], first[r][c], second[r][c]) for r in range(3) for c in range(4)]
    df = spark.createDataFrame(rows + [(9, 9, 1, 1, None)], "row int, col int, f int, a int, b int")
    got = {(r.row, r.col): r.v for r in df.select("row", "col", lay.review_map("f", "a", "b").alias("v")).collect()}
    assert got.pop((9, 9)) == 1  # no second-period data keeps the forest value
    assert got == {(r, c): want[r][c] for r in range(3) for c in range(4)}


def test_combined_mask_truth_table(spark):
    rows = [(1, 0), (1, 1), (1, 50), (1, None), (2, 0), (None, 0)]
    df = spark.createDataFrame(rows, "aoi int, excl int")
    assert column(df, lay.combined_mask()) == [1, 0, 1, 1, 0, 0]
    assert column(df, lay.area_mask()) == [1, 1, 1, 1, 0, 0]


def test_derived_maps_cover_all_classes(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 9)] + [(None,)], "fcbm int")
    got = {n: column(df, lay.derived_map(n)) for n in lay.DERIVED_MAPS}
    for name, classes in lay.DERIVED_MAPS.items():
        assert got[name] == [int(i in classes) for i in range(1, 9)] + [None]
    # Forest and non-forest of a period complement each other.
    for t in ("t1", "t2", "t3"):
        assert all(a + b == 1 for a, b in zip(got[f"{t}_forest"][:8], got[f"{t}_non_forest"][:8]))


def test_apply_mask_fills(spark):
    df = spark.createDataFrame([(5, 1, 1), (5, None, 0)], "x int, m int, z int")
    assert column(df, lay.apply_mask("x", "m")) == [5, 0]
    assert column(df, lay.apply_mask("x", "m", "nodata", value_nodata=255)) == [5, None]
    assert column(df, lay.apply_mask("x", "m", 7)) == [5, 7]
    assert column(df, lay.apply_mask("x", "z", 7, mask_declares_nodata=False)) == [5, 7]


def evaluate(spark, text, rows=((8.0, 2.0), (5.0, 0.0), (None, 1.0)), dtype="float64"):
    df = spark.createDataFrame(list(rows), "a double, b double")
    return [r.value for r in algebra.map_algebra(df, text, ["a", "b"], dtype=dtype).collect()]


@pytest.mark.parametrize(
    "text,want",
    [
        ("if(map1[1]==8,1,if(map1[1]==no_data,no_data,0))", [1, 0, None]),
        ("if(map1[1] != no_data, map2[1], no_data)", [2, 0, None]),
        ("if(map1[1] != 8, 1, 0)", [0, 1, 1]),  # no data differs from every value
        ("map1[1] / map2[1]", [4, None, None]),
        ("ln(map2[1])", [math.log(2), None, 0]),
        ("sqrt(map2[1] - 1)", [1, None, 0]),
        ("arcsin(map2[1] - 1)", [math.pi / 2, -math.pi / 2, 0]),
        ("map2[1] * (map1[1] > 6)", [2, 0, 0]),
        ("(map1[1] == 8) & (map2[1] == 2) | (map1[1] == no_data)", [1, 0, 1]),
        ("~(map1[1] == 8)", [0, 1, 1]),
        ("max(map1[1]) - min(map1[1]) + 0 * map2[1]", [3, 3, 3]),
        ("round_up(map2[1] / 4) - round_down(map2[1] / 4)", [1, 0, 1]),
        ("if(map2[1], 1, 0)", [1, 0, 1]),
        ("-square(map2[1]) + 2 ** 3", [4, 8, 7]),
    ],
)
def test_map_algebra(spark, text, want):
    got = evaluate(spark, text)
    assert all((g is None) == (w is None) and (g is None or math.isclose(g, w, abs_tol=1e-12)) for g, w in zip(got, want)), got


@pytest.mark.parametrize(
    "text,want",
    [
        ("if(sqrt(map1[1]) > 1, 1, 0)", [0, 0, 0, 0]),
        ("if(sqrt(map1[1]) == sqrt(map1[1]), 1, 0)", [1, 1, 0, 1]),
        ("round_up(sqrt(map1[1] - 0.5))", [None, 1, None, None]),
        ("round_up(map1[1] * 1e300) / 1e300", [0.25, 1, -4, 0]),
        ("if(map1[1] / map2[1] > 0.5, 1, 0)", [1, 1, 0, 0]),
        ("if(map1[1] / map2[1] < -0.5, 1, 0)", [0, 0, 1, 0]),
        ("if(ln(map1[1]) < 0, 1, 0)", [1, 0, 0, 1]),
        ("if(ln(map1[1]) == no_data, 1, 0)", [0, 0, 1, 0]),
        ("if(map1[1] / map2[1] == no_data, 1, 0)", [0, 0, 0, 1]),
        ("1 / (map1[1] / map2[1])", [0, 0, -0.5, None]),
    ],
)
def test_map_algebra_without_numbers(spark, text, want):
    """NaN and infinities made inside an expression follow IEEE rules."""
    rows = ((0.25, 0.0), (1.0, 0.0), (-4.0, 2.0), (0.0, 0.0))
    got = evaluate(spark, text, rows)
    assert all((g is None) == (w is None) and (g is None or math.isclose(g, w, abs_tol=1e-12)) for g, w in zip(got, want)), got


@pytest.mark.parametrize("text", ["map3[1]", "map1[2]", "__import__('os')", "open(map1[1])", "map1[1] % 2", "1 < map1[1] < 9", "map1[1] < no_data", "'a'"])
def test_map_algebra_rejects(spark, text):
    with pytest.raises(ValueError):
        evaluate(spark, text)


def test_storage_clamps(spark):
    rows = [(300.0, 0.0), (-4.0, 0.0), (2.5, 0.0), (float("nan"), 0.0), (float("inf"), 0.0)]
    assert evaluate(spark, "map1[1]", rows, "uint8") == [255, 0, 3, None, None]
    assert evaluate(spark, "map1[1] * 1000", rows, "int16") == [32767, -4000, 2500, None, None]


def test_numbers(spark):
    df = spark.createDataFrame([("123",), ("",), ("123.7",), ("invalid",), ("  42  ",), (None,), ("-3.9",)], "t string")
    assert column(df, scalars.to_whole(F.col("t"), 9)) == [123, 9, 123, 9, 42, 9, -3]
    assert column(df, scalars.to_number(F.col("t"))) == [123.0, None, 123.7, None, 42.0, None, -3.9]


def test_dates(spark):
    texts = ["2015-06-15", "20150615", "2015/06/15", " 2015 ", "2016-12-31", "2015-13-01", "1850", "soon", "2015.5"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = column(df, scalars.decimal_year(F.col("t")))
    assert got[:3] == [pytest.approx(2015.4520548, abs=1e-7)] * 3
    assert got[3] == 2015.0 and got[4] == pytest.approx(2016 + 365 / 366)
    assert got[5:] == [None, None, None, 2015.5]
    pair = spark.createDataFrame([("2015-06-15", "2020-12-31"), ("2015", "2015"), ("x", "2015")], "a string, b string")
    assert column(pair, scalars.period_years(F.col("a"), F.col("b"))) == [pytest.approx(5.5452130, abs=1e-6), None, None]
