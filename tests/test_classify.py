import math

import pytest

from canopygrid.operators import classify as cls


def test_edges():
    alt = cls.alternative_edges(5)
    assert [round(alt[0][2], 4)] + [round(u, 4) for _, u, _ in alt] == [1, 1.2589, 1.4843, 1.6805, 1.8513, 2]
    # Widths shrink by a constant factor and fill the range.
    widths = [u - low for _, u, low in cls.alternative_edges(30)]
    assert math.isclose(sum(widths), 1.0)
    assert all(math.isclose(b / a, 0.5 ** (1 / 30)) for a, b in zip(widths, widths[1:]))
    for nrt in (45, 225, 1328):
        edges = cls.benchmark_edges(nrt, 30, 30)
        assert len(edges) == 30 and edges[0][2] == nrt and edges[-1][2] == 30
        assert all(a[2] == b[1] for a, b in zip(edges[:-1], edges[1:]))
    with pytest.raises(ValueError):
        cls.benchmark_edges(30, 30, 30)
    with pytest.raises(ValueError):
        cls.alternative_edges(255)


@pytest.mark.parametrize("n", [2, 5, 30, 254])
@pytest.mark.parametrize("nrt", [45, 225, 1000])
def test_benchmark_class_follows_edges(spark, n, nrt):
    edges = cls.benchmark_edges(nrt, n, 30)
    values = sorted({30.0 * math.sqrt(k) for k in range(0, 1600, 7)} | {low for _, _, low in edges} | {nrt - 1e-9})
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "d double")
    got = {r.d: r.c for r in df.select("d", cls.benchmark_class("d", nrt, n, 30).alias("c")).collect()}
    for v in values:
        want = 0 if v < 30 else next(c for c, up, low in edges if v >= low and (up is None or v < up))
        assert got[v] == want, v
    assert got[None] is None


@pytest.mark.parametrize("n", [2, 30, 254])
def test_alternative_class_follows_edges(spark, n):
    edges = cls.alternative_edges(n)
    values = sorted({1 + k / 997 for k in range(998)} | {low for _, _, low in edges} | {2.0})
    rows = [(v, 1, 1) for v in values] + [(1.5, 0, 1), (1.5, 1, 0), (1.5, 1, None), (None, 1, 1)]
    df = spark.createDataFrame(rows, "v double, mask int, forest int")
    got = df.select("*", cls.alternative_class("v", n).alias("c")).collect()
    for row in got[: len(values)]:
        want = n if row.v >= 2 else next(c for c, up, low in edges if low <= row.v < up)
        assert row.c == want, row
    assert [r.c for r in got[len(values):]] == [0, 0, None, None]


def test_threshold_and_histogram(spark):
    df = spark.createDataFrame([(30.0,)] * 990 + [(95.0,)] * 6 + [(150.0,)] * 4, "d double")
    bins = {r.bin: (r.bin_start, r.n) for r in cls.histogram(df, "d", 30).collect()}
    assert bins == {0: (30.0, 990), 1: (60.0, 0), 2: (90.0, 6), 3: (120.0, 4)}
    assert cls.threshold_value(cls.risk_threshold(cls.histogram(df, "d", 30))) == 105
    same = spark.createDataFrame([(30.0,)] * 3, "d double")
    assert [(r.bin, r.n) for r in cls.histogram(same, "d", 30).collect()] == [(0, 3)]
    with pytest.raises(ValueError):
        cls.threshold_value(cls.risk_threshold(cls.histogram(df.filter("d < 0"), "d", 30)))


def test_region_id(spark):
    df = spark.createDataFrame([(3, 4), (0, 4), (None, 4), (3, None)], "risk_class int, division int")
    got = [r[0] for r in df.select(cls.region_id()).collect()]
    assert got == [3004, None, None, None]
    bad = spark.createDataFrame([(3, 1000)], "risk_class int, division int")
    with pytest.raises(Exception, match="outside 0..999"):
        bad.select(cls.region_id().alias("r")).collect()


def test_rescale_uses_whole_layer(spark):
    df = spark.createDataFrame([(0.5,), (2.0,), (None,), (float("nan"),)], "x double")
    got = [r[0] for r in df.select(cls.rescale(df, "x").alias("v")).collect()]
    assert got == [1.25, 2.0, None, None]
