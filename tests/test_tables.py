"""Frequency tables, imputation, density, adjustment."""

import random

import pytest
from pyspark.sql import functions as F

from canopygrid.operators import adjust as adj
from canopygrid.operators import tabulate as tab

TABLE = "region_id int, defor_px long, area_px long, rel_freq double, imputed boolean"


def test_frequency_counts_every_region_pixel(spark):
    random.seed(5)
    rows = [(random.choice([2002, 2003, 3002, None]), random.choice([0, 1, None])) for _ in range(500)]
    df = spark.createDataFrame(rows, "region_id int, loss int")
    table = {r.region_id: r for r in tab.frequency_table(df).collect()}
    assert sum(r.area_px for r in table.values()) == sum(r is not None for r, _ in rows)
    for region, row in table.items():
        assert row.defor_px == sum(a == region and b == 1 for a, b in rows)
        assert row.rel_freq == row.defor_px / row.area_px and not row.imputed
    merged = tab.merge_counts(tab.loss_counts(df), tab.region_counts(df))
    assert {(r.region_id, r.defor_px, r.area_px) for r in merged.collect()} == {
        (k, r.defor_px, r.area_px) for k, r in table.items()
    }
    assert tab.region_total(df).first()[0] == 3


def test_unseen_zone_gets_zero(spark):
    fit = spark.createDataFrame([(z * 1000 + 2, z, 100, z / 100.0, False) for z in range(2, 31)], TABLE)
    ids = [z * 1000 + 2 for z in range(2, 31)] + [1001, 1002, 1003, 1004, 5003]
    predicted = spark.createDataFrame([(i,) for i in ids], "region_id int")
    assert {r[0] for r in tab.missing_regions(predicted, fit).collect()} == {1001, 1002, 1003, 1004, 5003}
    assert [r[0] for r in tab.unseen_zones(predicted, fit).collect()] == [1]
    full = {r.region_id: r for r in tab.impute_regions(fit, predicted).collect()}
    assert len(full) == 34
    assert all(full[i].rel_freq == 0 and full[i].imputed and full[i].area_px == 0 for i in (1001, 1002, 1003, 1004))
    assert full[5003].rel_freq == pytest.approx(0.05) and full[5003].defor_px == 5
    # A second imputation ignores rows that were imputed before.
    again = tab.impute_regions(
        spark.createDataFrame([tuple(r) for r in full.values()], TABLE),
        spark.createDataFrame([(5004,)], "region_id int"),
    )
    assert again.filter("region_id = 5004").first().rel_freq == pytest.approx(0.05)
    assert tab.with_background(fit).filter("region_id = 0").first().rel_freq == 0


def test_lookup_is_exact(spark):
    table = spark.createDataFrame([(2002, 0.5), (2005, 0.9)], "region_id int, rel_freq double")
    pixels = spark.createDataFrame([(0, 2002, 2), (1, 2003, 2), (2, None, 0), (3, None, None)], "p int, region_id int, risk_class int")
    got = {r.p: r.density for r in adj.density_map(pixels, table, 0.09).collect()}
    assert got == {0: pytest.approx(0.045), 1: 0, 2: 0, 3: None}


def regions(spark, rows):
    return spark.createDataFrame(rows, "region_id int, n_px long, density double")


def test_overestimate_shrinks_in_one_round(spark):
    table = regions(spark, [(2002, 100, 0.05), (3002, 50, 0.01)])
    done = adj.adjust(table, 5.5 * 0.88, 0.09)
    assert done.converged and len(done.log) == 2
    assert [r.adjusted for r in done.regions.orderBy("region_id").collect()] == [pytest.approx(0.044), pytest.approx(0.0088)]


def test_growth_is_capped_and_monotone(spark):
    random.seed(2)
    table = regions(spark, [(i, random.randint(1, 90), random.random() * 0.09) for i in range(40)])
    md = adj.modelled_total(table)
    done = adj.adjust(table, md * 1.3, 0.09, max_iterations=60)
    rows = done.regions.collect()
    assert done.converged and all(r.adjusted <= 0.09 for r in rows)
    assert sum(r.n_px * r.adjusted for r in rows) == pytest.approx(md * 1.3, rel=1e-4)
    # The outcome is one common factor below the cap.
    factors = [r.adjusted / r.density for r in rows if r.adjusted < 0.09]
    assert max(factors) == pytest.approx(min(factors))
    assert [a for a, *_ in done.log] == list(range(len(done.log)))


def test_unreachable_total_stops(spark):
    table = regions(spark, [(1, 10, 0.05), (2, 10, 0.0)])
    done = adj.adjust(table, 100.0, 0.09, max_iterations=4, years=10)
    assert not done.converged and len(done.log) == 5
    assert {r.region_id: round(r.adjusted, 9) for r in done.regions.collect()} == {1: 0.009, 2: 0.0}
    assert done.log_table().count() == 5


def test_ratio_errors(spark):
    table = regions(spark, [(1, 10, 0.0)])
    with pytest.raises(ValueError, match="modelled total is 0"):
        adj.adjust(table, 5.0, 0.09)
    with pytest.raises(ValueError, match="observed-loss"):
        adj.adjust(regions(spark, [(1, 10, 0.1)]), None, 0.09)


def test_frequency_map_follows_loss_layer(spark):
    table = spark.createDataFrame([(2002, 0.5)], "region_id int, rel_freq double")
    pixels = spark.createDataFrame([(0, 2002, 1), (1, 2002, None), (2, None, 0)], "p int, region_id int, loss int")
    got = {r.p: r.rel_freq for r in adj.frequency_map(pixels, table).collect()}
    assert got == {0: 0.5, 1: None, 2: 0.0}
    assert pixels.filter(F.col("loss").isNull()).count() == 1
