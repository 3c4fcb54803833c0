"""Every named query against its SQL, and whole runs."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from canopygrid.catalog import bindings as data
from canopygrid.catalog.oracle import ORACLE
from canopygrid.catalog.queries import QUERIES
from canopygrid.plans import phases as ph
from canopygrid.plans import run as runs
from canopygrid.sources.results import ResultStore

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    number = float(value)
    return None if math.isnan(number) else round(number, 9) + 0.0


def ordered(rows):
    return sorted(rows, key=lambda row: [(v is None, str(type(v)), v if v is not None else 0) for v in row])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = ordered(tuple(plain(v) for v in r) for r in df.select(columns).collect())
    result = duck.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    picks = [names.index(c) for c in columns]
    want = ordered(tuple(plain(r[i]) for i in picks) for r in result.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


PARAMS = ph.Params(evaluation_grid_area=3, expected_deforestation=10.0, vp_years=10)


def test_stages_can_run_apart(spark, sf_dir, tmp_path):
    """A run split over several calls through the store equals one call."""
    layers, grid = data.layers(spark, sf_dir), data.grid_of(spark, sf_dir)
    bcm = [s for s, (model, _, _) in runs.STAGES.items() if model == "benchmark"]
    whole = runs.run(bcm, layers, grid, PARAMS)
    store = ResultStore(spark, str(tmp_path))
    parts = {}
    for stage in bcm:
        parts[stage] = runs.run([stage], layers, grid, PARAMS, store)
    assert {p.nrt for s, p in parts.items() if "Evaluation" not in s} == {whole.nrt}
    for key, done in whole.predictions.items():
        part = parts[next(s for s in bcm if runs.STAGES[s][0::2] == key and runs.STAGES[s][1] == "predict")].predictions[key]
        assert [round(r[1], 6) for r in part.adjustment.log] == [round(r[1], 6) for r in done.adjustment.log]
    for key, done in whole.evaluations.items():
        part = parts[next(s for s in bcm if runs.STAGES[s][0::2] == key and runs.STAGES[s][1] == "evaluate")].evaluations[key]
        assert part.cells.agg(F.round(F.sum("pred_ha"), 6)).first() == done.cells.agg(F.round(F.sum("pred_ha"), 6)).first()
    # A repeated prediction starts from the fitted rows, so it sees the same zones and adds no revision.
    unseen = store.read("unseen_zones", "benchmark", "CNF").count()
    revisions = store.read("frequency", "benchmark", "CAL").select("revision").distinct().count()
    again = runs.run(["BCM Confirmation (CNF)"], layers, grid, PARAMS, store)
    assert again.predictions["benchmark", "CNF"].unseen.count() == unseen
    assert store.read("frequency", "benchmark", "CAL").select("revision").distinct().count() == revisions
    for table in ("threshold", "distance_histogram", "class_edges", "frequency", "density", "adjustment_log", "evaluation_cells", "evaluation_metrics"):
        assert store.overview(table).count() > 0


def test_missing_inputs_are_reported(spark, sf_dir):
    layers, grid = data.layers(spark, sf_dir).drop("etp_cnf"), data.grid_of(spark, sf_dir)
    with pytest.raises(ValueError, match="benchmark CNF needs benchmark CAL first"):
        runs.run(["BCM Confirmation (CNF)"], layers, grid)
    with pytest.raises(ValueError, match="alternative CNF needs the layer etp_cnf"):
        runs.run(["ALT Calibration (CAL)", "ALT Confirmation (CNF)"], layers, grid)
    with pytest.raises(ValueError, match="positive expected deforestation"):
        runs.run(["ALT Historical Reference (HRP)", "ALT Validity Period (VP)"], layers, grid)
    with pytest.raises(ValueError, match="unknown stage"):
        runs.run(["nonsense"], layers, grid)


def test_every_pixel_has_one_class(spark, sf_dir):
    grid = data.grid_of(spark, sf_dir)
    pixels = ph.prepare(data.layers(spark, sf_dir), grid, 1, ("t1_distance",))
    classed = ph.risk_class(pixels, "benchmark", "CAL", grid, 30, 225)
    bad = classed.filter(
        ((F.col("t1_distance") > 0) & ~F.col("risk_class").between(1, 30))
        | ((F.col("t1_distance") == 0) & (F.col("risk_class") != 0))
        | (F.col("t1_distance").isNull() & F.col("risk_class").isNotNull())
    )
    assert bad.count() == 0
    fit = ph.fit(pixels, "benchmark", "CAL", grid, nrt=225)
    inside = fit.pixels.filter("region_id IS NOT NULL").count()
    assert fit.frequency.agg(F.sum("area_px")).first()[0] == inside
