"""Data-quality checks, layer files, result store."""

import pytest
from pyspark.sql import functions as F

from canopygrid.operators import quality as qual
from canopygrid.sources import pixels as src
from canopygrid.sources.results import ResultStore, named, write_csv

GRID = "layer string, height int, width int, pixel_x double, pixel_y double, origin_x double, origin_y double, crs string, projected boolean"


def test_grid_metadata_checks(spark):
    rows = [
        ("a", 10, 20, 30.0, 30.0, 0.0, 0.0, "EPSG:1", True),
        ("b", 10, 20, 30.0, 30.0, 0.0, 0.0, "EPSG:1", True),
        ("c", 11, 20, 30.0, 30.0, 5.0, 0.0, "EPSG:2", True),
        ("d", 10, 20, 30.0, 30.0, 0.0, 0.0, None, False),
    ]
    df = spark.createDataFrame(rows, GRID)
    got = {(r.layer, r.field) for r in qual.alignment_issues(df, "a").collect()}
    assert got == {("c", "height"), ("c", "origin_x"), ("c", "crs"), ("d", "crs")}
    assert {(r.layer, r.problem) for r in qual.crs_issues(df, "a").collect()} == {("c", "differs"), ("d", "missing")}


def test_extents(spark):
    rows = [("a", "x", 0.0, 0.0, 10.0, 10.0), ("b", "x", 10.0, 10.0, 12.0, 12.0), ("c", "x", 10.1, 0.0, 12.0, 5.0), ("d", "y", 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "layer string, crs string, min_x double, min_y double, max_x double, max_y double")
    assert {(r.layer, r.problem) for r in qual.extent_gaps(df, "a").collect()} == {("c", "no overlap"), ("d", "crs mismatch")}


def test_class_table_checks(spark):
    rows = [("1", "x", "300"), (" 1 ", "x", "12"), ("2.5", "y", "red"), ("-3", "y", "-1"), ("n/a", None, "0"), ("4", "z", None)]
    df = spark.createDataFrame(rows, "id string, label string, r string")
    assert {(r.id, r.problem) for r in qual.invalid_ids(df).collect()} == {("2.5", "not an integer"), ("-3", "negative"), ("n/a", "not numeric")}
    assert sorted(r.id for r in qual.duplicate_ids(df).collect()) == [" 1 ", "1"]
    assert {(r.label, r.n_ids) for r in qual.labels_with_many_ids(df).collect()} == {("x", 2), ("y", 2)}
    bad = {(r.r, r.problem) for r in qual.invalid_colours(df, ["r"]).collect()}
    assert bad == {("300", "out of range"), ("red", "not numeric"), ("-1", "out of range"), (None, "not numeric")}
    assert qual.schema_issues(df.withColumn("n", F.lit(1)), {"id": "string", "n": "float", "q": None}) == [("n", "int is not float"), ("q", "missing")]
    flags = spark.createDataFrame([("Yes",), ("NO",), ("perhaps",), (None,)], "f string")
    assert [r.f for r in qual.invalid_flags(flags, "f").collect()] == ["perhaps", None]


def test_cleaning(spark):
    df = spark.createDataFrame([("a", 1), ("", 2), ("b", None)], "t string, n int")
    assert [tuple(r) for r in qual.require_rows(qual.clean_rows(df)).collect()] == [("a", 1)]
    assert {(r.column, r.n_null) for r in qual.column_null_counts(df).collect()} == {("t", 0), ("n", 1)}
    with pytest.raises(ValueError):
        qual.require_rows(df.limit(0))


def test_transitions(spark):
    classes = spark.createDataFrame([("x", "y"), ("y", "q")], "label string, label_reclass string")
    moves = spark.createDataFrame([("x", "y"), ("p", "x"), ("y", "r")], "from_class string, to_class string")
    assert [r.value for r in qual.unknown_labels(classes, "label_reclass", classes).collect()] == ["q"]
    assert {tuple(r) for r in qual.unknown_transition_labels(moves, classes).collect()} == {("from_class", "p"), ("to_class", "r")}
    a = spark.createDataFrame([(0, 0), (0, 1)], "row int, col int")
    b = spark.createDataFrame([(0, 1), (5, 1)], "row int, col int")
    assert {tuple(r) for r in qual.missing_pixels(a, b).collect()} == {(0, 0, "layer"), (5, 1, "template")}


def test_layer_round_trip(spark, tmp_path):
    rows = [(r, c, None if c == 3 else float(r + c) / 2) for r in range(300) for c in range(5)]
    df = spark.createDataFrame(rows, "row int, col int, value double")
    path = str(tmp_path / "layer")
    src.write_layer(df, path, "value", "float64")
    back = src.read_layer(spark, path, "value", src.sentinel("float64"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    assert spark.read.parquet(path).select("block_r").distinct().count() == 2
    assert "block_r" in spark.read.parquet(path).filter("block_r = 1")._jdf.queryExecution().executedPlan().toString()
    tiles = src.pixels_to_tiles(df, 4, 2)
    again = src.tiles_to_pixels(tiles, 4, 2, "value", -9999.0)
    assert sorted(map(tuple, again.collect())) == sorted(r for r in rows if r[2] is not None)
    wide = src.coregister(df.select("row", "col"), {"a": df, "b": df.filter("row = 0")})
    assert wide.filter("a IS NOT NULL").count() == 1200 and wide.filter("b IS NOT NULL").count() == 4


def test_result_store(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path), "demo", "2")
    table = spark.createDataFrame([(2002, 1, 4, 0.25, False)], "region_id int, defor_px long, area_px long, rel_freq double, imputed boolean")
    with pytest.raises(FileNotFoundError, match="run that phase first"):
        store.read_frequency("benchmark", "CAL")
    store.write_frequency(table, "benchmark", "CAL")
    grown = table.unionByName(table.withColumn("region_id", F.lit(2003)).withColumn("imputed", F.lit(True)))
    assert store.add_frequency_revision(grown, "benchmark", "CAL") == 1
    assert store.read_frequency("benchmark", "CAL").count() == 2
    assert store.read_frequency("benchmark", "CAL", 0).count() == 1  # the first one stays
    store.write_frequency(table, "benchmark", "CAL")  # a new fit starts over
    assert store.read_frequency("benchmark", "CAL").count() == 1
    store.write_threshold(spark.createDataFrame([(225, 210.0, 240.0, 0.998)], "nrt int, bin_start double, bin_end double, cum_share double"))
    assert store.read_threshold() == 225
    assert store.overview("threshold").select("project", "stage", "phase").first() == ("demo", "testing", "CAL")
    write_csv(table, str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).first().region_id == "2002"


def test_names():
    assert named("forest.tif", "Demo", "1") == "Demo_forest_v1.tif"
    assert named("07_density_map.tif", "Demo", "2") == "07_Demo_density_map_v2.tif"
    assert named("forest.tif", None, "1") == "forest_v1.tif"
    assert named("forest.tif", "Demo") == "Demo_forest.tif"
    assert named("forest") == "forest"
