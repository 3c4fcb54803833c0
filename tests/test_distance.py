import numpy as np
import pytest

from pyspark.sql import functions as F

from canopygrid.grid import GridSpec
from canopygrid.lineage import scratch_path
from canopygrid.operators.distance import distance_to, squared_distances
from canopygrid.operators.tiles import read_tiled, write_tiled


def brute(points, height, width):
    rows, cols = np.mgrid[0:height, 0:width]
    best = np.full((height, width), np.iinfo(np.int64).max)
    for r, c in points:
        best = np.minimum(best, (rows - r) ** 2 + (cols - c) ** 2)
    return best


@pytest.mark.parametrize("seed,tile,density", [(1, 8, 0.02), (2, 5, 0.003), (3, 64, 0.05), (4, 7, 0.3)])
def test_matches_brute_force(spark, seed, tile, density):
    rng = np.random.default_rng(seed)
    height, width = 37, 53
    a = rng.random((height, width)) < density
    b = rng.random((height, width)) < density / 3
    a[5, 7] = True
    b[30, 50] = True
    present = rng.random((height, width)) < 0.7  # the table may lack pixels
    rows = [
        (int(r), int(c), int(a[r, c]), int(b[r, c]), "x")
        for r in range(height)
        for c in range(width)
        if present[r, c] or a[r, c] or b[r, c]
    ]
    df = spark.createDataFrame(rows, "row int, col int, a int, b int, note string")
    got = squared_distances(df, {"da": F.col("a") == 1, "db": F.col("b") == 1}, GridSpec(height, width), tile)
    assert got.columns == ["row", "col", "a", "b", "note", "da", "db"]
    want_a, want_b = brute(np.argwhere(a), height, width), brute(np.argwhere(b), height, width)
    out = got.collect()
    assert len(out) == len(rows)
    for row in out:
        assert row.da == want_a[row.row, row.col]
        assert row.db == want_b[row.row, row.col]


def test_no_target_gives_null_and_mask_clears(spark):
    df = spark.createDataFrame([(0, 0, 1, 1), (0, 3, 0, 1), (0, 4, 0, 0)], "row int, col int, a int, m int")
    grid = GridSpec(1, 5, 30.0, 30.0)
    assert all(r.distance is None for r in distance_to(df, "a", 9, grid).collect())
    got = {r.col: r.distance for r in distance_to(df, "a", 1, grid, mask="m", tile=2).collect()}
    assert got == {0: 0.0, 3: 90.0, 4: None}


def test_stored_tiles_are_not_shuffled(spark):
    """Pixels of a layer stored by tile reach both grouped steps without an exchange; only carried values and parabolas are dealt."""
    rng = np.random.default_rng(6)
    flags = rng.random((40, 50)) < 0.02
    flags[0, 0] = True
    pixels = spark.createDataFrame([(r, c, int(flags[r, c])) for r in range(40) for c in range(50)], "row int, col int, a int")
    path = scratch_path(spark, "layer")
    write_tiled(pixels, path, 4, 16)
    out = squared_distances(read_tiled(spark, path, 4), {"d": F.col("a") == 1}, GridSpec(40, 50), 16, tiled=True)
    lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    scans = [i for i, line in enumerate(lines) if "FileScan parquet" in line and "Bucketed: true" in line]
    assert scans
    grouped = 0
    for i in scans:
        level, above = depth(lines[i]), []
        for line in reversed(lines[:i]):
            if depth(line) < level:
                level = depth(line)
                above.append(line)
        first = next((a for a in above if "Exchange" in a or "CoGroups" in a), "")
        # Ends of columns are summed up before they are dealt; everything else meets its group at once.
        grouped += "CoGroups" in first
    assert grouped == 2
    want = brute(np.argwhere(flags), 40, 50)
    found = out.collect()
    assert len(found) == 2000 and all(r.d == want[r.row, r.col] for r in found)
