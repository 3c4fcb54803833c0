"""Top-N selection, allocation, opening, polygons to pixels."""

import math
import random

import numpy as np
import pytest

from canopygrid.grid import GridSpec
from canopygrid.operators import allocate as alloc
from canopygrid.operators import ranking
from canopygrid.operators.opening import opened_pixels
from canopygrid.operators.ranking import top_n
from canopygrid.operators.rasterize import rasterize_divisions, top_runs


@pytest.mark.parametrize("bits", [4, 8, 16])
def test_top_n_matches_sort(spark, bits):
    random.seed(bits)
    # One group holds most rows and most of its scores tie.
    rows = [
        (r, c, random.choice(["a", "a", "a", "b", "c"]), random.choice([0.5, 0.5, 0.5, 1e-9, 0.25, random.random(), 1e12]))
        for r in range(30)
        for c in range(30)
    ]
    df = spark.createDataFrame(rows, "row int, col int, g string, s double")
    wanted = {"a": 321, "b": 0, "c": 10_000, "d": 4}
    targets = spark.createDataFrame(list(wanted.items()), "g string, n long")
    got = {(r.row, r.col) for r in top_n(df, ["g"], "s", targets, "n", bits).collect()}
    want = set()
    for g, n in wanted.items():
        order = sorted((r for r in rows if r[2] == g), key=lambda r: (-r[3], r[0], r[1]))
        want |= {(r[0], r[1]) for r in order[:n]}
    assert got == want


@pytest.mark.parametrize("kind", ["infinite", "tied", "lognormal"])
def test_top_n_ends_for_any_scores(spark, kind):
    random.seed(5)
    scores = {"infinite": lambda: random.choice([math.inf, math.inf, -math.inf, 1.0, 2.0]), "tied": lambda: 0.5, "lognormal": lambda: random.lognormvariate(0, 5)}
    rows = [(r, c, "g", scores[kind]()) for r in range(30) for c in range(20)]
    df = spark.createDataFrame(rows, "row int, col int, g string, s double")
    targets = spark.createDataFrame([("g", 333)], "g string, n long")
    got = {(r.row, r.col) for r in top_n(df, ["g"], "s", targets, "n").collect()}
    assert got == {(r[0], r[1]) for r in sorted(rows, key=lambda r: (-r[3], r[0], r[1]))[:333]}


@pytest.mark.parametrize("kind, most", [("uniform", 4), ("tied", 5), ("lognormal", 5), ("infinite", 6)])
def test_scans_are_few_for_any_scores(spark, monkeypatch, kind, most):
    """Every scan of the pixels counts one digit; digits in which nothing differs are skipped."""
    random.seed(6)
    draw = {"uniform": random.random, "tied": lambda: 0.25, "lognormal": lambda: random.lognormvariate(0, 9), "infinite": lambda: random.choice([math.inf, math.inf, 0.0, 1.0])}[kind]
    rows = [(r, c, g, draw()) for g in range(3) for r in range(20) for c in range(20)]
    scans, true = [], ranking._counts
    monkeypatch.setattr(ranking, "_counts", lambda *a: scans.append(a) or true(*a))
    df = spark.createDataFrame(rows, "row int, col int, g int, s double")
    targets = spark.createDataFrame([(0, 133), (1, 1), (2, 399)], "g int, n long")
    got = sorted((r.g, r.row, r.col) for r in top_n(df, ["g"], "s", targets, "n").collect())
    assert got == sorted((g, r, c) for g, n in ((0, 133), (1, 1), (2, 399)) for r, c, *_ in sorted((x for x in rows if x[2] == g), key=lambda x: (-x[3], x[0], x[1]))[:n])
    assert len(scans) <= min(most, 8)


def reference_allocation(rows, pixel_ha, years, forest, score):
    targets, areas = {}, {}
    for r in rows:
        if r["density"] is not None:
            targets[r["area"], r["region"]] = targets.get((r["area"], r["region"]), 0.0) + r["density"] * years
    taken = set()

    def usable(r):
        return r["lulc"] in forest and r[score] is not None and r[score] > 0

    def rank(r):
        return (-r[score], r["row"], r["col"])

    for (area, region), ha in targets.items():
        n = math.ceil(ha / pixel_ha - 1e-9)
        own = sorted((r for r in rows if usable(r) and (r["area"], r["region"]) == (area, region)), key=rank)[:n]
        taken |= {(r["row"], r["col"]) for r in own}
        areas[area] = areas.get(area, 0.0) + max(0.0, ha - len(own) * pixel_ha)
    first = set(taken)
    for area, ha in areas.items():
        left = sorted((r for r in rows if usable(r) and r["area"] == area and (r["row"], r["col"]) not in first), key=rank)
        taken |= {(r["row"], r["col"]) for r in left[: math.ceil(ha / pixel_ha - 1e-9)]}
    return first, taken


@pytest.mark.parametrize("etp", ["etp", None])
def test_allocation_matches_plain_python(spark, etp):
    random.seed(11)
    rows = [
        dict(
            row=r, col=c, area=r // 8, region=random.choice([1, 1, 1, 2, 3]), lulc=random.choice([1, 5, 5, 8]),
            density=random.choice([0.02, 0.05, 0.09, None]), etp=random.choice([0.0, -1.0, 0.3, 0.3, random.random(), None]),
        )
        for r in range(24)
        for c in range(20)
    ]
    df = spark.createDataFrame(rows, "row int, col int, area int, region int, lulc int, density double, etp double")
    done = alloc.allocate(df, 0.09, 0.9, (5, 8), 0, etp=etp)
    out = done.pixels.collect()
    assert len(out) == len(rows)
    first, taken = reference_allocation(rows, 0.09, 0.9, (5, 8), etp or "density")
    assert {(r.row, r.col) for r in out if r.first_pass} == first
    assert {(r.row, r.col) for r in out if r.allocated} == taken
    assert all(r.modified_lulc == (0 if r.allocated else r.lulc) for r in out)
    report = done.report.collect()
    assert sum(r.allocated_px for r in report) == len(first)
    assert all(r.allocated_px == min(r.target_px, r.available_px) for r in report)


def test_deficit_stays_in_its_area(spark):
    # Stratum A wants 3 pixels and has 1, B wants 1 and has 4; another area is untouched.
    rows = [(0, 0, 1, 1, 5, 0.27, 0.9)]
    rows += [(1, c, 1, 2, 5, 0.0225, 0.5 - c / 10) for c in range(4)]
    rows += [(2, c, 2, 1, 5, 0.0, 0.9) for c in range(3)]
    df = spark.createDataFrame(rows, "row int, col int, area int, region int, lulc int, density double, etp double")
    done = alloc.allocate(df, 0.09, 1, (5,), etp="etp")
    out = done.pixels.collect()
    assert sum(r.first_pass for r in out) == 2
    assert {(r.row, r.col) for r in out if r.allocated} == {(0, 0), (1, 0), (1, 1), (1, 2)}
    assert {r.area: r.deficit_px for r in done.deficits.collect()} == {1: 2, 2: 0}


def opening(labels, steps):
    def near(a):
        wide = np.pad(a, 1)
        return [wide[:-2, 1:-1], wide[2:, 1:-1], wide[1:-1, :-2], wide[1:-1, 2:]]

    alive = np.zeros(labels.shape, dtype=bool)
    for value in set(labels.ravel()) - {0}:
        mask = labels == value
        for _ in range(steps):
            mask = mask & np.logical_and.reduce(near(mask))
        for _ in range(steps):
            mask = mask | np.logical_or.reduce(near(mask))
        alive |= mask
    return alive


@pytest.mark.parametrize("kernel,tile", [(3, 9), (5, 7), (5, 64), (1, 8)])
def test_opening_per_stratum(spark, kernel, tile):
    rng = np.random.default_rng(kernel * tile)
    labels = np.where(rng.random((33, 41)) < 0.9, 1 + (np.arange(41)[None, :] // 17), 0) * np.ones((33, 1), dtype=int)
    rows = [(int(r), int(c), int(labels[r, c])) for r in range(33) for c in range(41) if labels[r, c]]
    df = spark.createDataFrame(rows, "row int, col int, stratum long")
    got = {(r.row, r.col): r.stratum for r in opened_pixels(df, kernel, tile).collect()}
    want = opening(labels, kernel // 2)
    assert set(got) == {(int(r), int(c)) for r, c in np.argwhere(want)}
    assert all(labels[p] == s for p, s in got.items())


def inside(x, y, rings):
    hit = False
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
            if (y0 > y) != (y1 > y) and x < x0 + (y - y0) * (x1 - x0) / (y1 - y0):
                hit = not hit
    return hit


def test_polygons_to_pixels(spark):
    grid = GridSpec(40, 300, 30.0, 30.0, 1000.0, 5000.0)

    def at(col, row):
        return (1000.0 + 30.0 * col, 5000.0 - 30.0 * row)

    shapes = {
        0: [[at(2.3, 1.1), at(290.7, 5.2), at(280.1, 38.9), at(5.2, 30.3)], [at(20.1, 10.2), at(40.4, 10.2), at(30.2, 20.6)]],
        1: [[at(250.2, -5.1), at(310.3, 20.2), at(250.2, 45.6)]],
        2: [[at(100.1, 12.2), at(120.3, 12.2), at(120.3, 18.7), at(110.2, 14.1), at(100.1, 18.7)]],
    }
    polygons = spark.createDataFrame(
        [(s, [dict(x=x, y=y) for x, y in ring]) for s, rings in shapes.items() for ring in rings],
        "seq int, ring array<struct<x:double,y:double>>",
    )
    rows = [(r, c, int(c % 7 != 0)) for r in range(40) for c in range(300)]
    df = spark.createDataFrame(rows, "row int, col int, mask int")
    for row in rasterize_divisions(df, polygons, grid).collect():
        x, y = at(row.col + 0.5, row.row + 0.5)
        hits = [s for s, rings in shapes.items() if inside(x, y, rings)]
        want = (max(hits) + 2 if hits else 1) if row.mask else None
        assert row.division == want, (row, hits)


def test_top_runs():
    rng = np.random.default_rng(8)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        first = rng.integers(0, 60, n)
        last, seq = first + rng.integers(0, 30, n), rng.permutation(n)
        want = {}
        for f, l, s in zip(first, last, seq):
            for c in range(f, l + 1):
                want[c] = max(want.get(c, -1), int(s))
        runs = top_runs(first, last, seq)
        assert {c: s for f, l, s in runs for c in range(f, l + 1)} == want
        assert all(a[1] < b[0] for a, b in zip(runs, runs[1:]))


def test_many_polygons_over_one_block(spark):
    rng = random.Random(9)
    boxes = [(rng.randint(0, 250), rng.randint(0, 28), rng.randint(1, 60), rng.randint(1, 10)) for _ in range(10_000)]
    grid = GridSpec(32, 256, 30.0, 30.0)
    at = lambda c, r: {"x": grid.origin_x + 30.0 * c, "y": grid.origin_y - 30.0 * r}
    rings = [(i, [at(c, r), at(c + w, r), at(c + w, r + h), at(c, r + h)]) for i, (c, r, w, h) in enumerate(boxes)]
    polygons = spark.createDataFrame(rings, "seq int, ring array<struct<x:double,y:double>>")
    pixels = spark.createDataFrame([(r, c, 1) for r in range(32) for c in range(256)], "row int, col int, mask int")
    want = np.full((32, 256), 1)
    for i, (c, r, w, h) in enumerate(boxes):
        want[r : r + h, c : c + w] = i + 2
    got = rasterize_divisions(pixels, polygons, grid).collect()
    assert len(got) == 32 * 256 and all(x.division == want[x.row, x.col] for x in got)

