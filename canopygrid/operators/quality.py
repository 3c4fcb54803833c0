"""Data-quality checks that return the offending rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopygrid.functions.scalars import numeric_text
from canopygrid.grid import TILE
from canopygrid.operators.tiles import unpack, with_tile

GRID_FIELDS = ("height", "width", "pixel_x", "pixel_y", "origin_x", "origin_y", "crs")
# Accepted flags and colour range.
FLAGS = ("yes", "no")
COLOUR_RANGE = (0, 255)
# Fixed value: bits of one bitmap of the engine.
BITS = 32768
INTEGER_TYPES = ("byte", "short", "int", "bigint", "tinyint", "smallint")
FLOAT_TYPES = ("float", "double")


def alignment_issues(grids: DataFrame, reference: str) -> DataFrame:
    """``layer, field, expected, found`` for every grid property that differs from the reference layer.

    ``grids`` has one row per layer: ``layer`` and ``GRID_FIELDS``; a second row of the reference is an error.
    """
    ref = grids.filter(F.col("layer") == reference).select(F.struct(*GRID_FIELDS)).scalar()
    checks = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                ref.getField(f).cast("string").alias("expected"),
                F.col(f).cast("string").alias("found"),
            )
            for f in GRID_FIELDS
        ]
    )
    return (
        grids.filter(F.col("layer") != reference)
        .select("layer", F.explode(checks).alias("c"))
        .filter(~F.col("c.expected").eqNullSafe(F.col("c.found")))
        .select("layer", "c.field", "c.expected", "c.found")
    )


def _presence(layer: DataFrame) -> DataFrame:
    """``tile, half, bits``: the positions of a layer as one bitmap for each half of a tile."""
    place = F.pmod("row", F.lit(TILE)) * TILE + F.pmod("col", F.lit(TILE))
    placed = with_tile(layer.select("row", "col")).select("tile", F.floor(place / BITS).alias("half"), (place % BITS).cast("long").alias("bit"))
    return placed.groupBy("tile", "half").agg(F.bitmap_construct_agg("bit").alias("bits"))


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions whose bits differ."""
    for batch in batches:
        for tile, half, a, b in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            tile_r, tile_c = unpack(tile)
            sides = [np.unpackbits(np.frombuffer(x or bytes(BITS // 8), dtype=np.uint8), bitorder="little") for x in (a, b)]
            at = np.flatnonzero(sides[0] != sides[1])
            place = at + half * BITS
            side = pa.DictionaryArray.from_arrays(pa.array((1 - sides[0][at]).astype(np.int32)), ["layer", "template"]).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array((place // TILE + tile_r * TILE).astype(np.int32)), pa.array((place % TILE + tile_c * TILE).astype(np.int32)), side], names=["row", "col", "side"]
            )


def missing_pixels(layer: DataFrame, template: DataFrame) -> DataFrame:
    """``row, col, side`` of positions found in only one of two layers.

    Tasks build bitmaps of the tiles they meet; only these are shuffled and
    combined, so the cost of the comparison does not grow with the pixels of a tile.
    """
    a, b = _presence(layer), _presence(template).withColumnRenamed("bits", "others")
    differ = a.join(b, ["tile", "half"], "full").filter(~F.col("bits").eqNullSafe(F.col("others")))
    return differ.select("tile", "half", "bits", "others").mapInArrow(_differences, "row int, col int, side string")


def crs_issues(grids: DataFrame, reference: str) -> DataFrame:
    """Layers whose CRS is missing, geographic, or differs from the reference.

    ``grids`` also has ``projected`` (boolean).
    """
    ref = grids.filter(F.col("layer") == reference).select("crs").scalar()
    problem = (
        F.when(F.col("crs").isNull(), "missing")
        .when(~F.col("projected"), "not projected")
        .when(~F.col("crs").eqNullSafe(ref), "differs")
    )
    return grids.select("layer", "crs", problem.alias("problem")).filter("problem IS NOT NULL")


def extent_gaps(extents: DataFrame, reference: str) -> DataFrame:
    """Layers whose extent does not meet the reference extent, or cannot be compared.

    ``extents`` has ``layer, crs, min_x, min_y, max_x, max_y``.
    """
    ref = (
        extents.filter(F.col("layer") == reference)
        .select(F.struct("crs", "min_x", "min_y", "max_x", "max_y"))
        .scalar()
    )
    apart = (
        (ref.getField("max_x") < F.col("min_x"))
        | (F.col("max_x") < ref.getField("min_x"))
        | (ref.getField("max_y") < F.col("min_y"))
        | (F.col("max_y") < ref.getField("min_y"))
    )
    problem = F.when(F.col("crs") != ref.getField("crs"), "crs mismatch").when(apart, "no overlap")
    return extents.filter(F.col("layer") != reference).select("layer", problem.alias("problem")).filter("problem IS NOT NULL")


def schema_issues(df: DataFrame, required: dict[str, str | None]) -> list[tuple[str, str]]:
    """``(column, problem)`` for missing columns or columns of another kind.

    ``required`` maps names to ``"integer"``, ``"float"``, ``"string"`` or None for any.
    """
    types = dict(df.dtypes)
    kinds = {"integer": INTEGER_TYPES, "float": FLOAT_TYPES, "string": ("string",)}
    problems = []
    for name, kind in required.items():
        if name not in types:
            problems.append((name, "missing"))
        elif kind is not None and types[name] not in kinds[kind]:
            problems.append((name, f"{types[name]} is not {kind}"))
    return problems


def invalid_ids(df: DataFrame, column: str = "id") -> DataFrame:
    """Rows whose id is not a non-negative whole number, with the reason."""
    number = numeric_text(F.col(column).cast("string")).try_cast("double")
    problem = (
        F.when(number.isNull() | F.isnan(number), "not numeric")
        .when(number != F.floor(number), "not an integer")
        .when(number < 0, "negative")
    )
    return df.withColumn("problem", problem).filter("problem IS NOT NULL")


def duplicate_ids(df: DataFrame, column: str = "id") -> DataFrame:
    """All rows whose numeric id occurs more than once.

    Counts are combined before the shuffle and joined back, so one very
    frequent id does not gather its rows in one task.
    """
    number = numeric_text(F.col(column).cast("string")).try_cast("double")
    keyed = df.withColumn("_id", number)
    repeated = keyed.filter("_id IS NOT NULL").groupBy("_id").agg(F.count("*").alias("copies")).filter("copies > 1")
    return keyed.join(repeated, "_id").drop("_id")


def labels_with_many_ids(df: DataFrame, label: str = "label", column: str = "id") -> DataFrame:
    """Labels that map to more than one id, with the number of ids."""
    pairs = df.filter(F.col(label).isNotNull() & F.col(column).isNotNull()).select(label, column).distinct()
    return pairs.groupBy(label).agg(F.count("*").alias("n_ids")).filter("n_ids > 1")


def unknown_labels(df: DataFrame, column: str, classes: DataFrame, label: str = "label") -> DataFrame:
    """Distinct values of ``column`` that are no label of the class table."""
    known = classes.select(F.col(label).cast("string").alias("_known")).distinct()
    values = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).distinct()
    return values.join(known, F.col("value") == F.col("_known"), "left_anti")


def unknown_transition_labels(transitions: DataFrame, classes: DataFrame, label: str = "label") -> DataFrame:
    """``side, value`` of transition ends that are no label of the class table."""
    sides = [
        unknown_labels(transitions, c, classes, label).select(F.lit(c).alias("side"), "value")
        for c in ("from_class", "to_class")
    ]
    return sides[0].unionByName(sides[1])


def invalid_flags(df: DataFrame, column: str) -> DataFrame:
    """Rows whose flag is not yes or no in any case."""
    return df.filter(~F.lower(F.coalesce(F.col(column).cast("string"), F.lit("nan"))).isin(*FLAGS))


def invalid_colours(df: DataFrame, columns: Sequence[str] = ("r", "g", "b")) -> DataFrame:
    """``problem`` per row and component: not numeric, or outside 0..255."""

    def check(name: str) -> Column:
        number = numeric_text(F.col(name).cast("string")).try_cast("double")
        problem = F.when(number.isNull() | F.isnan(number), "not numeric").when(
            ~number.between(*COLOUR_RANGE), "out of range"
        )
        return F.struct(F.lit(name).alias("component"), problem.alias("problem"))

    return (
        df.withColumn("_c", F.explode(F.array(*[check(c) for c in columns])))
        .filter("_c.problem IS NOT NULL")
        .select(*df.columns, "_c.component", "_c.problem")
    )


def clean_rows(df: DataFrame) -> DataFrame:
    """Blank text to NULL, rows with any NULL dropped."""
    blanked = df.select(
        *[F.nullif(F.col(n), F.lit("")).alias(n) if t == "string" else F.col(n) for n, t in df.dtypes]
    )
    return blanked.dropna("any")


def require_rows(df: DataFrame) -> DataFrame:
    """The table itself, or an error when it is empty."""
    if df.isEmpty():
        raise ValueError("no valid rows after cleaning")
    return df


def column_null_counts(df: DataFrame) -> DataFrame:
    """``column, n_null, n_rows`` in one pass."""
    counts = df.agg(
        F.count("*").alias("n_rows"), *[F.count(F.when(F.col(n).isNull(), 1)).alias(f"n_{i}") for i, n in enumerate(df.columns)]
    )
    rows = F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"n_{i}").alias("n_null")) for i, n in enumerate(df.columns)])
    return counts.select(F.explode(rows).alias("c"), "n_rows").select("c.column", "c.n_null", "n_rows")


