"""Distance histogram, risk threshold, geometric classes and region ids."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Share of observed loss the threshold must cover, in thousandths.
THRESHOLD_PER_MILLE = 995
# Classes are stored in one byte with 255 as NoData.
MAX_CLASSES = 254
# Region id = class * DIVISION_BASE + division.
DIVISION_BASE = 1000


def observed_loss(df: DataFrame, distance: str = "distance", mask: str = "mask", loss: str = "loss") -> DataFrame:
    """Pixels of observed loss inside the mask that lie off the edge (distance > 0)."""
    return df.filter((F.col(mask) == 1) & (F.col(loss) == 1) & (F.col(distance) > 0))


def histogram(df: DataFrame, value: str, width: float, number: str | None = None) -> DataFrame:
    """Counts over half-open bins of ``width`` from the minimum; the last bin is closed.

    Rows count once, or as often as their column ``number`` says.
    Returns ``bin, bin_start, bin_end, n`` with empty bins included.  Values are
    counted per bin before the shuffle, so the shuffled data is as long as the
    histogram, not as the layer.  The bounds are one scalar subquery, which
    Spark runs once for all its uses.
    """
    v = F.col(value).cast("double")
    valid = df.filter(v.isNotNull())
    bounds = valid.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).select(F.struct("lo", "hi")).scalar()
    low, high = bounds.getField("lo"), bounds.getField("hi")
    bins = F.greatest(F.lit(1), F.ceil((high - low) / width)).cast("long")
    counted = (
        valid.select(F.least(F.floor((v - low) / width), bins - 1).cast("long").alias("bin"), (F.col(number) if number else F.lit(1)).alias("n"))
        .groupBy("bin")
        .agg(F.sum("n").alias("n"))
    )
    frame = df.sparkSession.range(1).select(low.alias("lo"), bins.alias("bins")).filter("lo IS NOT NULL")
    frame = frame.select("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("bin"))
    return frame.join(counted, "bin", "left").select(
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("bin_start"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"),
    )


def cumulative_share(bins: DataFrame) -> DataFrame:
    """Running count and running share over a histogram.

    The input is an aggregated table (bins, not pixels), so one ordered window is cheap.
    """
    running = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return bins.select(
        "*",
        F.sum("n").over(running).alias("cum_n"),
        F.sum("n").over(everything).alias("total_n"),
    ).withColumn("cum_share", F.col("cum_n") / F.col("total_n"))


def risk_threshold(bins: DataFrame) -> DataFrame:
    """One row ``nrt, bin_start, bin_end, cum_share``: middle of the first bin reaching 99.5 %.

    Integer counts are compared, so the share never ties in floating point.
    """
    reached = cumulative_share(bins).filter(F.col("cum_n") * 1000 >= F.col("total_n") * THRESHOLD_PER_MILLE)
    first = F.min_by(F.struct("bin_start", "bin_end", "cum_share"), "bin")
    return (
        reached.agg(first.alias("b"))
        .filter(F.col("b").isNotNull())
        .select(
            F.floor((F.col("b.bin_start") + F.col("b.bin_end")) / 2).cast("int").alias("nrt"),
            "b.bin_start",
            "b.bin_end",
            "b.cum_share",
        )
    )


def threshold_value(threshold: DataFrame) -> int:
    """The threshold as an integer; an empty selection is an error."""
    row = threshold.first()
    if row is None:
        raise ValueError("no observed loss away from the edge: the risk threshold is undefined")
    return int(row["nrt"])


def _check_classes(n: int) -> int:
    if not 2 <= int(n) <= MAX_CLASSES:
        raise ValueError(f"number of classes must lie in 2..{MAX_CLASSES}")
    return int(n)


def benchmark_edges(nrt: float, n_classes: int, step: float) -> list[tuple[int, float | None, float]]:
    """``(class, upper, lower)``: class 1 lies beyond the threshold, the rest shrink
    geometrically from the threshold to one pixel.

    The lowest edge is exactly one pixel, so pixels at that distance always
    belong to the top class.
    """
    n, low, high = _check_classes(n_classes), int(step), int(nrt)
    if high <= low:
        raise ValueError("the risk threshold must exceed the pixel size")
    ratio = (low / high) ** (1 / (n - 1))
    cuts = [high * ratio**i for i in range(n)]
    cuts[0], cuts[-1] = float(high), float(low)
    return [(1, None, cuts[0])] + [(i + 2, cuts[i], cuts[i + 1]) for i in range(n - 1)]


def alternative_edges(n_classes: int) -> list[tuple[int, float, float]]:
    """``(class, upper, lower)`` over [1, 2]: widths shrink by ``0.5 ** (1 / n)`` per class."""
    n = _check_classes(n_classes)
    cuts = [3.0 - 2.0 ** ((n - m) / n) for m in range(n + 1)]
    return [(m + 1, cuts[m + 1], cuts[m]) for m in range(n)]


def edge_table(spark: SparkSession, edges: Sequence[tuple]) -> DataFrame:
    """Class boundaries as a table (at most ``MAX_CLASSES`` rows)."""
    return spark.createDataFrame([tuple(e) for e in edges], "class int, upper double, lower double")


def _interval(value: Column, cuts: list[float], guess: Column) -> Column:
    """Index ``i`` with ``cuts[i] <= value < cuts[i + 1]``, -1 below and the last index above.

    The guess comes from a closed form and may be off by one through rounding;
    the exact cuts settle it.  The expression stays small for any number of
    classes, which keeps the generated code below the size the JIT accepts.
    """
    exact = F.array(*[F.lit(c) for c in cuts])
    start = F.least(F.greatest(guess, F.lit(0)), F.lit(len(cuts) - 2)).cast("int")
    down = (value < F.get(exact, start)).cast("int")
    up = (value >= F.get(exact, start + 1)).cast("int")
    return start - down + up


def benchmark_class(distance: str | Column, nrt: float, n_classes: int, step: float) -> Column:
    """Class of a distance: 1 beyond the threshold, ``n`` nearest the edge, 0 below one pixel."""
    d = F.col(distance) if isinstance(distance, str) else distance
    cuts = sorted(lower for _, _, lower in benchmark_edges(nrt, n_classes, step))
    low, high = cuts[0], cuts[-1]
    guess = F.floor(F.ln(d / low) * ((len(cuts) - 1) / math.log(high / low)))
    return F.when(d >= low, F.lit(int(n_classes)) - _interval(d, cuts, guess)).when(d.isNotNull(), 0)


def rescale(df: DataFrame, value: str) -> Column:
    """``1 + value / max(value)``; the maximum runs over the whole layer."""
    clean = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    top = df.select(F.max(clean).alias("top")).scalar()
    return F.lit(1.0) + F.try_divide(clean, top)


def alternative_class(rescaled: str | Column, n_classes: int, mask: str = "mask", forest: str = "forest") -> Column:
    """Class of a rescaled potential inside mask and forest, 0 outside, NULL without forest data.

    The top interval is closed, so the layer maximum falls in the top class.
    """
    v = F.col(rescaled) if isinstance(rescaled, str) else rescaled
    edges = alternative_edges(n_classes)
    n = len(edges)
    cuts = [1.0] + [upper for _, upper, _ in edges[:-1]] + [float("inf")]
    found = _interval(v, cuts, F.floor(n - n * F.log2(F.lit(3.0) - v))) + 1
    inside = (F.col(mask) == 1) & (F.col(forest) == 1)
    return F.when(F.col(forest).isNotNull() & v.isNotNull(), F.when(inside, found).otherwise(0))


def region_id(risk_class: str = "risk_class", division: str = "division") -> Column:
    """``class * 1000 + division`` for positive classes, NULL otherwise.

    A division outside 0..999 would collide with another class and raises.
    """
    c, d = F.col(risk_class), F.col(division)
    fits = d.between(0, DIVISION_BASE - 1)
    return F.when(
        (c > 0) & d.isNotNull(),
        F.when(fits, c * DIVISION_BASE + d).otherwise(
            F.raise_error(F.concat(F.lit("division id outside 0..999: "), d.cast("string"))).cast("int")
        ),
    ).cast("int")


def zone_of(region: str = "region_id") -> Column:
    """Risk class encoded in a region id."""
    return F.floor(F.col(region) / DIVISION_BASE).cast("int")
