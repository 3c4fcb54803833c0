"""Exact order statistics of data too long for one task.

Medians go by digits: doubles become whole numbers in the same order
(:mod:`canopygrid.functions.ordered`), and each scan counts the values by their next 16
bits, for all columns at once, so four scans settle any distribution.

The Theil-Sen slope never forms pairs of points.  The pairs with a slope below
``b`` are those that change their order when points are ordered by
``y - b * x`` instead of ``x``, so their number is a count of inversions.  Every round counts
inversions for many slopes at once and narrows the interval that holds the
middle one, until few pairs are left in it, or a single double.  These pairs are
found by a join: their points nearly tie when ordered by the interval's middle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopygrid.functions.ordered import DIGIT_BITS, DIGITS, from_ordered, midpoint, ordered_bits, to_ordered
from canopygrid.lineage import materialise

#: Points that one task sorts.
CHUNK = 1 << 16
#: Points that propose slopes and cut residuals into ranges; results do not depend on them.
SAMPLE = 2048
#: Slopes a round tries, at least and at most; between them, about ``ROUND_WORK`` residuals a chunk.
FEW_SLOPES, MANY_SLOPES = 16, 64
ROUND_WORK = 1 << 22
#: Pairs of an interval that are looked at one by one, and pairs of points that a join for them may meet.
LAST_PAIRS, LAST_MET = 1 << 16, 1 << 21
#: Residuals that are sorted together.
STRIP = 1 << 15
#: Slopes beyond this (for points scaled into the unit square) count as infinite, so that no product overflows.
STEEPEST = 2.0**900
SPLIT = float((1 << 27) + 1)


def exact_medians(df: DataFrame, columns: dict[str, Column]) -> dict[str, float | None]:
    """Medians of several columns together, interpolated for an even count; NULL ignored."""
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), ordered_bits(v).alias("key")) for n, v in columns.items()]))
    keys = df.select(named.alias("s")).select("s.name", "s.key").filter("key IS NOT NULL")
    found: dict[str, list[float]] = {}
    # Per column: the prefixes that hold a wanted rank, with the ranks inside them.
    open_: dict[tuple[str, int | None], list[int]] = {(name, None): [] for name in columns}
    for digit in range(DIGITS):
        shift = 64 - DIGIT_BITS * (digit + 1)
        prefix = F.shiftright("key", shift + DIGIT_BITS) if digit else F.lit(0).cast("long")
        wanted = F.lit(False)
        for name, held in open_:
            wanted = wanted | ((F.col("name") == name) & (prefix == (held or 0)))
        counted = keys.filter(wanted).groupBy("name", prefix.alias("prefix"), F.shiftright("key", shift).alias("digits"))
        rows = counted.agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        narrowed: dict[tuple[str, int | None], list[int]] = {}
        for (name, held), ranks in open_.items():
            mine = sorted((r for r in rows if r["name"] == name and r["prefix"] == (held or 0)), key=lambda r: r["digits"])
            if held is None:
                n = sum(r["n"] for r in mine)
                ranks = sorted({(n - 1) // 2, n // 2}) if n else []
            before = 0
            for row in mine:
                inside = [rank - before for rank in ranks if before <= rank < before + row["n"]]
                if inside and row["low"] == row["high"]:
                    found.setdefault(name, []).extend([from_ordered(row["low"])] * len(inside))
                elif inside:
                    narrowed[name, row["digits"]] = inside
                before += row["n"]
        open_ = narrowed
        if not open_:
            break
    return {name: midpoint(min(found[name]), max(found[name])) if name in found else None for name in columns}


def exact_median(df: DataFrame, value: str) -> float | None:
    """Median of a column, interpolated for an even count; NULL ignored."""
    return exact_medians(df, {"v": F.col(value)})["v"]


def residuals(x: np.ndarray, y: np.ndarray, slopes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``y - slope * x`` of every slope (rows) and point, as sums of two doubles, the second a rounding error of the first.

    Products are exact and sums keep their error, so that nearly equal slopes
    still tell points apart.
    """

    def halves(a):
        high = a * SPLIT
        high = high - (high - a)
        return high, a - high

    slope = slopes[:, None]
    product = slope * x
    (s0, s1), (x0, x1) = halves(slope), halves(x)
    tail = ((s0 * x0 - product) + s0 * x1 + s1 * x0) + s1 * x1
    total = y - product
    part = total - y
    error = ((y - (total - part)) - (product + part)) - tail
    high = total + error
    return high, error - (high - total)


def inversions(lanes: np.ndarray, high: np.ndarray, low: np.ndarray, weights: np.ndarray, n_lanes: int) -> np.ndarray:
    """Weighted pairs of each lane whose earlier element is greater; lanes stand one after another.

    Elements are ranked, then dealt by the bits of their ranks, highest first: a
    pair is found at the bit in which it differs first.
    """
    out = np.zeros(n_lanes, dtype=np.int64)
    if not len(lanes):
        return out
    order = np.lexsort((low, high, lanes))
    a, b, lane = high[order], low[order], lanes[order]
    step = np.r_[False, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (lane[1:] != lane[:-1])]
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.cumsum(step)
    # Ranks count from 0 in each lane.
    firsts = np.flatnonzero(np.r_[True, lanes[1:] != lanes[:-1]])
    rank -= np.repeat(np.minimum.reduceat(rank, firsts), np.diff(np.r_[firsts, len(rank)]))
    weights, starts = weights.astype(np.int64), firsts
    for bit in reversed(range(int(rank.max()).bit_length())):
        sizes = np.diff(np.r_[starts, len(rank)])
        one = (rank >> bit) & 1
        # Ones, and their weight, before each element of its group.
        ones = np.cumsum(one) - one
        heavy = np.cumsum(weights * one) - weights * one
        before = heavy - np.repeat(heavy[starts], sizes)
        out[lanes[firsts]] += np.add.reduceat(np.where(one == 0, weights * before, 0), firsts)
        # Zeros first, then ones, both in their order.
        ones_inside = ones - np.repeat(ones[starts], sizes)
        zeros = np.add.reduceat(1 - one, starts)
        place = np.where(one == 0, np.arange(len(rank)) - ones_inside, np.repeat(starts + zeros, sizes) + ones_inside)
        moved = np.empty_like(rank)
        moved[place] = rank
        rank = moved
        moved = np.empty_like(weights)
        moved[place] = weights
        weights = moved
        starts = np.unique(np.r_[starts, starts + zeros])
        starts = starts[starts < len(rank)]
    return out


def _looked_at(table: pa.Table, slopes: np.ndarray, cuts: np.ndarray, several: bool) -> Iterator[dict[str, np.ndarray]]:
    """Rows for the second step: own inversions of a chunk, its points in coarse ranges, and its points."""
    x, y, w, chunk = (table.column(c).to_numpy() for c in ("x", "y", "w", "chunk"))
    order = np.lexsort((y, x))
    x, y, w = x[order], y[order], w[order].astype(np.int64)
    strip = max(1, STRIP // len(x))
    for first in range(0, len(slopes), strip):
        some = slopes[first : first + strip]
        high, low = (a.ravel() for a in residuals(x, y, some))
        lanes = np.repeat(np.arange(len(some)), len(x))
        own = inversions(lanes, high, low, np.tile(w, len(some)), len(some))
        zero = np.zeros(len(some))
        yield {"lane": np.arange(len(some)) + first, "part": np.full(len(some), -2), "high": zero, "low": zero, "w": own}
        if not several:
            continue
        part = np.concatenate([np.searchsorted(cuts[first + i], high[i * len(x) : (i + 1) * len(x)]) for i in range(len(some))])
        order = np.lexsort((low, high, lanes))
        lane, part, high, low, weight = lanes[order], part[order], high[order], low[order], np.tile(w, len(some))[order]
        for coarse in (True, False):
            a = part.astype(np.float64) if coarse else high
            b = np.zeros(len(part)) if coarse else low
            heads = np.flatnonzero(np.r_[True, (lane[1:] != lane[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            where = np.full(len(heads), -1) if coarse else part[heads]
            yield {"lane": lane[heads] + first, "part": where, "high": a[heads], "low": b[heads], "w": np.add.reduceat(weight, heads)}


class _Points:
    """Distinct points with their numbers, in chunks of ascending ``(x, y)``."""

    def __init__(self, points: DataFrame, x: str, y: str, chunk: int) -> None:
        xy = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        xy = xy.filter((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
        merged = xy.select((F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y")).groupBy("x", "y").agg(F.count("*").alias("w"))
        upright = merged.groupBy("x").agg(F.count("*").alias("n"), F.max(F.abs("y")).alias("y"), F.sum("w").cast("decimal(19,0)").alias("w"))
        n, wide, tall, total, same = upright.agg(F.sum("n"), F.max(F.abs("x")), F.max("y"), F.sum("w"), F.sum(F.col("w") * F.col("w"))).first()
        n = n or 0
        self.pairs = (int(total) ** 2 - int(same)) // 2 if n else 0
        # Powers of two, so that scaling is exact.
        self.x_scale, self.y_scale = (2.0 ** max(-1000, min(1000, -math.frexp(v)[1])) if v else 1.0 for v in (wide, tall))
        scaled = merged.select((F.col("x") * self.x_scale).alias("x"), (F.col("y") * self.y_scale).alias("y"), "w")
        self.chunks = max(1, -(-n // chunk))
        # Stored once, so a chunk's number stays when a lost task is redone.
        dealt = scaled.repartitionByRange(self.chunks, "x", "y") if self.chunks > 1 else scaled.coalesce(1)
        self.table = materialise(dealt.withColumn("chunk", F.spark_partition_id()))
        picked = self.table.orderBy(F.xxhash64("x", "y"), "x", "y").limit(SAMPLE).select("x", "y").collect()
        self.sample = np.array(picked, dtype=np.float64).reshape(-1, 2)
        self.lanes = int(np.clip(ROUND_WORK // max(1, min(n, chunk)), FEW_SLOPES, MANY_SLOPES))

    def sample_slopes(self) -> np.ndarray:
        """Ascending slopes between the sample's points."""
        x, y = self.sample[np.argsort(self.sample[:, 0], kind="stable")].T
        i, j = np.triu_indices(len(x), 1)
        use = x[j] > x[i]
        with np.errstate(over="ignore"):
            return np.sort((y[j] - y[i])[use] / (x[j] - x[i])[use])

    def below(self, slopes: list[float]) -> list[int]:
        """For each slope, the pairs of points with a smaller one."""
        tried = np.array(slopes)
        high, _ = residuals(self.sample[:, 0], self.sample[:, 1], tried)
        cuts = np.quantile(high, np.arange(1, self.chunks) / self.chunks, axis=1, method="nearest").T if self.chunks > 1 else np.zeros((len(slopes), 0))
        several = self.chunks > 1

        def look(table: pa.Table) -> pa.Table:
            parts = list(_looked_at(table, tried, cuts, several))
            rows = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
            rows["chunk"] = np.full(len(rows["w"]), table.column("chunk")[0].as_py())
            return pa.table({"lane": rows["lane"].astype(np.int32), "part": rows["part"].astype(np.int32), "chunk": rows["chunk"].astype(np.int32), "high": rows["high"], "low": rows["low"], "w": rows["w"]})

        def between(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            lane, part = (k.as_py() for k in key)
            chunk, high, low, w = (table.column(c).to_numpy() for c in ("chunk", "high", "low", "w"))
            # Points of one chunk stand in ascending order, so only pairs of different chunks count.
            order = np.lexsort((low, high, chunk))
            n = w.sum() if part == -2 else inversions(np.zeros(len(w), dtype=np.int64), high[order], low[order], w[order], 1)[0]
            return pa.table({"lane": pa.array([lane], pa.int32()), "n": pa.array([int(n)], pa.int64())})

        looked = self.table.groupBy("chunk").applyInArrow(look, "lane int, part int, chunk int, high double, low double, w long")
        counted = looked.groupBy("lane", "part").applyInArrow(between, "lane int, n long")
        found = {r["lane"]: r["n"] for r in counted.groupBy("lane").agg(F.sum("n").alias("n")).collect()}
        return [int(found.get(i, 0)) for i in range(len(slopes))]


    def between_slopes(self, low: float, high: float, pairs: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Ascending slopes from ``low`` to below ``high`` with their numbers; nothing where too many points tie to look at all.

        Points of the unit square whose slope lies there differ by at most twice
        the interval when ordered by its middle, so they share one of two ranges.
        """
        middle = low / 2 + high / 2
        width = 4 * (high - low) + 2.0**-46 * (1 + abs(middle))
        ranged = self.table.withColumn("range", F.floor((F.col("y") - middle * F.col("x")) / width))
        sizes = ranged.groupBy("range").agg(F.count("*").cast("double").alias("n"))
        if not math.isfinite(width) or (sizes.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0) > LAST_MET:
            return None
        left = ranged.select(F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("w").alias("w0"), F.explode(F.array(F.col("range") - 1, "range", F.col("range") + 1)).alias("range"))
        met = left.join(ranged, "range").filter("x0 < x").select(((F.col("y") - F.col("y0")) / (F.col("x") - F.col("x0"))).alias("slope"), (F.col("w0") * F.col("w")).alias("n"))
        found = met.filter((F.col("slope") >= low) & (F.col("slope") < high)).groupBy("slope").agg(F.sum("n").alias("n")).orderBy("slope").limit(pairs + 1).toArrow()
        slopes, numbers = (found.column(c).to_numpy() for c in ("slope", "n"))
        # A slope that rounds across an end would shift the ranks.
        return (slopes, np.cumsum(numbers)) if numbers.sum() == pairs else None


def _proposed(low: int, high: int, share: float, sample: np.ndarray, most: int) -> set[int]:
    """Keys strictly between two keys: evenly spread ones, and sample slopes around the wanted share."""
    half = max(1, most // 2)
    keys = {low + (high - low) * i // (half + 1) for i in range(1, half + 1)}
    inside = sample[(sample > from_ordered(low)) & (sample < from_ordered(high))]
    if len(inside):
        # Near the wanted share and, ever more sparsely, to both ends.
        reach = max(1, half // 4)
        steps = [0, *(s * int(len(inside) ** (i / reach)) for i in range(reach) for s in (1, -1))]
        for value in inside[np.clip(round(share * (len(inside) - 1)) + np.array(steps), 0, len(inside) - 1)].tolist():
            keys |= {to_ordered(value), to_ordered(value) + 1}
    steepest = to_ordered(STEEPEST)
    return {k for k in keys if low < k < high and -steepest <= k <= steepest}


def theil_sen_slope(points: DataFrame, x: str, y: str, chunk: int = CHUNK) -> float | None:
    """Median slope over all pairs of points with different ``x``, to one unit in the last place; points that are no finite numbers are left out."""
    data = _Points(points, x, y, chunk)
    if not data.pairs:
        return None
    ranks = sorted({(data.pairs - 1) // 2, data.pairs // 2})
    sample = data.sample_slopes()
    # Known counts by key; a slope of a rank lies from the last key with no more pairs below it, to the next key.
    known = {to_ordered(-math.inf): 0, to_ordered(math.inf): data.pairs}
    settled: dict[int, float] = {}
    while True:
        ends = sorted(known)
        spans = {}
        for rank in ranks:
            at = max(i for i, k in enumerate(ends) if known[k] <= rank and i + 1 < len(ends))
            spans[rank] = ends[at], ends[at + 1]
        for low, high in set(spans.values()):
            if 1 < high - low and known[high] - known[low] <= LAST_PAIRS and abs(low) < to_ordered(STEEPEST) > abs(high):
                last = data.between_slopes(from_ordered(low), from_ordered(high), known[high] - known[low])
                if last is not None:
                    settled |= {r: float(last[0][np.searchsorted(last[1], r - known[low], side="right")]) for r in ranks if spans[r] == (low, high)}
        asked: set[int] = set()
        for rank, (low, high) in spans.items():
            if rank in settled:
                continue
            share = (rank - known[low]) / max(1, known[high] - known[low])
            asked |= _proposed(low, high, share, sample, data.lanes // len(set(spans.values())))
        if not asked:
            break
        keys = sorted(asked)
        known |= dict(zip(keys, data.below([from_ordered(k) for k in keys]), strict=True))
    found = [settled[rank] if rank in settled else from_ordered(low) for rank, (low, _) in spans.items()]
    return midpoint(min(found), max(found)) * (data.x_scale / data.y_scale)
