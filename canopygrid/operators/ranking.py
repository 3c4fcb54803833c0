"""Exact top-N per group without sorting the groups.

For every group the key ``(score desc, row, col)`` of its N-th pixel is found digit by
digit: scores become whole numbers in the same order
(:mod:`canopygrid.functions.ordered`), and each scan counts, for all groups at once, the pixels
of the digits that still matter.  A group ends when the rest of a digit is wanted
whole; keys have eight digits of 16 bits (four of the score, two of the row, two of the
column), so eight scans settle any scores, infinite and tied ones included, and
digits in which no open group differs are skipped.  Only counts travel.  Selection is
then a plain comparison with the group's cut key, so a group holding a third of
all pixels costs no more than many small ones.

Tables with one row for each group meet the pixels in plain joins: they are stored first, so
that Spark knows their size and broadcasts them only where that is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from canopygrid.functions.ordered import DIGIT_BITS, ordered_bits
from canopygrid.lineage import materialise

#: Parts of a key, and their bits.
KEYS = {"k0": 64, "k1": 32, "k2": 32}
_FIRST, _LAST = -(1 << 63), (1 << 63) - 1


def rank_keys(score: str) -> list[Column]:
    """Ascending sort keys of a pixel: score descending, then row, then column."""
    return [ordered_bits(-F.col(score).cast("double")).alias("k0"), F.col("row").cast("long").alias("k1"), F.col("col").cast("long").alias("k2")]


def _digits(bits: int) -> list[tuple[str, int]]:
    """Every digit as part and shift."""
    return [(part, shift) for part, size in KEYS.items() for shift in range((size - 1) // bits * bits, -1, -bits)]


def cut_keys(pixels: DataFrame, groups: list[str], score: str, targets: DataFrame, target: str, digit_bits: int = DIGIT_BITS) -> DataFrame:
    """Per group: ``available`` pixels and the key (``cut0..cut2``) of the last chosen one.

    ``targets`` holds one row per group with the number of pixels to choose.
    A group with enough room takes everything; a target of 0 takes nothing.
    Pixels without a score are never chosen.
    """
    keyed = pixels.select(*groups, *rank_keys(score)).filter("k0 IS NOT NULL")
    key = F.struct(*KEYS)
    wanted = targets.select(*groups, F.col(target).cast("long").alias("need"))
    digits = _digits(digit_bits)
    # The first scan counts the first digit, and with it the groups.
    counted = materialise(_counts(keyed, groups, digits[0]))
    sizes = counted.groupBy(*groups).agg(F.sum("n").alias("n"))
    state = wanted.join(sizes, groups, "left").withColumn("available", F.coalesce("n", F.lit(0).cast("long"))).drop("n")
    simple = (F.col("need") >= F.col("available")) | (F.col("need") <= 0)
    every = F.when(F.col("need") > 0, F.lit(_LAST)).otherwise(F.lit(_FIRST))
    done = state.filter(simple).select(*groups, "available", *[every.alias(f"cut{i}") for i in range(len(KEYS))])
    open_ = state.filter(~simple)
    at = 0
    while True:
        running = Window.partitionBy(*groups).orderBy("digits").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        here = (
            counted.withColumn("upto", F.sum("n").over(running))
            .join(open_.select(*groups, "need", "available"), groups)
            .filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
            .withColumn("need", F.col("need") - (F.col("upto") - F.col("n")))
        )
        # All of a digit's pixels are wanted, or they share one key.
        closed = (F.col("n") == F.col("need")) | (F.col("low") == F.col("high"))
        differ = [F.when(~closed, F.shiftright(f"low.{part}", shift) != F.shiftright(f"high.{part}", shift)) for part, shift in digits]
        seen = Observation()
        here = here.select(*groups, "need", "available", "n", "low", "high").observe(seen, *[F.max(d).alias(f"d{i}") for i, d in enumerate(differ)])
        here = materialise(here)
        done = done.unionByName(here.filter(closed).select(*groups, "available", *[F.col(f"high.{k}").alias(f"cut{i}") for i, k in enumerate(KEYS)]))
        open_ = here.filter(~closed)
        # The next digit in which the ends of some open group differ.
        at = next((i for i in range(at + 1, len(digits)) if seen.get.get(f"d{i}")), None)
        if at is None:
            break
        inside = keyed.join(open_.select(*groups, "low", "high"), groups).filter(key.between(F.col("low"), F.col("high")))
        counted = _counts(inside, groups, digits[at])
    return materialise(done)


def _counts(keyed: DataFrame, groups: list[str], digit: tuple[str, int]) -> DataFrame:
    """Pixels by the leading digits of one part of their key, with the ends of each."""
    part, shift = digit
    key = F.struct(*KEYS)
    return keyed.groupBy(*groups, F.shiftright(part, shift).alias("digits")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))


def at_or_before(score: str, prefix: str = "cut") -> Column:
    """True for pixels whose key does not come after the cut key."""
    mine = F.struct(*[k.alias(f"c{i}") for i, k in enumerate(rank_keys(score))])
    theirs = F.struct(*[F.col(f"{prefix}{i}").alias(f"c{i}") for i in range(len(KEYS))])
    return F.coalesce(mine <= theirs, F.lit(False))


def top_n(pixels: DataFrame, groups: list[str], score: str, targets: DataFrame, target: str, digit_bits: int = DIGIT_BITS) -> DataFrame:
    """The chosen pixels: top ``target`` per group by score, ties by row then column."""
    cuts = cut_keys(pixels, groups, score, targets, target, digit_bits)
    return pixels.join(cuts, groups).filter(F.col(score).isNotNull() & at_or_before(score)).select(pixels.columns)
