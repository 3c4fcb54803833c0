"""Operator 4, approximate nearest neighbours: shifted space-filling curves.

Vectors are projected on ``DIMS`` random orthonormal directions, shifted, and put in the order of
a Hilbert curve, once for each of ``CURVES`` curves with directions and a shift of
its own.  Every curve is cut into blocks of about ``BLOCK_ROWS`` consecutive keys;
Spark deals the rows by (curve, block), and a block that holds more, because
of equal vectors, is cut further by a hash of the id.

* Each query looks at its own block and the ``WINDOW`` blocks before and after it on
  every curve; what it finds is merged and reranked by exact distances.
* A curve's blocks have bounding boxes of their projections.  As the directions are
  orthonormal, the distance to a box never exceeds the distance to the vectors in it.  In
  a second round, a query looks at the blocks of the first curve whose box is nearer than its
  last neighbour so far.  So every true neighbour is found; where the curve keeps
  neighbours together few blocks are left, and where vectors are close to evenly spread (no curve
  can keep those together) it comes near a scan of all blocks by the query set.

A vector's place is computed anew where it is needed (it depends on the vector alone), so
only the vectors themselves are shuffled, once for each curve and once for the second round.

Distances are Euclidean, in double precision, on the original vectors; ties go to
the smaller id.

Edge cases: vectors that are null, empty, all zero, or hold null or non-finite
components take no part, nor do rows without an id or vectors of another length than
most (of equally common lengths, the longest counts); rows that repeat an id are candidates one
by one, but a query is asked once, with its smallest vector, and never finds rows of its own id;
other columns are ignored, so their names cannot clash; with fewer candidates than asked for, all
are returned; an empty table, or one without queries, gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopygrid.llm import common as c

CURVES = 4
DIMS = 6
BITS = 8
#: Rows of a block, about, and blocks of a curve, at most (larger blocks are cut by a hash of the id).
BLOCK_ROWS = 2048
MOST_BLOCKS = 16_384
WINDOW = 1
#: Queries that one task holds against a block at once.
QUERY_ROWS = 1024


def directions(length: int, curve: int, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal directions and a shift (in cells) for one curve."""
    random = np.random.default_rng(1_000_003 * curve + 17)
    basis = np.linalg.qr(random.normal(size=(length, min(dims, length))))[0]
    return basis, random.uniform(0.0, 1.0, size=basis.shape[1])


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Keys on the Hilbert curve of points with integer coordinates below ``2**bits`` (one row each)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    # From coordinates to the transposed key: undo the excess turns from the top bit, then Gray code.
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[dims - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def valid(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, vector`` of the rows that take part; vectors of 32-bit numbers stay so until they are computed with."""
    kind = rows.schema[vector_col].dataType
    narrow = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    vector = F.col(vector_col) if narrow else F.col(vector_col).cast("array<double>")
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector")).filter("vec_id IS NOT NULL AND vector IS NOT NULL")
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0.0)
    rows = rows.filter(F.coalesce(sound, F.lit(False)))
    common = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return rows.filter(F.size("vector") == (common["length"] if common else 0))


class Layout:
    """Where a vector stands on every curve: a function of the vector alone, whatever batch it comes in."""

    def __init__(self, length: int, curves: int) -> None:
        planes = [directions(length, k) for k in range(curves)]
        self.length, self.curves, self.dims = length, curves, planes[0][0].shape[1]
        self.basis = np.concatenate([basis for basis, _ in planes], axis=1)
        self.shift = np.concatenate([shift for _, shift in planes])
        self.low = self.size = np.zeros(0)
        self.cuts: list[np.ndarray] = []

    def projections(self, column: pa.Array) -> np.ndarray:
        """Projections of a batch on all directions, added up in the order of the components."""
        points = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, self.length).astype(np.float64)
        at = np.zeros((len(points), self.basis.shape[1]))
        for i, weights in enumerate(self.basis):
            at += points[:, i, None] * weights
        return at

    def places(self, column: pa.Array):
        """Curve, projections and keys of a batch, curve by curve."""
        at = self.projections(column)
        cells = np.clip((at - self.low) / self.size * ((1 << BITS) - 2) + self.shift, 0, (1 << BITS) - 1).astype(np.int64)
        for k in range(self.curves):
            mine = slice(k * self.dims, (k + 1) * self.dims)
            yield k, at[:, mine], hilbert(cells[:, mine])

    def blocks(self, column: pa.Array):
        """Curve, projections and blocks of a batch, curve by curve."""
        for k, at, keys in self.places(column):
            yield k, at, np.searchsorted(self.cuts[k], keys, side="right")


def _measure(rows: DataFrame, layout: Layout) -> None:
    """Set the range of the projections on every direction."""

    def run(batches):
        for batch in batches:
            if len(batch):
                at = layout.projections(batch.column("vector"))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at.shape[1], dtype=np.int32)), pa.array(at.min(axis=0)), pa.array(at.max(axis=0))], names=["place", "low", "high"])

    found = rows.select("vector").mapInArrow(run, "place int, low double, high double").groupBy("place").agg(F.min("low"), F.max("high")).orderBy("place").collect()
    layout.low = np.array([r[1] for r in found])
    layout.size = np.maximum(np.array([r[2] for r in found]) - layout.low, 1e-300)


def _cut(rows: DataFrame, layout: Layout, blocks: int) -> None:
    """Set the block edges of the curves: at most ``CURVES * MOST_BLOCKS`` numbers."""
    if blocks == 1:
        layout.cuts = [np.zeros(0, dtype=np.int64)] * layout.curves
        return

    def run(batches):
        for batch in batches:
            for k, _, keys in layout.places(batch.column("vector")) if len(batch) else ():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k, dtype=np.int32)), pa.array(keys)], names=["curve", "key"])

    share = [i / blocks for i in range(1, blocks)]
    found = rows.select("vector").mapInArrow(run, "curve int, key long").groupBy("curve").agg(F.percentile_approx("key", share, 100 * blocks).alias("cuts")).collect()
    edges = {r["curve"]: sorted(set(r["cuts"])) for r in found}
    layout.cuts = [np.array(edges[k], dtype=np.int64) for k in range(layout.curves)]


def _boxes(rows: DataFrame, layout: Layout) -> DataFrame:
    """``curve, block, n, low0, high0, ...`` of every block."""
    sides = [f"{side}{i}" for side in ("low", "high") for i in range(layout.dims)]

    def run(batches):
        for batch in batches:
            for k, at, block in layout.blocks(batch.column("vector")) if len(batch) else ():
                order = np.argsort(block, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(block[order]) != 0])
                low, high = (f.reduceat(at[order], first, axis=0) for f in (np.minimum, np.maximum))
                count = np.diff(np.r_[first, len(block)])
                numbers = [np.full(len(first), k, dtype=np.int32), block[order][first], count]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*numbers, *low.T, *high.T)], names=["curve", "block", "n", *sides])

    schema = "curve int, block long, n long, " + ", ".join(f"{x} double" for x in sides)
    part = rows.select("vector").mapInArrow(run, schema).groupBy("curve", "block")
    return part.agg(F.sum("n").alias("n"), *[(F.min if x.startswith("low") else F.max)(x).alias(x) for x in sides])


def _placed(rows: DataFrame, layout: Layout, curves: int) -> DataFrame:
    """``curve, block, vec_id, vector, at`` of each row on the first ``curves`` curves; ``at`` is its projection."""
    kind = rows.schema["vector"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for k, at, block in layout.blocks(batch.column("vector")) if len(batch) else ():
                if k == curves:
                    break
                edges = pa.array(np.arange(len(at) + 1, dtype=np.int32) * at.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), k, dtype=np.int32)), pa.array(block), batch.column("vec_id"), batch.column("vector"), pa.ListArray.from_arrays(edges, pa.array(at.ravel()))],
                    names=["curve", "block", "vec_id", "vector", "at"],
                )

    return rows.mapInArrow(run, f"curve int, block long, vec_id long, vector {kind}, at array<double>")


def _nearest(rows: DataFrame, asked: DataFrame, keys: list[str], length: int, k: int) -> DataFrame:
    """``query_id, vec_id, score``: for rows and queries that meet under ``keys``, each query's ``k`` nearest there."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(left) or not len(right):
            return empty
        points, ids = np.stack(left["vector"]).astype(np.float64), left["vec_id"].to_numpy()
        out = [[], [], []]
        for query, vector in zip(right["vec_id"].to_numpy(), right["vector"], strict=True):
            # A running sum adds the components in their order, whatever the block's size.
            with np.errstate(over="ignore"):
                score = np.sqrt(np.cumsum((points - vector) ** 2, axis=1)[:, -1])
            other = np.flatnonzero(ids != query)
            last = min(k, len(other)) - 1
            # All that tie with the last place (infinite scores too, where squares overflow), then the smallest ids.
            some = other[score[other] <= np.partition(score[other], last)[last]] if len(other) else other
            some = some[np.lexsort((ids[some], score[some]))][:k]
            for have, more in zip(out, (np.full(len(some), query), ids[some], score[some]), strict=True):
                have.append(more)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, out), strict=True)))

    return rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query, as one sorted array ``near`` of (score, vec_id)."""
    return found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("near"))


def search(rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", complete: bool = True) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest of every query; ``is_query`` is a condition on ``vec_id``.

    With ``complete`` false only the windows are looked at.
    """
    rows = c.stored(valid(rows, id_col, vector_col))
    first = rows.select("vector").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if first is None:
        return rows.sparkSession.createDataFrame([], schema)
    length = len(first["vector"])
    layout = Layout(length, CURVES)
    _measure(rows, layout)
    _cut(rows, layout, int(min(MOST_BLOCKS, max(1, rows.count() // BLOCK_ROWS))))
    sizes = c.stored(_boxes(rows, layout))
    # A block of one key that many vectors share is cut by ids.
    parts = sizes.select("curve", "block", F.ceil(F.col("n") / (2 * BLOCK_ROWS)).alias("parts"))
    side = F.broadcast(parts)  # at most CURVES * (MOST_BLOCKS + 1) rows

    def dealt(curves: int) -> DataFrame:
        return _placed(rows, layout, curves).join(side, ["curve", "block"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts"))

    queries = c.stored(_placed(rows.filter(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector")), layout, CURVES))
    near = queries.select("curve", F.explode(F.array(*[F.col("block") + i for i in range(-WINDOW, WINDOW + 1)])).alias("block"), "vec_id", "vector")
    chunk = F.pmod(F.xxhash64("vec_id"), F.lit(1 + queries.filter("curve = 0").count() // QUERY_ROWS))
    keys = ["curve", "block", "part", "chunk"]

    def meet(asked: DataFrame, some: DataFrame) -> DataFrame:
        asked = asked.withColumn("chunk", chunk).join(side, ["curve", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        wanted = c.stored(asked.select(*[F.col(x).alias(x) for x in keys]).distinct())
        wanted = F.broadcast(wanted) if c.fits_broadcast(wanted) else wanted
        held = some.select("curve", "block", "part", "vec_id", "vector").join(wanted, ["curve", "block", "part"])
        return _nearest(held, asked.select(*keys, "vec_id", "vector"), keys, length, k)

    found = c.stored(meet(near, dealt(CURVES)))
    # The same row may be found on several curves.
    best = _best(found.distinct(), k)
    if complete:
        best = c.stored(best)
        reach = F.when(F.size("near") == k, F.element_at("near", -1)["score"]).otherwise(float("inf"))
        home = queries.filter("curve = 0").join(best.select(F.col("query_id").alias("vec_id"), reach.alias("reach")), "vec_id", "left")
        gap = sum((F.greatest(F.lit(0.0), F.col(f"low{i}") - F.col("at")[i], F.col("at")[i] - F.col(f"high{i}")) ** 2 for i in range(layout.dims)), F.lit(0.0))
        boxes = sizes.filter("curve = 0").withColumnRenamed("block", "box").drop("curve", "n")
        # Rounding never makes a box seem too far. Blocks of the windows have been looked at.
        left = home.join(F.broadcast(boxes), (F.sqrt(gap) <= F.coalesce("reach", F.lit(float("inf"))) * (1 + 1e-9) + 1e-12) & (F.abs(F.col("box") - F.col("block")) > WINDOW))
        more = meet(left.select("curve", F.col("box").alias("block"), "vec_id", "vector"), dealt(1))
        best = _best(found.union(more).distinct(), k)
    ranked = best.select("query_id", F.posexplode("near").alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
