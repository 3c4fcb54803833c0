"""Shared helpers: table access, shared scratch tables, checked broadcasts and byte-level text kernels.

The kernels look at UTF-8 bytes of many texts at once.  Every text is hashed by
64-bit arithmetic that wraps around: with ``H`` the running sum of
``byte * P**position``, the hash of any byte range is ``(H[end] - H[start]) *
P**-start``, so words, prefixes and lines cost a few array operations each.
"""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopygrid.lineage import ensure_checkpoint_dir

#: Bytes of text that one round of array operations looks at (a longer text is one round); a round takes some 100 bytes for each.
BLOCK_BYTES = 1 << 18
#: Rows that an operator sends to every executor at most (16 bytes each); beyond it, it joins by a shuffle.
BROADCAST_ROWS = 1 << 20
#: Rows of an Arrow batch handed to Python, and of a batch read from Parquet, so that long texts fit in memory.
ARROW_ROWS = 512

P = np.uint64(0x9E3779B97F4A7C55)
P_INVERSE = np.uint64(pow(int(P), -1, 1 << 64))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches, and those that Parquet is read in, to few rows, since a row may hold a very long text."""
    for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        if int(spark.conf.get(key)) > ARROW_ROWS:
            spark.conf.set(key, str(ARROW_ROWS))


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow; its worker, which later tasks use again, gives unused memory back after a task."""

    def released(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return released


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once below the shared checkpoint folder and read back."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` (stored, of a few numbers a row) has few enough rows for a broadcast."""
    return df.count() <= rows


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is not in ``ids`` (one stored column); rows without an id stay."""
    ids = ids.select(F.col(ids.columns[0]).alias("__gone"))
    side = F.broadcast(ids) if fits_broadcast(ids) else ids
    return docs.join(side, docs[id_col] == F.col("__gone"), "left_anti")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of 256 flags, set for the inclusive ranges."""
    table = np.zeros(256, dtype=bool)
    for first, last in ranges:
        table[first : last + 1] = True
    return table


#: ASCII capitals to small letters, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of at most ``limit`` bytes (or one row).

    Yields first row, end row, the bytes, and the offsets of the rows in them
    (one more than rows).  Nulls count as empty texts.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    rows = len(column)
    if rows == 0:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + rows + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < rows:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), rows)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


class Hasher:
    """Hashes of byte ranges of one block."""

    def __init__(self, data: np.ndarray) -> None:
        need = len(data) + 1
        # Powers for a longer text live as long as its hasher, so that a worker's memory falls again.
        self.powers, self.inverses = self.kept_powers() if need <= BLOCK_BYTES + 1 else (self.powers_of(x, need) for x in (P, P_INVERSE))
        self.sums = np.zeros(need, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], out=self.sums[1:], dtype=np.uint64)

    @classmethod
    def kept_powers(cls) -> tuple[np.ndarray, np.ndarray]:
        """Powers for a block, made once in each process.

        They are kept beside the modules, not in this class, which travels with every
        function that is sent to the executors.
        """
        kept = sys.modules.setdefault("_canopygrid_kept", types.ModuleType("_canopygrid_kept"))
        if not hasattr(kept, "powers"):
            kept.powers = tuple(cls.powers_of(x, BLOCK_BYTES + 1) for x in (P, P_INVERSE))
        return kept.powers

    @staticmethod
    def powers_of(base: np.uint64, count: int) -> np.ndarray:
        return np.cumprod(np.r_[np.uint64(1), np.full(count - 1, base, dtype=np.uint64)], dtype=np.uint64)

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One well-spread hash for each range ``[start, end)``."""
        return mix((self.sums[ends] - self.sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))


def runs(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of set bytes that stay inside one row."""
    if len(flags) == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    cuts = offsets[(offsets > 0) & (offsets < len(flags))]
    opens = flags.copy()
    opens[1:] &= ~flags[:-1]
    opens[cuts] = flags[cuts]
    closes = flags.copy()
    closes[:-1] &= ~flags[1:]
    closes[cuts - 1] = flags[cuts - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def row_of(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row in which each byte position lies."""
    return np.searchsorted(offsets, positions, side="right") - 1


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Flags of the values that occur in a sorted array."""
    if len(ordered) == 0:
        return np.zeros(len(values), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def rolling(tokens: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` consecutive tokens (across rows too; callers mask those)."""
    count = max(0, len(tokens) - width + 1)
    out = np.zeros(count, dtype=np.uint64)
    factor = 1
    for i in range(width):
        out += tokens[i : i + count] * np.uint64(factor)
        factor = factor * int(P) % (1 << 64)
    return mix(out + np.uint64(width))
