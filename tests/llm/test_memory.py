"""Working memory of the scans, which executors hold beside Spark's own."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from canopygrid.llm import common, decontaminate, linededup, quality, shingle_join

TEXTS = [" ".join(f"w{(i * 7919 + j * j) % 5003}" + ("\n" if j % 12 == 11 else "") for j in range(300)) for i in range(1500)]


def _shingles(column):
    for _ in shingle_join.shingle_sets(column, 5):
        pass


def _lines(column):
    for _, _, data, offsets in common.text_blocks(column):
        linededup.Lines(data, offsets)


def _scores(column):
    quality.dots(np.zeros((1 << quality.BITS) + 1, dtype=np.float32), column)


def _marks(column):
    index = decontaminate.Index({"w1 w2 w3": ["a"]})
    for _ in decontaminate._marked(index, pa.RecordBatch.from_arrays([column], names=["text"]), "text"):
        pass


@pytest.mark.parametrize("scan", [_shingles, _lines, _scores, _marks])
def test_a_round_holds_little(scan):
    column = pa.array(TEXTS, pa.string())
    assert column.nbytes > 2 << 20
    scan(column.slice(0, 10))
    tracemalloc.start()
    try:
        scan(column)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 20 << 20


def test_rounds_do_not_change_sets_or_lines():
    column = pa.array([*TEXTS[:400], "", None, "x " * 200_000], pa.string())
    together = list(shingle_join.shingle_sets(column, 5))
    alone = [s for i in range(len(column)) for s in shingle_join.shingle_sets(column.slice(i, 1), 5)]
    assert len(together) == len(column)
    assert all(np.array_equal(a, b) for a, b in zip(together, alone, strict=True))
    lines = lambda part: np.concatenate([linededup.Lines(data, offsets).line for _, _, data, offsets in common.text_blocks(part)])
    assert np.array_equal(lines(column), np.concatenate([lines(column.slice(i, 1)) for i in range(len(column)) if column[i].as_py()]))


def test_batches_read_from_parquet_are_small(spark):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    for key in keys:
        spark.conf.unset(key)
    common.small_batches(spark)
    assert all(int(spark.conf.get(key)) <= common.ARROW_ROWS for key in keys)


def test_releasing_passes_every_batch_on():
    batches = [pa.RecordBatch.from_arrays([pa.array([i])], names=["x"]) for i in range(3)]
    assert list(common.releasing(lambda given: (b for b in given))(iter(batches))) == batches
