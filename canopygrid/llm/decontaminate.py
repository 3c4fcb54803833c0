"""Operator 9, benchmark decontamination: a broadcast hash set of normalised test n-grams.

Words are maximal runs of digits, ASCII letters (lower-cased) and non-ASCII
characters.  A window is ``width`` consecutive words of an item; an item with
fewer words, but not none, is one window.  Executors hold the windows' hashes and
their words; each document's token windows are looked up through a bitmap, then
among the hashes, and every hit is verified word by word.

Edge cases: a null or empty text has no words, no hits and stays clean; an item
without words has no windows; items with equal windows all count; a null item id
still marks words but is no item of the list; repeated rows are judged one by one; other
columns are ignored, so their names cannot clash; empty tables give empty or
all-clean results.

The windows go to the executors in blocks of at most ``BLOCK_WINDOWS``; a larger
benchmark makes more scans of the documents within the same stage, one for each block.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopygrid.llm import common as c

WIDTH = 10
BLOCK_WINDOWS = 1 << 19
WORD = c.byte_set((48, 57), (65, 90), (97, 122), (128, 255))
_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_CAPITALS = {i: i + 32 for i in range(65, 91)}
#: Low bits of a hash that index the bitmap.
BITMAP_BITS = 20


def item_windows(text: str | None, width: int) -> list[str]:
    """The distinct windows of one item, words joined by blanks."""
    words = _WORDS.findall((text or "").translate(_CAPITALS))
    if not words:
        return []
    return list(dict.fromkeys(" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))))


def window_hash(window: str) -> tuple[int, int]:
    """Hash and number of words of a window, as the scan computes them."""
    data = np.frombuffer(window.encode(), dtype=np.uint8)
    starts, ends = c.runs(WORD[data], np.array([0, len(data)]))
    tokens = c.Hasher(data).ranges(starts, ends)
    return int(c.rolling(tokens, len(tokens))[0]), len(tokens)


def window_blocks(items: DataFrame, width: int, id_col: str, text_col: str, most: int = BLOCK_WINDOWS) -> Iterator[dict]:
    """Blocks of ``{window: item ids}``, fetched from Spark block by block."""
    block: dict[str, list] = {}
    for row in items.select(id_col, text_col).toLocalIterator():
        for window in item_windows(row[1], width):
            block.setdefault(window, []).append(None if row[0] is None else str(row[0]))
            if len(block) >= most:
                yield block
                block = {}
    if block:
        yield block


class Index:
    """The windows of one block, by length."""

    def __init__(self, windows: dict[str, list]) -> None:
        self.windows = windows
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        lengths: dict[int, list[int]] = {}
        for window in windows:
            value, length = window_hash(window)
            lengths.setdefault(length, []).append(value)
        for length, values in lengths.items():
            hashes = np.unique(np.array(values, dtype=np.uint64))
            bitmap = np.zeros(1 << BITMAP_BITS, dtype=bool)
            bitmap[hashes & np.uint64((1 << BITMAP_BITS) - 1)] = True
            self.by_length[length] = (hashes, bitmap)

    def hits(self, data: np.ndarray, tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, list]]:
        """First word, length and items of every verified occurrence in a block of lower-cased text."""
        for length, (hashes, bitmap) in self.by_length.items():
            found = c.rolling(tokens, length)
            at = np.flatnonzero(bitmap[found & np.uint64((1 << BITMAP_BITS) - 1)])
            at = at[rows[at] == rows[at + length - 1]]
            at = at[c.among(found[at], hashes)]
            for first in at.tolist():
                words = " ".join(data[starts[i] : ends[i]].tobytes().decode() for i in range(first, first + length))
                if words in self.windows:
                    yield first, length, self.windows[words]


class Marked:
    """Hit words of the rows ``first`` to ``end`` of a batch, as one more block of windows leaves them."""

    def __init__(self, index: Index, first: int, end: int, data: np.ndarray, offsets: np.ndarray, before: pa.Array | None, items: pa.Array | None) -> None:
        lowered = c.LOWER[data]
        self.first, self.data, self.offsets = first, data, offsets
        self.starts, self.ends = c.runs(WORD[lowered], offsets)
        rows = c.row_of(self.starts, offsets)
        tokens = c.Hasher(lowered).ranges(self.starts, self.ends)
        hit = np.zeros(len(tokens) + 1, dtype=np.int64)
        self.items: list[set] = [set(items[first + i].as_py() or ()) if items is not None else set() for i in range(end - first)]
        for at, length, ids in index.hits(lowered, tokens, self.starts, self.ends, rows):
            hit[at] += 1
            hit[at + length] -= 1
            self.items[rows[at]].update(x for x in ids if x is not None)
        self.edges = np.searchsorted(rows, np.arange(end - first + 1))
        self.marks = np.split(np.cumsum(hit[:-1]) > 0, self.edges[1:-1])
        for i, old in enumerate(before[first:end].to_pylist() if before is not None else ()):
            if old:
                self.marks[i] = self.marks[i] | np.unpackbits(np.frombuffer(old, dtype=np.uint8))[: len(self.marks[i])].astype(bool)

    def without_hits(self, i: int) -> str:
        """Text of row ``i`` without its runs of hit words."""
        gone = np.zeros(self.offsets[i + 1] - self.offsets[i], dtype=bool)
        opens, closes = c.runs(self.marks[i], np.array([0, len(self.marks[i])]))
        for a, b in zip(opens + self.edges[i], closes + self.edges[i], strict=True):
            gone[self.starts[a] - self.offsets[i] : self.ends[b - 1] - self.offsets[i]] = True
        return self.data[self.offsets[i] : self.offsets[i + 1]][~gone].tobytes().decode()


def _marked(index: Index, batch: pa.RecordBatch, text_col: str) -> Iterator[Marked]:
    column = lambda name: batch.column(batch.schema.get_field_index(name)) if name in batch.schema.names else None
    for first, end, data, offsets in c.text_blocks(column(text_col)):
        yield Marked(index, first, end, data, offsets, column("__marks"), column("__items"))


def _pack(marks: np.ndarray) -> bytes:
    return np.packbits(marks).tobytes() if marks.any() else b""


def _over_blocks(docs: DataFrame, items: DataFrame, text_col: str, last: Callable, schema: str, width: int, item_col: str, item_text_col: str, most: int) -> DataFrame:
    """Scan ``docs`` with every block of windows; ``last(index, batch)`` makes the result from the last block's marks.

    The scans before it add the columns ``__marks`` and ``__items`` to the rows.
    """
    spark = docs.sparkSession
    c.small_batches(spark)
    blocks = [spark.sparkContext.broadcast(b) for b in window_blocks(items, width, item_col, item_text_col, most)] or [spark.sparkContext.broadcast({})]
    names = docs.columns

    def earlier(block):
        def run(batches):
            index = Index(block.value)
            for batch in batches:
                marked = [(_pack(m), sorted(i)) for x in _marked(index, batch, text_col) for m, i in zip(x.marks, x.items, strict=True)]
                added = [pa.array([m for m, _ in marked], pa.binary()), pa.array([i for _, i in marked], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *added], names=[*names, "__marks", "__items"])

        return run

    def final(block):
        def run(batches):
            index = Index(block.value)
            for batch in batches:
                yield last(index, batch)

        return run

    wide = docs.withColumn("__marks", F.lit(None).cast("binary")).withColumn("__items", F.lit(None).cast("array<string>")).schema
    for block in blocks[:-1]:
        docs = docs.mapInArrow(c.releasing(earlier(block)), wide)
    return docs.mapInArrow(c.releasing(final(blocks[-1])), schema)


def report(docs: DataFrame, items: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most: int = BLOCK_WINDOWS) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items``."""

    def last(index, batch):
        words, hits, items = [], [], []
        for x in _marked(index, batch, "text"):
            words += [len(m) for m in x.marks]
            hits += [int(m.sum()) for m in x.marks]
            items += [sorted(i) for i in x.items]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(words, pa.int64()),
                pa.array(hits, pa.int64()),
                pa.array([len(i) for i in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items], pa.string()),
                pa.array([h > 0 for h in hits], pa.bool_()),
                pa.array(items, pa.list_(pa.string())),
            ],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"],
        )

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"
    return _over_blocks(docs, items, "text", last, schema, width, item_col, item_text_col, most)


def cleaned(docs: DataFrame, items: DataFrame, drop_share: float = 0.5, width: int = WIDTH, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most: int = BLOCK_WINDOWS) -> DataFrame:
    """Documents without the hit spans, under the same columns.

    A document of which more than ``drop_share`` of the words are hit goes as a
    whole; from the others each run of hit words goes, from the first byte of its
    first word to the last byte of its last.
    """
    names = docs.columns

    def last(index, batch):
        at = batch.schema.get_field_index(text_col)
        texts = batch.column(at).to_pylist()
        keep = np.ones(batch.num_rows, dtype=bool)
        for x in _marked(index, batch, text_col):
            for i, marks in enumerate(x.marks):
                if marks.any():
                    keep[x.first + i] = marks.mean() <= drop_share
                    texts[x.first + i] = x.without_hits(i) if keep[x.first + i] else None
        columns = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(names))]
        return pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return _over_blocks(docs, items, text_col, last, docs.schema, width, item_col, item_text_col, most)
