"""Operator 1, quality classifier: hashed word n-gram logistic regression trained by FTRL, scored as sparse dot products.

A text is cut into words (runs of letters, digits and non-ASCII characters) and
runs of signs.  Features are the hashed words and word pairs, and one to three
consecutive word shapes (kind, capitals, length, repetition of an earlier
word), each weighted by its share of the text's n-grams.  Nothing but the text
enters a score.

Training takes at most ``TRAIN_ROWS`` labelled documents, those with the
smallest hashes of their id, in ``SHARDS`` tasks; each runs the
follow-the-regularised-leader updates over its share, and the model is the mean
of their weights.  Scoring is one scan of the documents without a shuffle.

Edge cases: a null or empty text has no features, so its score is the one the
intercept gives; labelled rows without a label, an id or a document are not used; of
several labels of a document the smallest counts; without any training row the
model is empty and every score is 0.5; repeated rows are scored one by one; other
columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopygrid.llm import common as c

#: Labelled documents that training looks at, at most.
TRAIN_ROWS = 8192
SHARDS = 4
BITS = 18
EPOCHS = 4
#: FTRL-proximal: learning rate, its damping, and the penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5
#: The shares of a text's n-grams are multiplied by this.
SCALE = 20.0
THRESHOLD = 0.7

WORD = c.byte_set((48, 57), (65, 90), (97, 122), (128, 255))
SPACE = c.byte_set((0, 32), (127, 127))
CAPITAL = c.byte_set((65, 90))
DIGIT = c.byte_set((48, 57))
_MASK = np.uint64((1 << BITS) - 1)


def _ngrams(tokens: np.ndarray, rows: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the n-grams inside rows, and their rows."""
    if len(tokens) < width:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    inside = rows[: len(rows) - width + 1] == rows[width - 1 :]
    found = c.mix(c.rolling(tokens, width) + np.uint64(seed)) & _MASK
    return found[inside].astype(np.int64), rows[: len(inside)][inside]


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature number and row of every n-gram of a block of texts."""
    word = WORD[data]
    starts, ends = c.runs(word, offsets)
    sign_starts, sign_ends = c.runs(~word & ~SPACE[data], offsets)
    is_word = np.r_[np.ones(len(starts), dtype=bool), np.zeros(len(sign_starts), dtype=bool)]
    starts, ends = np.r_[starts, sign_starts], np.r_[ends, sign_ends]
    order = np.argsort(starts, kind="stable")
    starts, ends, is_word = starts[order], ends[order], is_word[order]
    rows = c.row_of(starts, offsets)
    tokens = c.Hasher(c.LOWER[data]).ranges(starts, ends)
    count = lambda flags: np.r_[0, np.cumsum(flags[data])]
    capitals, digits = count(CAPITAL), count(DIGIT)
    capitals, digits = capitals[ends] - capitals[starts], digits[ends] - digits[starts]
    length = ends - starts
    again = np.zeros(len(tokens), dtype=np.int64)
    for back in (1, 2):
        again[back:] |= (tokens[back:] == tokens[:-back]) & (rows[back:] == rows[:-back]) & is_word[back:]
    case = np.where(capitals == 0, 0, np.where(capitals == length, 2, np.where((capitals == 1) & CAPITAL[data[starts]], 1, 3)))
    shapes = (is_word * 2 + (digits > 0)) * 64 + case * 16 + np.minimum(length // 3, 7) * 2 + again
    shapes = c.mix(shapes.astype(np.uint64) + np.uint64(1 << 40))
    parts = [_ngrams(tokens, rows, 1, 1), _ngrams(tokens, rows, 2, 2), _ngrams(shapes, rows, 1, 3), _ngrams(shapes, rows, 2, 4), _ngrams(shapes, rows, 3, 5)]
    return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])


def _vectors(batches):
    """Sparse vectors of labelled texts: label, feature numbers, values."""
    for batch in batches:
        labels = batch.column("label")
        for first, end, data, offsets in c.text_blocks(batch.column("text")):
            found, rows = features(data, offsets)
            total = np.maximum(np.bincount(rows, minlength=end - first), 1)
            keys, counts = np.unique(rows * (1 << BITS) + found, return_counts=True)
            row = keys >> BITS
            edges = np.searchsorted(row, np.arange(end - first + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("shard").slice(first, end - first),
                    batch.column("doc_id").slice(first, end - first).cast(pa.string()),
                    labels.slice(first, end - first),
                    pa.ListArray.from_arrays(pa.array(edges), pa.array((keys & int(_MASK)).astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(edges), pa.array((counts * (SCALE / total[row])).astype(np.float32))),
                ],
                names=["shard", "doc_id", "label", "at", "value"],
            )


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last one is the intercept) after FTRL-proximal passes over ``(label, numbers, values)``."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    last = 1 << BITS

    def weights(at):
        out = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        out[np.abs(z[at]) <= L1] = 0.0
        return out

    for _ in range(epochs):
        for label, at, value in rows:
            at, value = np.append(at, last), np.append(value, 1.0)
            w = weights(at)
            error = 1.0 / (1.0 + np.exp(-np.clip(w @ value, -35, 35))) - label
            g = error * value
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return weights(np.arange(last + 1))


def _train(table: pa.Table) -> pa.Table:
    """Weights of one shard; its vectors stay where Arrow holds them."""
    at, value = (table.column(name).combine_chunks() for name in ("at", "value"))
    label, edges = table.column("label").to_pylist(), at.offsets.to_pylist()
    numbers, values = at.values.to_numpy(), value.values.to_numpy()
    order = np.argsort(c.mix(np.frombuffer(b"".join(x.encode()[:8].ljust(8) for x in table.column("doc_id").to_pylist()), dtype=np.uint64)), kind="stable")
    rows = [(label[i], numbers[edges[i] : edges[i + 1]], values[edges[i] : edges[i + 1]]) for i in order.tolist()]
    return pa.table({"rows": pa.array([len(rows)], pa.int64()), "weights": pa.array([ftrl(rows).astype(np.float32).tobytes()], pa.binary())})


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAIN_ROWS) -> np.ndarray:
    """Model from at most ``most`` of the labelled documents."""
    c.small_batches(docs.sparkSession)
    picked = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .filter("doc_id IS NOT NULL AND label IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # At most ``most`` rows of two numbers, so the broadcast is bounded.
    rows = texts.join(F.broadcast(picked), "doc_id").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).cast("int"))
    vectors = rows.mapInArrow(c.releasing(_vectors), "shard int, doc_id string, label int, at array<int>, value array<float>")
    models = vectors.groupBy("shard").applyInArrow(_train, "rows long, weights binary").collect()
    if not models:
        return np.zeros((1 << BITS) + 1, dtype=np.float32)
    return np.average([np.frombuffer(m["weights"], dtype=np.float32) for m in models], axis=0, weights=[m["rows"] for m in models]).astype(np.float32)


def dots(model: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Scores of a column of texts."""
    out = []
    for first, end, data, offsets in c.text_blocks(texts):
        found, rows = features(data, offsets)
        total = np.maximum(np.bincount(rows, minlength=end - first), 1)
        sums = np.bincount(rows, weights=model[found], minlength=end - first)
        out.append(1.0 / (1.0 + np.exp(-np.clip(float(model[-1]) + SCALE * sums / total, -35.0, 35.0))))
    return np.concatenate(out) if out else np.zeros(0)


def score(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row."""
    c.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dots(shared.value, batch.column(1)), pa.float64())], names=["doc_id", "score"])

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(c.releasing(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def accepted(docs: DataFrame, model: np.ndarray, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` whose score reaches the threshold."""
    c.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(dots(shared.value, batch.column(batch.schema.get_field_index(text_col))) >= threshold))

    return docs.mapInArrow(c.releasing(run), docs.schema)


def remainder(id_column: Column, modulus: int) -> Column:
    """crc32 of the id's text, modulo ``modulus``; null for no id."""
    return F.crc32(id_column.cast("string").cast("binary")) % modulus
