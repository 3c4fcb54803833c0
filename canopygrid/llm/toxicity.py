"""Operator 2, toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Labelled documents are dealt by a hash of their id into three folds.

* The *lexicon* fold yields a learned lexicon: words, and word beginnings of 4
  to 6 bytes (for inflected or compounded forms), that occur in at least
  ``MIN_DOCS`` toxic documents and are ``MIN_ODDS`` times likelier there.  A
  stated list of common insults is always part of it.
* The *tree* fold trains Spark's gradient-boosted trees on the dense features:
  densities of lexicon words, their nearness to second-person words, rates of
  capitals, signs and obfuscated words (digits or signs among letters, words
  that meet the lexicon only once look-alike signs are read as letters, spelled-out
  letters, drawn-out letters).
* The *calibration* fold fits the isotonic map from tree scores to probabilities.

At most ``TRAIN_ROWS`` labelled documents are used, those with the smallest
hashes of their id; scoring is one scan of the documents without a shuffle.

Edge cases: a null or empty text has all-zero features and gets the score of
such a text; labelled rows without a label, an id or a document are not used; of
several labels of a document the largest counts; with labels of one kind only
(or none) every score is that label (0); repeated rows are scored one by one; other
columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopygrid.llm import common as c

#: Labelled documents that training looks at, at most.
TRAIN_ROWS = 24576
#: Entries of the learned lexicon, at most: those with the highest odds.
LEXICON_ROWS = 8192
MIN_DOCS = 3
MIN_ODDS = 12.0
THRESHOLD = 0.7
#: Words within so many of a second-person word count as near.
REACH = 5
PREFIXES = (4, 5, 6)
#: Common insults, and second-person words of English, German, French and Spanish.
INSULTS = "idiot moron stupid dumb loser scum trash garbage worthless pathetic disgusting clown fool imbecile jerk bastard bitch asshole shit fuck fucking retard whore slut pig vermin freak creep".split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deiner ihr euch euer sie tu te toi ton ta tes vous votre vos usted ustedes ti tuyo tuya vosotros vuestro".split()

LETTER = c.byte_set((65, 90), (97, 122), (128, 255))
DIGIT = c.byte_set((48, 57))
CAPITAL = c.byte_set((65, 90))
SPACE = c.byte_set((0, 32), (127, 127))
SIGN = ~(LETTER | DIGIT | SPACE)
#: Signs that stand for letters in obfuscated words.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_PLAIN = c.LOWER.copy()
for _sign, _letter in LOOKALIKES.items():
    _PLAIN[ord(_sign)] = ord(_letter)
_DISGUISED = LETTER | DIGIT | c.byte_set((33, 33), (36, 36), (42, 42), (64, 64))

FEATURES = [
    "lexicon_density", "lexicon_count", "lexicon_distinct", "odds_sum", "odds_top", "insult_density", "near_second_person", "second_person",
    "capitals", "capital_words", "signs", "exclamations", "questions", "mixed_words", "disguised_hits", "spelled_out", "drawn_out", "stars",
]


def word_hash(word: str) -> int:
    """Hash of a lower-case word, as the scan computes it."""
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(c.Hasher(data).ranges(np.array([0]), np.array([len(data)]))[0])


def _stems(hasher: c.Hasher, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of each word and its beginnings: one row for each kind; a beginning no shorter than its word is 0."""
    out = [hasher.ranges(starts, ends)]
    for length in PREFIXES:
        longer = ends - starts > length
        stem = np.zeros(len(starts), dtype=np.uint64)
        stem[longer] = hasher.ranges(starts[longer], starts[longer] + length) + np.uint64(length)
        out.append(stem)
    return np.array(out)


class Lexicon:
    """Hashes of words and beginnings, with the logarithm of their odds."""

    def __init__(self, entries: dict[int, float]) -> None:
        insults = {word_hash(w): float(np.log(MIN_ODDS)) for w in INSULTS}
        merged = {**entries, **{k: max(v, entries.get(k, 0.0)) for k, v in insults.items()}}
        self.hashes = np.array(sorted(merged), dtype=np.uint64)
        self.odds = np.array([merged[int(h)] for h in self.hashes])
        self.insults = np.array(sorted(insults), dtype=np.uint64)
        self.second = np.array(sorted(word_hash(w) for w in SECOND_PERSON), dtype=np.uint64)

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Log odds of each hash, 0 for those not listed."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.odds[at], 0.0)


def dense(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """The features of a block of texts, one row for each text."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    starts, ends = c.runs(LETTER[data] | DIGIT[data], offsets)
    rows = c.row_of(starts, offsets)
    per_row = lambda values, at=rows: np.bincount(at, weights=values, minlength=n)
    words = np.maximum(np.bincount(rows, minlength=n), 1)
    size = np.maximum(np.diff(offsets), 1)
    count = lambda flags: np.r_[0, np.cumsum(flags)]
    hasher = c.Hasher(c.LOWER[data])
    stems = _stems(hasher, starts, ends)
    odds = np.array([lexicon.look_up(x) for x in stems])
    best = odds.max(axis=0) if odds.size else np.zeros(0)
    hit = best > 0
    out[:, 0], out[:, 1] = per_row(hit) / words, np.log1p(per_row(hit))
    if hit.any():
        kinds = np.unique(np.c_[rows[hit], stems[odds[:, hit].argmax(axis=0), np.flatnonzero(hit)].astype(np.int64)], axis=0)
        out[:, 2] = np.bincount(kinds[:, 0], minlength=n)
        np.maximum.at(out[:, 4], rows[hit], best[hit])
    out[:, 3] = per_row(best) / words
    out[:, 5] = per_row(np.isin(stems[0], lexicon.insults)) / words
    second = np.isin(stems[0], lexicon.second)
    reach = count(second)
    ahead, behind = np.minimum(np.arange(len(rows)) + REACH + 1, len(rows)), np.maximum(np.arange(len(rows)) - REACH, 0)
    edges = np.searchsorted(rows, np.arange(n + 1))
    ahead, behind = np.minimum(ahead, edges[1:][rows]), np.maximum(behind, edges[:-1][rows])
    out[:, 6], out[:, 7] = per_row(hit & (reach[ahead] > reach[behind])) / words, per_row(second) / words
    capital, letter, digit = CAPITAL[data], LETTER[data], DIGIT[data]
    span = lambda flags: (lambda total: total[ends] - total[starts])(count(flags))
    whole = lambda flags: (lambda total: total[offsets[1:]] - total[offsets[:-1]])(count(flags))
    length, letters = ends - starts, span(letter)
    out[:, 8] = whole(capital) / np.maximum(whole(letter), 1)
    out[:, 9] = per_row((span(capital) == length) & (length > 1)) / words
    out[:, 10], out[:, 11], out[:, 12], out[:, 17] = (whole(x) / size for x in (SIGN[data], data == 33, data == 63, data == 42))
    out[:, 13] = per_row((letters > 0) & (span(digit) > 0)) / words
    d_starts, d_ends = c.runs(_DISGUISED[data], offsets)
    d_rows = c.row_of(d_starts, offsets)
    plain = lexicon.look_up(c.Hasher(_PLAIN[data]).ranges(d_starts, d_ends)) > 0
    raw = lexicon.look_up(hasher.ranges(d_starts, d_ends)) > 0
    out[:, 14] = per_row(plain & ~raw, d_rows) / words
    lone = length == 1
    lone_run = np.zeros(len(lone), dtype=bool)
    lone_run[2:] = lone[2:] & lone[1:-1] & lone[:-2] & (rows[2:] == rows[:-2])
    out[:, 15] = per_row(lone_run) / words
    triple = np.zeros(len(data), dtype=bool)
    triple[2:] = (data[2:] == data[1:-1]) & (data[2:] == data[:-2]) & letter[2:]
    out[:, 16] = whole(triple) / size
    return out


def learn_lexicon(texts: DataFrame) -> Lexicon:
    """Lexicon from ``text, label`` rows."""

    def stems(batches):
        for batch in batches:
            labels = np.asarray(batch.column("label").to_pylist(), dtype=np.int64)
            for first, end, data, offsets in c.text_blocks(batch.column("text")):
                starts, ends = c.runs(LETTER[data] | DIGIT[data], offsets)
                found = _stems(c.Hasher(c.LOWER[data]), starts, ends)
                rows = np.tile(c.row_of(starts, offsets), len(found))
                pairs = np.unique(np.rec.fromarrays([rows[found.ravel() != 0], found.ravel()[found.ravel() != 0]], names="row,stem"))
                toxic = labels[first:end][pairs["row"]]
                keys, at = np.unique(pairs["stem"], return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(np.bincount(at, weights=toxic, minlength=len(keys)).astype(np.int64)), pa.array(np.bincount(at, weights=1 - toxic, minlength=len(keys)).astype(np.int64))],
                    names=["stem", "toxic", "clean"],
                )

    sizes = texts.agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")).first()
    if not sizes["toxic"] or not sizes["clean"]:
        return Lexicon({})
    ratio = (F.col("toxic") + 0.5) / (F.lit(sizes["toxic"]) + 1.0) / ((F.col("clean") + 0.5) / (F.lit(sizes["clean"]) + 1.0))
    found = (
        texts.mapInArrow(stems, "stem long, toxic long, clean long")
        .groupBy("stem")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .filter(F.col("toxic") >= MIN_DOCS)
        .withColumn("odds", ratio)
        .filter(F.col("odds") >= MIN_ODDS)
        .orderBy(F.desc("odds"), "stem")
        .limit(LEXICON_ROWS)
        .select("stem", F.log("odds").alias("odds"))
        .collect()
    )
    return Lexicon({int(np.int64(r["stem"]).view(np.uint64)): r["odds"] for r in found})


def with_features(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``docs`` (its last column is ``text``) with a vector ``features`` in place of the text."""
    c.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.hashes, lexicon.odds, lexicon.insults, lexicon.second))
    names = docs.columns[:-1]

    def run(batches):
        words = Lexicon.__new__(Lexicon)
        words.hashes, words.odds, words.insults, words.second = shared.value
        for batch in batches:
            parts = [dense(data, offsets, words) for _, _, data, offsets in c.text_blocks(batch.column("text"))]
            values = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
            edges = np.arange(len(values) + 1, dtype=np.int32) * len(FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(edges), pa.array(values.ravel()))], names=[*names, "dense"])

    schema = docs.select(names).withColumn("dense", F.lit(None).cast("array<double>")).schema
    return docs.mapInArrow(run, schema).select(*names, array_to_vector("dense").alias("features"))


class Model:
    """Lexicon, trees and calibration; or one constant when the labels are of one kind."""

    def __init__(self, lexicon: Lexicon, trees, calibration, constant: float = 0.0) -> None:
        self.lexicon, self.trees, self.calibration, self.constant = lexicon, trees, calibration, constant


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = TRAIN_ROWS) -> Model:
    """Model from at most ``most`` of the labelled documents."""
    c.small_batches(docs.sparkSession)
    picked = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .filter("doc_id IS NOT NULL AND label IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(10))
    # At most ``most`` rows of two numbers, so the broadcast is bounded.
    rows = c.stored(texts.join(F.broadcast(picked), "doc_id").select(fold.cast("int").alias("fold"), F.col("label").cast("double").alias("label"), "text"))
    lexicon = learn_lexicon(rows.filter("fold < 4").select("label", "text"))
    table = c.stored(with_features(rows.filter("fold >= 4"), lexicon).select("fold", "label", vector_to_array("features").alias("dense")))
    table = table.select("fold", "label", array_to_vector("dense").alias("features"))
    grow, tune = table.filter("fold < 7").coalesce(4), table.filter("fold >= 7").coalesce(4)
    kinds = {(r["late"], r["label"]) for r in table.select((F.col("fold") >= 7).alias("late"), "label").distinct().collect()}
    if len(kinds) < 4:
        only = {label for _, label in kinds}
        return Model(lexicon, None, None, only.pop() if len(only) == 1 else 0.0)
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=20, maxDepth=3, maxBins=64, stepSize=0.2, seed=7).fit(grow)
    raw = trees.transform(tune).select("label", vector_to_array("probability")[1].alias("raw"))
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(raw)
    return Model(lexicon, trees, calibration)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if model.trees is None:
        return docs.select("doc_id", F.lit(float(model.constant)).alias("score"))
    found = model.trees.transform(with_features(docs, model.lexicon))
    raw = found.select("doc_id", vector_to_array("probability")[1].alias("raw"))
    return model.calibration.transform(raw).select("doc_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))).alias("score"))
