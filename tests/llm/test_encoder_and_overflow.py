"""Ids of random Unicode texts against the tokenizer itself, and vectors whose distances overflow."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from canopygrid.llm import common, neighbours, packing
from canopygrid.llm.queries import tokenizer


def test_random_texts_have_the_tokenizers_ids():
    rng = random.Random(11)
    letters = [chr(x) for x in [*range(0x20, 0x7F), *range(0xA0, 0x250), 0x307, 0x301, 0x2019, 0x6F22, 0x1F600]] + list("  \n\tabcAIi19<>.,") * 6 + ["İ"] * 20
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    path = tokenizer("word_bpe_49k.json")
    plain, encoder = Tokenizer.from_file(path), packing.Encoder(path)
    for first, end, data, offsets in common.text_blocks(pa.array(texts)):
        flat, bounds = encoder.encode(data, offsets)
        for i in range(first, end):
            ids = flat[bounds[i - first] : bounds[i - first + 1]].tolist()
            assert ids == [*plain.encode(texts[i], add_special_tokens=False).ids, packing.SEPARATOR], ascii(texts[i])


def test_overflowing_distances_stay(spark):
    vectors = [(0, [1e200]), (100, [-1e200]), (1, [1e200]), (2, [3.0]), (3, [float("inf")]), (4, [0.0])]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    found = neighbours.search(rows, F.col("vec_id") % 100 == 0).collect()
    got = {q: [(r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 100)}
    assert got == {0: [(1, 0.0), (2, np.inf), (100, np.inf)], 100: [(0, np.inf), (1, np.inf), (2, np.inf)]}
