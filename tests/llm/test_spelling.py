"""Spelling variants against plain edit distances, crowded keys, and edge cases."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from canopygrid.llm import common, spelling


def plain_words(rows, loss=spelling.LOSS):
    counts = Counter()
    for doc_id, text in rows:
        lowered = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % loss else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(words, ratio=5):
    out = {}
    for w, n in words.items():
        near = [(-m, x) for x, m in words.items() if one_edit(w, x)]
        best = min(near, default=None)
        form = best[1] if best and -best[0] >= ratio * n else None
        out[w] = [form, w, n, len(near), words[form] if form else None]
    for w, row in out.items():
        while out[row[1]][0]:
            row[1] = out[row[1]][0]
    return {w: tuple(row) for w, row in out.items()}


def groups(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def table(spark, words):
    return common.stored(spark.createDataFrame(list(words.items()), "word string, n long"))


@pytest.mark.parametrize("most", [1, 50, spelling.MOST_PAIRS])
def test_random_words(spark, most):
    rng = random.Random(5)
    words = {"".join(rng.choice("abÉ") for _ in range(rng.randint(6, 9))): rng.choice([5, 6, 30, 31, 200]) for _ in range(600)}
    formed = common.stored(spelling.forms(table(spark, words), most=most))
    assert groups(spelling.with_roots(formed)) == plain_groups(words)


@pytest.mark.parametrize("most", [4, spelling.MOST_PAIRS])
def test_words_that_share_a_chunk(spark, most):
    """All words share their first half, so that its key must be divided."""
    rng = random.Random(6)
    words = {"prefix" + "".join(rng.choice("abcdef") for _ in range(rng.randint(5, 6))): rng.randint(5, 100) for _ in range(800)}
    formed = common.stored(spelling.forms(table(spark, words), most=most))
    assert groups(spelling.with_roots(formed)) == plain_groups(words)


def test_chains_and_ties(spark):
    words = {"letters": 1000, "lettersa": 200, "lettersab": 40, "lettersabc": 8, "mutters": 5, "butters": 25, "gutters": 25, "singles": 7}
    found = groups(spelling.with_roots(common.stored(spelling.forms(table(spark, words)))))
    assert found == plain_groups(words)
    assert found["lettersabc"][:2] == ("lettersab", "letters")
    assert found["mutters"][0] == "butters" and found["singles"] == (None, "singles", 7, 0, None)


def test_whole_texts(spark, monkeypatch):
    rng = random.Random(7)
    stems = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(3, 8))) for _ in range(150)]
    rows = [(i % 60 if i % 9 else None, "".join(rng.choice([*stems, "ÀÉ", "Œ", "ſ", "K"]) + rng.choice(" .-1\n漢") for _ in range(120))) for i in range(200)]
    rows += [(1, None), (None, None), (2, ""), (3, "x" * 300_000), (4, "Wordlike " * 200_000), (4, "Wordlike " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({x: F.lit(1) for x in ("word", "n", "key", "rest", "other", "form", "root", "option")})
    words = plain_words(rows)
    assert groups(spelling.group(docs)) == plain_groups(words)
    monkeypatch.setattr(spelling, "SLICE", 11)
    text = rows[0][1].lower()
    assert spelling.words_of("5", text) == spelling.words_of("5", text + " ") and sum(spelling.words_of("5", text, loss=10**12).values()) == len(re.findall("[a-zÀ-ÿ]{6,}", text))
    assert spelling.group(docs.limit(0)).count() == 0
