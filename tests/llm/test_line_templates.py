"""Templates of lines that differ in neighbouring words, in short lines, and in leaves cut into several blocks."""

import random
from collections import defaultdict

import pytest
from test_brute_force import Groups

from canopygrid.llm import linededup

SCHEMA = "doc_id long, text string"


def kept(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    return {r["doc_id"]: r["text"] for r in linededup.deduplicated(df).collect()}


def plain(texts):
    """Kept texts of single lines: equal places are counted for every pair of lines with one length and lead."""
    groups, lines = Groups(), sorted({tuple(t.split()) for t in texts})
    for i, a in enumerate(lines):
        groups.root(a)
        for b in lines[i + 1 :]:
            if len(a) == len(b) and a[: linededup.LEAD] == b[: linededup.LEAD]:
                sides = len(a) >= linededup.GENERAL_WORDS and any(a[k::2] == b[k::2] for k in (0, 1))
                if sides or 10 * sum(x == y for x, y in zip(a, b, strict=True)) >= linededup.SHARE * len(a):
                    groups.join(a, b)
    docs = defaultdict(set)
    for t in texts:
        docs[groups.root(tuple(t.split()))].add(t)
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(groups.root(tuple(t.split())), i)
    out = {}
    for i, t in enumerate(texts):
        root = groups.root(tuple(t.split()))
        out[i] = t if len(docs[root]) < linededup.MIN_DOCS or first[root] == i else ""
    return out


def test_two_neighbouring_words(spark):
    names = [("ann", "lee"), ("bo", "ray"), ("cy", "fox"), ("di", "poe"), ("ed", "orr"), ("flo", "kay")]
    texts = [f"please send all mail to {a} {b} at the front desk" for a, b in names]
    assert kept(spark, texts) == {k: texts[0] if k == 0 else "" for k in range(6)}


def test_short_lines(spark):
    texts = [f"posted here by {a} today now" for a in ("ann", "bo", "cy", "di", "ed")]
    assert kept(spark, texts) == {k: texts[0] if k == 0 else "" for k in range(5)}


@pytest.mark.parametrize("block", [4096, 3])
def test_every_pair_of_a_leaf_counts(spark, monkeypatch, block):
    monkeypatch.setattr(linededup, "BLOCK_LINES", block)
    pick, texts = random.Random(7), []
    for size in (4, 7, 9, 13, 20):
        for _ in range(4):
            base = ["a", "b", "c", *(pick.choice("pqrstuvw") for _ in range(size - 3))]
            for _ in range(14):
                line = list(base)
                for at in pick.sample(range(3, size), min(size - 3, pick.randint(0, size // 4))):
                    line[at] = pick.choice("pqrstuvwxyz")
                texts.append(" ".join(line))
    pick.shuffle(texts)
    assert kept(spark, texts) == plain(texts)
