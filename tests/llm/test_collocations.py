"""Phrase mining against plain counts, divided routes, exact scores, and edge cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopygrid.llm import collocations as col

CAPITALS = {i: i + 32 for i in range(65, 91)}


def plain(rows, longest=3, fewest=10, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(CAPITALS)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {g: a for g, a in f.items() if len(g) > 1 and a >= fewest}
        ranked = []
        for g, a in found.items():
            if any(100 * b >= 50 * a and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h, b in found.items() if len(h) > len(g)):
                continue
            score, _, l, r = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            ranked.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out)


def some_rows(n=150, seed=1):
    rng = random.Random(seed)
    words = ["the", "of", "Of", "é", "house", "x|y", "漢", '"', "new", "york", "city", "\x00", *(f"w{i}" for i in range(20))]
    rows = [(rng.choice(["en", "fr", "", None]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "!"]) for _ in range(80))) for _ in range(n)]
    rows += [("en", "the new york city " * 60), ("und", "a b " * 30), ("fr", None), (None, ""), ("de", "..."), ("fr", " a"), ("en", "one two " * 50_000)]
    return rows + rows[:9]


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string").withColumns({x: F.lit(1) for x in ("gram", "f", "word", "n", "id", "rank", "a", "route", "part", "_hot")})


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_plain_counts(spark):
    rows = some_rows()
    assert got(col.mine(frame(spark, rows).repartition(7))) == plain(rows)


def test_divided_routes(spark):
    """Every route is divided, so that counts of pairs are added up from parts."""
    rows = some_rows(60, seed=2)
    assert got(col.mine(frame(spark, rows).repartition(5), route_bytes=2_000, route_rows=50)) == plain(rows)


@pytest.mark.parametrize("longest", [2, 4])
def test_other_lengths_and_top(spark, longest):
    rows = some_rows(60, seed=3)
    assert got(col.mine(frame(spark, rows), longest=longest, fewest=5, top=7)) == plain(rows, longest, 5, 7)


def test_empty(spark):
    docs = frame(spark, [("en", "a b")])
    assert col.mine(docs.limit(0)).count() == 0 and col.mine(docs).count() == 0
    assert col.mine(frame(spark, [(None, None)])).count() == 0


def test_collision_takes_another_seed(spark, monkeypatch):
    true = col.Tokens.ids
    monkeypatch.setattr(col.Tokens, "ids", lambda self, seed: np.ones(len(self.counts), dtype=np.uint64) * np.uint64(7) if seed == 0 else true(self, seed))
    words, _, seed = col.word_counts(col._spoken(frame(spark, [("en", "a b c a")]), "lang", "text"), 1)
    assert seed == 1 and sorted((r["word"], r["n"]) for r in words.collect()) == [("a", 2), ("b", 1), ("c", 1)]


@pytest.mark.parametrize("whole", [True, False])
def test_sort(whole):
    rng = np.random.default_rng(4)
    for _ in range(40):
        n = int(rng.integers(0, 300))
        table = rng.integers(1, rng.integers(2, 9), size=(3, n))
        table[2][rng.random(n) < 0.2] = 0
        numbers, fewest = rng.integers(1, 4, size=n), int(rng.integers(1, 12))
        classes = (table[0] * 31 + table[1]) % 5 if n else np.zeros(0, dtype=np.int64)
        counts = Counter()
        for i in range(n):
            counts[tuple(table[:2, i])] += numbers[i]
            if table[2, i]:
                counts[tuple(table[:, i])] += numbers[i]
        expected = {tuple(map(int, g)): int(x) for g, x in counts.items() if x >= fewest or (not whole and len(g) == 2)}
        found = [(tuple(table[:d, p].tolist()), int(t)) for d, ps, ts in col.quicksorted(table, numbers, fewest, classes, whole) for p, t in zip(ps, ts, strict=True)]
        # Equal leading words share a class, so no phrase comes twice.
        assert dict(found) == expected and len(found) == len(expected)


def test_packed():
    rng = np.random.default_rng(5)
    columns = [rng.integers(0, 50, size=500) for _ in range(3)]
    rows = np.unique(np.stack(columns), axis=1, return_inverse=True)[1]
    for limit in (1 << 62, 3000):
        key = col.packed(columns, 50, limit)
        assert len(set(zip(rows.ravel().tolist(), key.tolist(), strict=True))) == len(set(rows.ravel().tolist())) == len(set(key.tolist()))


def test_exact_scores(spark):
    cases = [(10**12 + 7, 3 * 10**12 + 1, 10**13 + 9), (4, 7, 9), (10, 10, 10), (3_037_000_500, 3_037_000_501, 9 * 10**15)]
    df = spark.createDataFrame(cases, "a long, l long, r long").select("a", "l", "r", col._exact_score(F.col("a"), F.col("l"), F.col("r")).alias("s"))
    assert [r["s"] for r in df.collect()] == [1_000_000 * a * a // (x * y) for a, x, y in cases]
