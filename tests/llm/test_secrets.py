"""Secret scans against plain windows and expressions, and edge cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopygrid.llm import secrets

NAMES = "password|passwd|secret|token|api_?key"
PLAIN = {
    "assign": re.compile("(" + "|".join("".join(f"[{x.upper()}{x}]" if x.isalpha() else x for x in n) for n in NAMES.replace("_?", "~").split("|")).replace("~", "_?") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}


def plain_spans(text):
    text = text or ""
    base = [("assign", m.start(), m.end()) for m in PLAIN["assign"].finditer(text) if len(m[2]) >= 6]
    base += [("access", m.start(), m.end()) for m in PLAIN["access"].finditer(text) if len(m[0]) >= 20]
    base += [("hex", m.start(), m.end()) for m in PLAIN["hex"].finditer(text) if len(m[0]) >= 24]
    added = []
    for kind in secrets.CLASSES:
        members = "".join(re.escape(chr(x)) for a, b in kind.ranges for x in range(a, b + 1))
        for m in re.finditer(f"[{members}]{{{kind.window},}}", text):
            run = m[0]
            if any(re.fullmatch(s, run) for s in secrets.ALLOWED_SHAPES) or any(t in run.lower() for t in secrets.ALLOWED_TERMS):
                continue
            covered = np.zeros(len(run) + 1, dtype=bool)
            for i in range(len(run) - kind.window + 1):
                entropy = -sum(n / kind.window * math.log2(n / kind.window) for n in Counter(run[i : i + kind.window]).values())
                if entropy >= kind.bits - 1e-9:
                    covered[i : i + kind.window] = True
            edges = np.flatnonzero(np.diff(np.r_[0, covered.astype(int)]))
            added += [(kind.kind, m.start() + a, m.start() + b) for a, b in zip(edges[::2], edges[1::2], strict=True)]
    added = [x for x in added if not any(b[1] <= x[1] and b[2] >= x[2] for b in base)]
    order = [*secrets.BASE_KINDS, *(k.kind for k in secrets.CLASSES)]
    return sorted(base + added, key=lambda x: (x[1], order.index(x[0])))


def written(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def plain_row(text):
    spans = plain_spans(text)
    base = [x for x in spans if x[0] in secrets.BASE_KINDS]
    counts = [sum(x[0] == kind for x in base) for kind in secrets.BASE_KINDS]
    return (*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(spans))


def some_texts():
    rng = random.Random(3)
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ab1", "abcdefgh"]
    heads = ["", "token=", "Token = '", 'apikey:"', "api_key=", "PassWord: ", "paſſword=", "toKen=", "secret=ab,", "token=token:", "AKIA", "AKIAx", "é漢 ", "0x", "user/path/"]
    piece = lambda: rng.choice(heads) + "".join(rng.choice(alphabet) for _ in range(rng.choice([3, 5, 6, 19, 20, 24, 40, 90]))) if (alphabet := rng.choice(alphabets)) else ""
    texts = [rng.choice([" ", "\n", "é", "", ",", '"']).join(piece() for _ in range(rng.randint(1, 8))) for _ in range(400)]
    return texts + ["", " ", "token", "token=", "a" * 50, "AKIA" * 30, "550e8400-e29b-41d4-a716-446655440000", "example1234567890qwertyuiop", "token=x" * 50]


def test_texts(spark):
    rows = [(i, x) for i, x in enumerate(some_texts())] + [(None, "token=abcdef"), (9, None), (None, None), (8, "token=abcdef"), (8, "token=abcdef")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({x: F.lit(1) for x in ("found", "spans", "kind", "start", "end", "n_hex")})
    got = secrets.digests(secrets.scan(docs)).collect()
    expected = [(i, *plain_row(x)) for i, x in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    assert sum(r["spans"] != "" for r in got) > 200 and any("base64" in r["spans"] for r in got) and any("hexadecimal" in r["spans"] for r in got) and any("base32" in r["spans"] for r in got)
    assert secrets.digests(secrets.scan(docs.limit(0))).count() == 0


def test_long_text(spark):
    """Counts are kept up by one step a character, so a long string is no square."""
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(1_000_000))
    (row,) = secrets.digests(secrets.scan(spark.createDataFrame([(1, "é " + text)], "doc_id long, text string"))).collect()
    spans = [x for x in row["spans"].split(",") if x.startswith("base64")]
    assert sum(int(x.split(":")[2]) - int(x.split(":")[1]) for x in spans) > 990_000


@pytest.mark.parametrize("window", [2, 5, 24])
def test_incremental_counts(window):
    rng = random.Random(window)
    sums = secrets.log_steps(window)
    for _ in range(200):
        run = bytes(rng.choice(b"abcdefghij") for _ in range(rng.randint(window, 60)))
        most = secrets.CharacterClass("k", (), window, rng.random() * math.log2(window)).most
        high = [i for i in range(len(run) - window + 1) if sum(sums[n] for n in Counter(run[i : i + window]).values()) <= most]
        covered = sorted({j for i in high for j in range(i, i + window)})
        found = list(secrets.windows_over(run, window, most, sums))
        assert covered == [j for a, b in found for j in range(a, b)]
        assert all(a2 > b1 for (_, b1), (a2, _) in zip(found, found[1:]))


def test_redacted(spark):
    docs = spark.createDataFrame([(1, 'é token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x'), (2, "plain"), (3, None)], "doc_id long, text string")
    assert [r["text"] for r in secrets.redacted(docs).collect()] == ["é " + "*" * 49 + '" x', "plain", None]
