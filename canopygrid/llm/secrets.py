"""Operator 12, secret scans: sliding-window Shannon entropy per character class.

Candidate strings are the maximal runs of a class's characters that are at least
one window long.  A window slides over each candidate; the counts of its
characters change by one arrival and one departure a step, and with them the sum
of ``n log2 n`` over the counts, from which the entropy follows: a step costs the
same for windows of any width.  The sums are whole numbers (multiples of
2**-20), so that no error builds up along a long string.  Overlapping or touching
windows at or above the class's threshold are one span.  A candidate on the
allow-list gives none: it matches an allowed shape, or holds an allowed term.

Beside them stand base spans by fixed shapes: assigned values, access keys and
long hexadecimal runs, each leftmost and non-overlapping.  The allow-list does not
touch base spans; an entropy span inside one base span adds nothing and is left out.

Places are code points, ends exclusive.  Edge cases: a null text is empty and has no spans, as
has a text without candidates; texts of any length are read whole, in time that
grows with their length; repeated rows are scanned one by one; of the input only
the id and the text are read, so other columns cannot clash; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopygrid.llm import common as c

#: The shapes of base spans, and the least length of what they hold.
ASSIGN = rb"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_NAMES = [b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"]
ASSIGN_LEAST = 6
ACCESS = rb"AKIA[A-Z0-9]+"
ACCESS_LEAST = 20
HEX_LEAST = 24
BASE_KINDS = ["assign", "access", "hex"]

#: One part in so many of a bit that entropy sums are counted in.
UNIT = 1 << 20


@dataclass(frozen=True)
class CharacterClass:
    """Characters of a class as byte ranges, window, and least entropy in bits a character."""

    kind: str
    ranges: tuple[tuple[int, int], ...]
    window: int
    bits: float

    @property
    def most(self) -> int:
        """Greatest sum of ``n log2 n`` (in units) that a window at the threshold has."""
        return math.floor(self.window * (math.log2(self.window) - self.bits) * UNIT)


DIGITS, CAPITALS, SMALL = (48, 57), (65, 90), (97, 122)
CLASSES = (
    CharacterClass("base64", (DIGITS, CAPITALS, SMALL, (43, 43), (47, 47), (95, 95), (45, 45)), 20, 3.75),
    CharacterClass("hexadecimal", (DIGITS, (65, 70), (97, 102)), 20, 3.0),
    CharacterClass("base32", (CAPITALS, (50, 55)), 24, 3.5),
)
#: Shapes of whole candidates that are no secrets: words and paths of letters only, UUIDs.
ALLOWED_SHAPES = (r"[A-Za-z/_+-]+", r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}")
#: Terms that mark sample values, in small letters.
ALLOWED_TERMS = ("example", "sample", "placeholder", "changeme", "dummy", "xxxxxx", "0123456789", "abcdef")


def log_steps(window: int) -> list[int]:
    """``n log2 n`` in units for each count up to ``window``."""
    return [0, *(round(n * math.log2(n) * UNIT) for n in range(1, window + 1))]


def windows_over(run: bytes, window: int, most: int, sums: Sequence[int]) -> Iterator[tuple[int, int]]:
    """Spans of ``run`` that windows at or above the threshold cover."""
    counts = [0] * 256
    total = 0
    first = last = -1
    for at, byte in enumerate(run):
        n = counts[byte]
        total += sums[n + 1] - sums[n]
        counts[byte] = n + 1
        start = at - window + 1
        if start < 0:
            continue
        if total <= most:
            if first >= 0 and start > last:
                yield first, last
                first = -1
            first = start if first < 0 else first
            last = at + 1
        gone = run[start]
        n = counts[gone]
        total += sums[n - 1] - sums[n]
        counts[gone] = n - 1
    if first >= 0:
        yield first, last


def _named_rows(lowered: bytes, offsets: np.ndarray) -> np.ndarray:
    """Rows that hold one of the names of assigned values."""
    at = []
    for name in ASSIGN_NAMES:
        place = lowered.find(name)
        while place >= 0:
            row = int(c.row_of(np.array([place]), offsets)[0])
            at.append(row)
            place = lowered.find(name, int(offsets[row + 1]))
    return np.unique(np.array(at, dtype=np.int64))


class Scanner:
    """Spans of many texts; made once for each task."""

    def __init__(self, classes: Sequence[CharacterClass], shapes: Sequence[str], terms: Sequence[str]) -> None:
        self.classes = [(k, c.byte_set(*k.ranges), log_steps(k.window)) for k in classes]
        self.allowed = re.compile("|".join(f"(?:{s})" for s in shapes).encode()) if shapes else None
        self.terms = [t.encode() for t in terms]
        self.hex = c.byte_set(DIGITS, (97, 102))
        self.assign, self.access = re.compile(ASSIGN), re.compile(ACCESS)
        self.order = {kind: i for i, kind in enumerate([*BASE_KINDS, *(k.kind for k in classes)])}

    def suppressed(self, run: bytes) -> bool:
        """Whether a candidate stands on the allow-list."""
        lowered = run.lower()
        return bool(self.allowed and self.allowed.fullmatch(run)) or any(t in lowered for t in self.terms)

    def base(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, str, int, int]]:
        """``row, kind, start, end`` of base spans, in bytes of the block."""
        text = data.tobytes()
        for row in _named_rows(text.lower(), offsets).tolist():
            for m in self.assign.finditer(text, int(offsets[row]), int(offsets[row + 1])):
                if len(m[2]) >= ASSIGN_LEAST:
                    yield row, "assign", m.start(), m.end()
        place = text.find(b"AKIA")
        while place >= 0:
            row = int(c.row_of(np.array([place]), offsets)[0])
            end = int(offsets[row + 1])
            for m in self.access.finditer(text, place, end):
                if m.end() - m.start() >= ACCESS_LEAST:
                    yield row, "access", m.start(), m.end()
            place = text.find(b"AKIA", end)
        for row, start, end in self.runs(self.hex, data, offsets, HEX_LEAST):
            yield row, "hex", start, end

    def runs(self, table: np.ndarray, data: np.ndarray, offsets: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
        """``row, start, end`` of the maximal runs of a class that are long enough."""
        starts, ends = c.runs(table[data], offsets)
        long = np.flatnonzero(ends - starts >= least)
        rows = c.row_of(starts[long], offsets)
        return zip(rows.tolist(), starts[long].tolist(), ends[long].tolist(), strict=True)

    def entropic(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, str, int, int]]:
        """``row, kind, start, end`` of spans of high entropy, in bytes of the block."""
        for kind, table, sums in self.classes:
            for row, start, end in self.runs(table, data, offsets, kind.window):
                run = data[start:end].tobytes()
                if not self.suppressed(run):
                    for a, b in windows_over(run, kind.window, kind.most, sums):
                        yield row, kind.kind, start + a, start + b

    def block(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, str, int]]]:
        """Sorted ``start, kind, end`` spans of each row that has some, in code points of the row."""
        found: dict[int, list] = {}
        for row, kind, start, end in self.base(data, offsets):
            found.setdefault(row, []).append((start, self.order[kind], end, kind))
        # Where the base span that reaches farthest among those starting no later ends after a span, the span lies inside it.
        reach = {}
        for row, spans in found.items():
            spans.sort()
            reach[row] = np.array([s[0] for s in spans]), np.maximum.accumulate([s[2] for s in spans])
        for row, kind, start, end in self.entropic(data, offsets):
            if row in reach:
                starts, ends = reach[row]
                before = int(np.searchsorted(starts, start, side="right"))
                if before and ends[before - 1] >= end:
                    continue
            found.setdefault(row, []).append((start, self.order[kind], end, kind))
        return {row: self.code_points(data, int(offsets[row]), sorted(spans)) for row, spans in found.items()}

    @staticmethod
    def code_points(data: np.ndarray, first: int, spans: list) -> list[tuple[int, str, int]]:
        """Spans counted in code points; all their characters are ASCII, or blanks and quotes between."""
        out, at, count = [], first, 0
        for start, _, end, kind in spans:
            count += int(np.count_nonzero((data[at:start] & 0xC0) != 0x80))
            at = start
            out.append((count, kind, count + end - start))
        return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: Sequence[CharacterClass] = CLASSES, shapes: Sequence[str] = ALLOWED_SHAPES, terms: Sequence[str] = ALLOWED_TERMS) -> DataFrame:
    """``doc_id, found`` of every row: its spans by start, then kind, as ``kind, start, end``."""
    c.small_batches(docs.sparkSession)

    def run(batches):
        scanner = Scanner(classes, shapes, terms)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            for first, _, data, offsets in c.text_blocks(batch.column(1)):
                for row, found in scanner.block(data, offsets).items():
                    spans[first + row] = [{"kind": k, "start": a, "end": b} for a, k, b in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "found"])

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, found array<struct<kind:string,start:bigint,end:bigint>>")


def digests(scanned: DataFrame) -> DataFrame:
    """Counts of base spans and the spans of each row as text."""
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["kind"].isin(BASE_KINDS))
    return scanned.select(
        "doc_id", *(count(kind).alias(f"n_{kind}") for kind in BASE_KINDS), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("found")).alias("spans")
    )


def redacted(docs: DataFrame, mask: str = "*", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, text`` with every character of a span replaced by ``mask``."""
    c.small_batches(docs.sparkSession)
    classes, shapes, terms = options.get("classes", CLASSES), options.get("shapes", ALLOWED_SHAPES), options.get("terms", ALLOWED_TERMS)

    def run(batches):
        scanner = Scanner(classes, shapes, terms)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, _, data, offsets in c.text_blocks(batch.column(1)):
                for row, spans in scanner.block(data, offsets).items():
                    text, parts, at = texts[first + row], [], 0
                    for start, _, end in spans:
                        if end > at:
                            parts += [text[at : max(at, start)], mask * (end - max(at, start))]
                            at = end
                    texts[first + row] = "".join(parts) + text[at:]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, docs.schema)
