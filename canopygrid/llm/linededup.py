"""Operator 8, line dedup: a log-template tree over lines; templates that recur across documents are dropped.

A line's words are its runs without white space; a word with a digit is a variable
field.  The tree has a fixed depth: the number of words, then the first ``LEAD``
words.  In a leaf, equal lines are one template, and so are lines that agree at no
less than ``SHARE`` tenths of their places, or (from ``GENERAL_WORDS`` words on) at all even or at
all odd places, directly or through other lines: the places where they differ are
variable fields.  A template recurs when lines of it stand in at least ``MIN_DOCS``
different texts (exact copies of a document count once).  Lines shorter than
``MIN_WORDS`` words never go.

No pair that agrees so far is lost: of ``n`` places at most ``d = n * (10 - SHARE) // 10``
differ, so with the places after the lead dealt into ``d + 1`` parts, one part is equal.
Lines that share a part are candidates, and equal places are counted.  Each line is
compared with one other first (the smallest of the part-groups that it meets most);
then lines of a part-group that are still in different components are
compared in blocks of bounded size, those outside the group's largest component with all.

Of a recurring template, only the document with the smallest id keeps its lines, each
once; all its other lines are dropped.  A document stays, even with no line left.

All counts cover all lines, as 64-bit hashes: one scan finds them, leaves with too few
documents go at once, templates are components of links between lines, and a
last scan removes the lines.  A scan between them makes the words of the lines of
leaves with different lines, and nothing else.

Edge cases: a null text stays null; an empty one empty; lines end at ``\\n`` only;
a template without any id loses all its lines; repeated rows are copies; other
columns pass through, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopygrid.llm import common as c
from canopygrid.llm.graph import components

MIN_DOCS = 5
MIN_WORDS = 3
GENERAL_WORDS = 8
LEAD = 3
#: Tenths of a line's places that two lines of one template have equal.
SHARE = 7
#: Lines, and words of lines, of one side of a comparison in one task, at most (a longer line is alone).
BLOCK_LINES, BLOCK_WORDS = 4096, 1 << 20
_SPACE = c.byte_set((9, 13), (32, 32))
_DIGIT = c.byte_set((48, 57))
_VARIABLE = np.uint64(0x2545F4914F6CDD1D)


class Lines:
    """The lines of one block of texts, and the hashes of those with enough words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.starts, self.ends = c.runs(data != 10, offsets)
        self.rows = c.row_of(self.starts, offsets)
        w_starts, w_ends = c.runs(~_SPACE[data], offsets)
        hasher = c.Hasher(data)
        words = hasher.ranges(w_starts, w_ends)
        digits = np.r_[0, np.cumsum(_DIGIT[data])]
        words[digits[w_ends] > digits[w_starts]] = _VARIABLE
        self.words = words
        edges = np.searchsorted(w_starts, np.r_[self.starts, len(data)])
        # White space other than a blank may end a line's last word at the same place as the line.
        self.first, self.count = edges[:-1], np.diff(edges)
        long = self.count >= MIN_WORDS
        self.long = np.flatnonzero(long)
        first, count = self.first[long], self.count[long]
        powers, inverses = hasher.powers[: len(words)], hasher.inverses

        def spans(values: np.ndarray) -> np.ndarray:
            sums = np.zeros(len(values) + 1, dtype=np.uint64)
            np.cumsum(values * powers, out=sums[1:], dtype=np.uint64)
            return c.mix((sums[first + count] - sums[first]) * inverses[first] + count.astype(np.uint64))

        self.line = spans(words)
        lead = np.zeros(len(first), dtype=np.uint64)
        for i in range(LEAD):
            lead = c.mix(lead + words[first + i])
        self.leaf = c.mix(lead + count.astype(np.uint64))
        # Places count from the line's first word.
        place = np.arange(len(words)) - np.repeat(self.first, self.count) if len(words) else np.zeros(0, dtype=np.int64)
        zero = np.uint64(0)
        self.even, self.odd = (c.mix(spans(np.where(place % 2 == k, words, zero)) + self.leaf + np.uint64(k)) for k in (0, 1))
        short = count < GENERAL_WORDS
        self.even[short] = self.odd[short] = self.line[short]


def _lines(docs: DataFrame) -> DataFrame:
    """``doc_id, copy, leaf, line, even, odd`` of the distinct long lines of every row; ``copy`` names the text."""

    def run(batches):
        for batch in batches:
            for first, _, data, offsets in c.text_blocks(batch.column("text")):
                found = Lines(data, offsets)
                rows = found.rows[found.long]
                order = np.lexsort((found.line, rows))
                fresh = order[np.r_[True, (np.diff(rows[order]) != 0) | (found.line[order][1:] != found.line[order][:-1])]] if len(order) else order
                at = pa.array(rows[fresh] + first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(at), batch.column("copy").take(at), *(pa.array(x[fresh].view(np.int64)) for x in (found.leaf, found.line, found.even, found.odd))],
                    names=["doc_id", "copy", "leaf", "line", "even", "odd"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("copy")).mapInArrow(c.releasing(run), f"doc_id {kind}, copy long, leaf long, line long, even long, odd long")


def _words(docs: DataFrame, leaves: DataFrame) -> DataFrame:
    """``leaf, line, words`` of the distinct lines of some leaves."""
    few = c.fits_broadcast(leaves)
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(leaves.select("leaf").toArrow().column(0).to_numpy()) if few else None)

    def run(batches):
        wanted = shared.value
        for batch in batches:
            for _, _, data, offsets in c.text_blocks(batch.column("text")):
                found = Lines(data, offsets)
                line, at = np.unique(found.line.view(np.int64), return_index=True)
                leaf = found.leaf[at].view(np.int64)
                if wanted is not None:
                    some = c.among(leaf, wanted)
                    line, leaf, at = line[some], leaf[some], at[some]
                first, count = found.first[found.long][at], found.count[found.long][at]
                words = pa.array([found.words[i : i + n].tobytes() for i, n in zip(first.tolist(), count.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(line), words], names=["leaf", "line", "words"])

    found = docs.select("text").mapInArrow(c.releasing(run), "leaf long, line long, words binary")
    return (found if few else found.join(leaves, "leaf", "left_semi")).dropDuplicates(["line"])


def parts(words: np.ndarray, leaf: int) -> np.ndarray:
    """One number for each part of the places after the lead."""
    tail = words[LEAD:]
    most = len(words) * (10 - SHARE) // 10 + 1
    padded = np.zeros(-(-len(tail) // most) * most, dtype=np.uint64)
    padded[: len(tail)] = c.mix(tail + np.arange(1, len(tail) + 1, dtype=np.uint64) * _VARIABLE)
    sums = padded.reshape(-1, most).sum(axis=0, dtype=np.uint64)
    return c.mix(sums + c.mix(np.arange(most, dtype=np.uint64) + np.array([leaf], dtype=np.int64).view(np.uint64)))


def _members(lines: DataFrame) -> DataFrame:
    """``part, line, n_words`` of ``leaf, line, words``."""

    def run(batches):
        for batch in batches:
            found = [parts(np.frombuffer(w, dtype=np.uint64), leaf) for leaf, w in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            at = np.repeat(np.arange(len(found)), [len(x) for x in found])
            size = np.array([len(w) // 8 for w in batch.column(2).to_pylist()], dtype=np.int64)
            every = np.concatenate(found).view(np.int64) if found else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(every), batch.column(1).take(pa.array(at)), pa.array(size[at])], names=["part", "line", "n_words"])

    return lines.select("leaf", "line", "words").mapInArrow(c.releasing(run), "part long, line long, n_words long")


def _alike(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The ``src, dst`` pairs of lines with enough equal places."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                keep.append(len(a) == len(b) and 10 * int((a == b).sum()) >= SHARE * len(a))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    left = lines.select(F.col("line").alias("src"), F.col("words").alias("x"))
    right = lines.select(F.col("line").alias("dst"), F.col("words").alias("y"))
    return pairs.join(left, "src").join(right, "dst").select("src", "dst", "x", "y").mapInArrow(c.releasing(run), "src long, dst long")


def _across(members: DataFrame, lines: DataFrame, roots: DataFrame) -> DataFrame:
    """``src, dst`` links of lines of a part-group that have different roots, one for each line and root at least."""
    named = members.join(roots.select(F.col("node").alias("line"), "root"), "line", "left").withColumn("root", F.coalesce("root", "line"))
    sizes = named.groupBy("part", "root").agg(F.count("*").alias("n"), F.first("n_words").alias("n_words"))
    groups = sizes.groupBy("part").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("n_roots"), F.first("n_words").alias("n_words")).filter("n_roots > 1")
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_LINES), F.floor(F.lit(BLOCK_WORDS) / F.col("n_words"))))
    open_ = groups.select("part", F.col("main.root").alias("main"), F.ceil((F.col("n") - F.col("main.n")) / block).alias("lefts"), F.ceil(F.col("n") / block).alias("rights"))
    open_ = c.stored(open_)
    dealt = c.stored(named.select("part", "line", "root").join(open_, "part"))
    hashed = F.xxhash64("line")

    def side(rows: DataFrame, is_left: bool) -> DataFrame:
        mine, others = ("lefts", "rights") if is_left else ("rights", "lefts")
        one, all_ = F.pmod(hashed, F.col(mine)).alias("one"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(others).cast("long") - 1)).alias("other")
        rows = rows.select("part", "line", "root", one, all_)
        return rows.select("part", F.col("one" if is_left else "other").alias("left"), F.col("other" if is_left else "one").alias("right"), "line", "root", F.lit(is_left).alias("is_left"))

    placed = side(dealt.filter("root <> main"), True).union(side(dealt, False)).join(lines.select("line", "words"), "line")
    blocks = placed.groupBy("part", "left", "right").agg(F.collect_list(F.struct("line", "root", "is_left", "words")).alias("held"))

    def run(batches):
        for batch in batches:
            found = [np.zeros((0, 2), dtype=np.int64)]
            for held in batch.column(0):
                held = held.values
                line, root, is_left = (held.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                words = np.frombuffer(b"".join(held.field(3).to_pylist()), dtype=np.uint64).reshape(len(line), -1)
                need = -(-SHARE * words.shape[1] // 10)
                rights = np.flatnonzero(~is_left)
                for i in np.flatnonzero(is_left).tolist():
                    some = rights[root[rights] != root[i]]
                    some = some[(words[some] == words[i]).sum(axis=1) >= need]
                    some = some[np.unique(root[some], return_index=True)[1]]
                    found.append(np.c_[np.full(len(some), line[i]), line[some]])
            every = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(every[:, 0]), pa.array(every[:, 1])], names=["src", "dst"])

    return blocks.select("held").mapInArrow(c.releasing(run), "src long, dst long").dropDuplicates()


def recurring(docs: DataFrame, lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``line, template, n_docs, keeper`` of every line of a recurring template; ``lines`` are those of ``docs``."""
    leaves = lines.groupBy("leaf").agg(F.count("*").alias("n"), (F.min("line") < F.max("line")).alias("varied")).filter(F.col("n") >= min_docs)
    leaves = c.stored(leaves.select("leaf", "varied"))
    # A hot line meets its leaf once for each task, not for each document.
    some = c.stored(lines.join(leaves, "leaf", "left_semi").select("line", "even", "odd", "copy", "doc_id"))
    kinds = some.select("line", "even", "odd").dropDuplicates(["line"])
    links = None
    for side in ("even", "odd"):
        low = kinds.groupBy(side).agg(F.min("line").alias("src"), F.count("*").alias("n")).filter("n > 1").select(side, "src")
        hung = kinds.join(low, side).select("src", F.col("line").alias("dst")).filter("src <> dst")
        links = hung if links is None else links.union(hung)
    worded = c.stored(_words(docs, c.stored(leaves.filter("varied").select("leaf"))))
    members = c.stored(_members(worded))
    low = members.groupBy("part").agg(F.min("line").alias("src"), F.count("*").alias("n")).filter("n > 1").select("part", "src")
    met = members.join(low, "part").select("src", F.col("line").alias("dst")).filter("src <> dst").groupBy("src", "dst").count()
    first = met.groupBy("dst").agg(F.max(F.struct("count", "src")).alias("best")).select(F.col("best.src").alias("src"), "dst")
    links = c.stored(links.union(_alike(first, worded)))
    roots = components(links)
    across = c.stored(_across(members, worded, roots))
    if across.take(1):
        roots = components(links.union(across))
    roots = roots.select(F.col("node").alias("line"), F.col("root").alias("template"))
    named = some.join(roots, "line", "left").withColumn("template", F.coalesce("template", "line"))
    texts = named.groupBy("template", "copy").agg(F.min("doc_id").alias("keeper"))
    counted = texts.groupBy("template").agg(F.count("*").alias("n_docs"), F.min("keeper").alias("keeper")).filter(F.col("n_docs") >= min_docs)
    return named.select("line", "template").dropDuplicates(["line"]).join(counted, "template").select("line", "template", "n_docs", "keeper")


def _drops(docs: DataFrame, min_docs: int) -> DataFrame:
    """``__id, __copy, __gone, __once``: lines that go from a text, and lines that it keeps once."""
    lines = c.stored(_lines(docs))
    found = c.stored(recurring(docs, lines, min_docs))
    hits = lines.select("line", "doc_id", "copy").join(found.select("line", "keeper"), "line")
    keeps = F.col("doc_id").eqNullSafe(F.col("keeper")) & F.col("doc_id").isNotNull()
    per_text = hits.groupBy(F.col("doc_id").alias("__id"), F.col("copy").alias("__copy"))
    return per_text.agg(F.collect_set(F.when(~keeps, F.col("line"))).alias("__gone"), F.collect_set(F.when(keeps, F.col("line"))).alias("__once"), F.count("*").alias("__n"))


def _with_drops(docs: DataFrame, id_col: str, text_col: str, min_docs: int) -> DataFrame:
    spark = docs.sparkSession
    c.small_batches(spark)
    drops = c.stored(_drops(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), min_docs))
    total = drops.agg(F.sum("__n")).first()[0] or 0
    side = F.broadcast(drops) if total <= c.BROADCAST_ROWS else drops
    at = docs[id_col].eqNullSafe(F.col("__id")) & F.xxhash64(docs[text_col]).eqNullSafe(F.col("__copy"))
    return docs.join(side, at, "left").drop("__id", "__copy", "__n")


def _kept(batch: pa.RecordBatch, text_at: int, gone_at: int, once_at: int) -> tuple[list, list[int], list[int]]:
    """Texts without their dropped lines, numbers of lines, numbers of dropped lines."""
    texts: list[str | None] = batch.column(text_at).to_pylist()
    gone, once = batch.column(gone_at), batch.column(once_at)
    total, dropped = [0 if t is None else t.count("\n") + 1 for t in texts], [0] * len(texts)
    hit = [i for i in range(len(texts)) if gone[i].is_valid]
    if not hit:
        return texts, total, dropped
    for first, end, data, offsets in c.text_blocks(batch.column(text_at).take(pa.array(hit))):
        found = Lines(data, offsets)
        edges = np.searchsorted(found.rows[found.long], np.arange(end - first + 1))
        for k in range(end - first):
            i = hit[first + k]
            mine = found.line[edges[k] : edges[k + 1]].view(np.int64)
            out = np.isin(mine, np.array(gone[i].as_py(), dtype=np.int64))
            again = np.ones(len(mine), dtype=bool)
            again[np.unique(mine, return_index=True)[1]] = False
            out |= again & np.isin(mine, np.array(once[i].as_py(), dtype=np.int64))
            if not out.any():
                continue
            keep = np.ones(offsets[k + 1] - offsets[k], dtype=bool)
            for j in found.long[edges[k] : edges[k + 1]][out]:
                a, b = found.starts[j] - offsets[k], found.ends[j] - offsets[k]
                # The line end after the line goes with it, or the one before a last line.
                keep[a : b + 1] = False
                if b == len(keep):
                    before = np.flatnonzero(keep[:a])
                    if len(before) and data[offsets[k] + before[-1]] == 10:
                        keep[before[-1]] = False
            texts[i] = data[offsets[k] : offsets[k + 1]][keep].tobytes().decode()
            dropped[i] = int(out.sum())
    return texts, total, dropped


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` without the lines of recurring templates, under the same columns."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for batch in batches:
            texts = _kept(batch, at, len(names), len(names) + 1)[0]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(names))], names=names)

    return _with_drops(docs, id_col, text_col, min_docs).mapInArrow(c.releasing(run), docs.schema)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """Per row: ``doc_id, n_lines, n_dropped, kept_chars, kept_sha256``."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts, total, dropped = _kept(batch, 1, 2, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64())], names=["doc_id", "text", "n_lines", "n_dropped"])

    out = _with_drops(docs, "doc_id", "text", min_docs).mapInArrow(c.releasing(run), f"doc_id {kind}, text string, n_lines long, n_dropped long")
    return out.select("doc_id", "n_lines", "n_dropped", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
