"""Operator 11, spelling variant grouping: asymmetric chunks against positional grams.

Words are maximal runs of letters (A-Z lower-cased), counted over all documents
after a small share of occurrences lost one letter by a fixed rule; words of at
least ``SHORTEST`` code points and ``FEWEST`` occurrences are compared.  Two words
are near if one inserted, deleted or replaced code point turns one into the other.

A word contributes two disjoint chunks, its halves.  The other word, of the same
length or one longer, contributes its positional grams as long as those halves,
at the places that a shift of at most one allows.  One edit touches one half at
most, so near words share the other half: at the same place, or one further where
the edit stood before it.  (A longer word's second half is needed only one further:
where it is not, the first half is whole too.)  Rows meet in a shuffle join on a hash of chunk, place and length, and
every pair that meets is verified by edit distance.

A chunk that very many words share is never joined as it is: in such a group the
shared chunk is cut out, and what is left of each word is chunked again, until
groups are small or at most one letter is left, which an alphabet bounds.  So no
group is compared pair by pair, and no link is lost.

Edge cases: a null or empty text has no words; a null id counts as the empty
string in the rule; repeated rows count one by one; texts of any length are read
whole, in slices that end between words; other columns are not read; an empty
table gives an empty result.  A word without near words is its own root.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopygrid.llm import common as c

SHORTEST = 6
FEWEST = 5
#: A form occurs at least this many times as often as its variant.
RATIO = 5
#: One in so many pairs of document and run loses a letter.
LOSS = 199
#: Pairs of rows that one key may bring together before it is divided further; beyond an alphabet's square, which ends the division.
MOST_PAIRS = 1 << 14
#: Different words that a task holds before it hands on their counts.
HELD_WORDS = 1 << 18
#: Characters that one look at a text takes.
SLICE = 1 << 20



def _slices(text: str, shortest: int) -> Iterator[list[str]]:
    """The runs of at least ``shortest`` letters of a lower-cased text, slice by slice."""
    run, gap = re.compile(f"[a-zÀ-ÿ]{{{shortest},}}"), re.compile("[^a-zÀ-ÿ]")
    at = 0
    while at < len(text):
        cut = gap.search(text, at + SLICE) if at + SLICE < len(text) else None
        end = cut.start() if cut else len(text)
        yield run.findall(text, at, end)
        at = end


def words_of(doc_id: str, text: str, loss: int = LOSS, shortest: int = SHORTEST) -> Counter:
    """Occurrences of each word of one document; ``text`` has small letters for A-Z."""
    counts: Counter = Counter()
    for found in _slices(text, shortest):
        counts.update(found)
    prefix = zlib.crc32(f"{doc_id}:".encode())
    lost = [(run, h) for run in counts if (h := zlib.crc32(run.encode(), prefix)) % loss == 0]
    for run, h, n in [(run, h, counts.pop(run)) for run, h in lost]:
        shorter = run[: h % len(run)] + run[h % len(run) + 1 :]
        if len(shorter) >= shortest:
            counts[shorter] += n
    return counts


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, fewest: int = FEWEST, loss: int = LOSS) -> DataFrame:
    """``word, n`` of every word that occurs often enough."""
    c.small_batches(docs.sparkSession)

    def counted(batches):
        def handed_on():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                if text.is_valid:
                    held.update(words_of(doc_id or "", text.as_py().lower().decode(), loss, shortest))
                if len(held) >= HELD_WORDS:
                    yield handed_on()
                    held.clear()
        yield handed_on()

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(counted, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= fewest)


def _key(length: Column, place: Column, gram: Column) -> Column:
    return F.xxhash64("key", length, place, gram)


def _gram(place: Column, length: Column) -> Column:
    return F.substring("rest", place + 1, length)


def _without(place: Column, length: Column) -> Column:
    return F.concat(F.substring("rest", F.lit(1), place), F.substring("rest", place + length + 1, F.length("rest")))


def _emitted(rows: DataFrame, signatures: list[tuple[Column, Column, Column, Column]]) -> DataFrame:
    """A row for each signature ``(length of the chunked rest, place there, place here, chunk length)``."""
    options = [
        F.struct(_key(whole, there, _gram(here, size)).alias("key"), _without(here, size).alias("rest"), F.length(_gram(here, size)).alias("found"), size.alias("size"))
        for whole, there, here, size in signatures
    ]
    rows = rows.withColumn("option", F.explode(F.array(*options))).filter("option.found = option.size")
    return rows.select("option.key", "word", "n", "option.rest")


def chunks(rows: DataFrame) -> DataFrame:
    """The two halves of what is left of each word."""
    length = F.length("rest")
    half = F.floor(length / 2).cast("int")
    zero = F.lit(0)
    return _emitted(rows, [(length, zero, zero, half), (length, half, half, length - half)])


def grams(rows: DataFrame) -> DataFrame:
    """The grams that may equal a half of a rest of the same length, or of one that is one shorter."""
    length = F.length("rest")
    half, zero = F.floor(length / 2).cast("int"), F.lit(0)
    shorter = length - 1
    less = F.floor(shorter / 2).cast("int")
    same = [(length, zero, zero, half), (length, half, half, length - half)]
    longer = [(shorter, zero, zero, less), (shorter, less, less + 1, shorter - less)]
    return _emitted(rows.filter(length > 0), same + longer)


def near_pairs(words: DataFrame, most: int = MOST_PAIRS) -> DataFrame:
    """``word, n, other, other_n`` of every two near words, both ways round; ``words`` is stored and holds each word once."""
    start = words.select(F.lit(0).cast("long").alias("key"), "word", "n", F.col("word").alias("rest"))
    left, right = start, start
    met = None
    while True:
        a, b = chunks(left), grams(right)
        sizes = a.select("key", F.lit(1).alias("a"), F.lit(0).alias("b"), F.length("rest").alias("left")).union(b.select("key", F.lit(0), F.lit(1), F.lit(0)))
        sizes = sizes.groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.max("left").alias("left"))
        # A rest of one letter is divided no further: the words of its group differ there only.
        crowded = c.stored(sizes.filter((F.col("a").cast("double") * F.col("b") > most) & (F.col("left") > 1)).select("key"))
        some = not crowded.isEmpty()
        side = F.broadcast(crowded) if some and c.fits_broadcast(crowded) else crowded
        x, y = (a.join(side, "key", "left_anti"), b.join(side, "key", "left_anti")) if some else (a, b)
        x = x.select("key", "word", "n")
        y = y.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
        pairs = x.join(y, "key").filter((F.length("other") > F.length("word")) | (F.col("other") > F.col("word")))
        pairs = pairs.filter(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n")
        met = pairs if met is None else met.union(pairs)
        if not some:
            break
        left, right = c.stored(a.join(side, "key", "left_semi")), c.stored(b.join(side, "key", "left_semi"))
    both = met.union(met.select("other", "other_n", "word", "n"))
    # Dealt by word once: finding repeats and gathering a word's few neighbours need no further shuffle.
    return both.repartition("word").dropDuplicates(["word", "other"])


def forms(words: DataFrame, ratio: int = RATIO, most: int = MOST_PAIRS) -> DataFrame:
    """``word, n, n_near, form, form_n`` of every word."""
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")))
    near = near_pairs(words, most).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    frequent = -F.col("best.n") >= ratio * F.col("n")
    return words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(frequent, F.col("best.word")).alias("form"), F.when(frequent, -F.col("best.n")).alias("form_n")
    )


def with_roots(formed: DataFrame) -> DataFrame:
    """``formed`` with the last word that following forms leads to.

    Counts grow along forms, so there are no circles; each round doubles the
    steps taken.  Only words that have a form take part.
    """
    steps = c.stored(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        taken = c.stored(steps.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        steps = taken.select("word", "root")
        if taken.filter("moved").isEmpty():
            break
    return formed.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, fewest: int = FEWEST, loss: int = LOSS, ratio: int = RATIO, most: int = MOST_PAIRS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs``."""
    words = c.stored(counted_words(docs, id_col, text_col, shortest, fewest, loss))
    formed = c.stored(forms(words, ratio, most))
    return with_roots(formed).select("word", "form", "root", "n", "n_near", "form_n")
