"""Operator 13, phrase collocation mining: multikey three-way quicksort of suffix pointers.

Texts (A-Z lower-cased) are cut into pieces at punctuation and line ends, pieces
into words at blanks; all counts are of one language.  Every place in a piece is a
suffix, looked at to a depth of ``longest`` words.

1. One scan counts the words, and the suffixes of each route; a route is a hash of
   a suffix's two leading words.
2. A second scan routes the suffixes: equal ones of a block of texts travel as one
   with their number, and those with the same two leading words meet in one task.
   A route that is too long for a task (one pair of words may hold a third of all
   places) is divided further by all words of the suffix; only its partial counts of
   shorter phrases are added up afterwards.
3. A task sorts the pointers of a route by three-way partitioning around a pivot
   word, all partitions in step.  The equal part of a partition shares one more
   word: its size is the count of that phrase, and it goes on with the next word.
   Parts with fewer than ``fewest`` places are abandoned at once.
4. Phrases are scored against their cuts by joins.

Words are 64-bit hashes until the end; the words table shows whether two words of
the corpus share one, and then another seed is taken, so counts are exact.

Edge cases: a null text is empty; a null language is ``und``; repeated rows count
one by one; very long texts are read whole, and pieces never reach across rows; of
the input only language and text are read, so other columns cannot clash; an empty
table gives an empty result.  Phrases with equal scores and counts stand in byte
order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopygrid.llm import common as c

LONGEST = 3
FEWEST = 10
#: A phrase goes if a longer one that holds it has at least this many hundredths of its places.
SHARE = 50
TOP = 2000
SCALE = 1_000_000
#: Bytes of text that a task looks at together.
CHUNK_BYTES = 4 << 20
#: Texts that a task looks at together, at most about.
CHUNK_TEXTS = 1 << 16
#: Bytes of text whose suffixes make one route.
ROUTE_BYTES = 8 << 20
#: Suffixes that one task sorts, about; a route of more than twice as many is divided.
ROUTE_ROWS = ROUTE_BYTES // 6
#: Classes by a hash of the leading words with which the sort of a route starts.
FIRST_CLASSES = 1 << 12
#: Pointers that are sorted together, about; classes are never cut.
STRIP_ROWS = 1 << 18
#: Parts that occur this often, as a share of all words, are few and travel by broadcast.
HOT_SHARE = 4096
#: Widest packed key of a suffix.
KEY_LIMIT = 1 << 62

BLANK = c.byte_set((0x20, 0x20), (0x09, 0x09))
BREAK = c.byte_set((0x0A, 0x0D), *((ord(x), ord(x)) for x in ".,;:!?"))
WORD = ~(BLANK | BREAK)


def _chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Languages, bytes and row offsets of about ``limit`` bytes of text (or one longer text) at a time."""
    langs, parts, sizes, held = [], [], [], 0
    for batch in batches:
        names = batch.column(0).to_pylist()
        for first, end, data, offsets in c.text_blocks(batch.column(1)):
            if (held and held + len(data) > limit) or len(langs) >= CHUNK_TEXTS:
                yield langs, np.concatenate(parts), np.r_[0, np.cumsum(np.concatenate(sizes))]
                langs, parts, sizes, held = [], [], [], 0
            langs += names[first:end]
            parts.append(c.LOWER[data])
            sizes.append(np.diff(offsets))
            held += len(data)
    if langs:
        yield langs, np.concatenate(parts), np.r_[0, np.cumsum(np.concatenate(sizes))]


class Tokens:
    """Words of a chunk as numbers of ``(language, word)`` pairs, and whether the next word follows in the piece."""

    def __init__(self, langs: list, data: np.ndarray, offsets: np.ndarray) -> None:
        flags = WORD[data]
        starts, ends = c.runs(flags, offsets)
        rows = c.row_of(starts, offsets)
        spots = pa.py_buffer(np.r_[0, np.cumsum(ends - starts)].astype(np.int64))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, spots, pa.py_buffer(data[flags])])
        words = words.dictionary_encode()
        spoken = pa.array(langs, pa.string()).dictionary_encode()
        width = len(words.dictionary)
        both = spoken.indices.to_numpy()[rows].astype(np.int64) * width + words.indices.to_numpy()
        pairs, codes, self.counts = np.unique(both, return_inverse=True, return_counts=True)
        self.codes = codes.astype(np.int32)
        self.langs = pc.take(spoken.dictionary, pa.array(pairs // max(width, 1)))
        self.words = pc.take(words.dictionary, pa.array(pairs % max(width, 1)))
        piece = np.searchsorted(np.flatnonzero(BREAK[data]), starts)
        self.goes_on = np.zeros(len(starts), dtype=bool)
        if len(starts):
            self.goes_on[:-1] = (rows[1:] == rows[:-1]) & (piece[1:] == piece[:-1])

    def ids(self, seed: int) -> np.ndarray:
        """The hash of each ``(language, word)``."""
        spoken = {lang: f"{len(lang)}:{lang}".encode() for lang in pc.unique(self.langs).to_pylist()}
        return np.array([xxhash.xxh3_64_intdigest(spoken[lang] + word, seed) for lang, word in zip(self.langs.to_pylist(), self.words.to_pylist(), strict=True)], dtype=np.uint64)

    def suffixes(self, longest: int) -> list[np.ndarray]:
        """Column ``d`` holds the number of the word ``d`` places on, plus one; 0 behind the end of the piece.  Only suffixes of two words or more."""
        inside = np.flatnonzero(self.goes_on)
        columns = [self.codes[inside] + 1]
        for depth in range(1, longest):
            there = np.minimum(inside + depth, len(self.codes) - 1)
            before = np.minimum(inside + depth - 1, len(self.codes) - 1)
            columns.append(np.where((columns[-1] > 0) & self.goes_on[before], self.codes[there] + 1, 0))
        return columns


def leading(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hash of two leading words."""
    return c.mix(first * c.P + second)


def packed(columns: list[np.ndarray], width: int, limit: int = KEY_LIMIT) -> np.ndarray:
    """One number for each row, equal exactly where all columns are; columns hold less than ``width``."""
    key, span = columns[0].astype(np.int64), width
    for column in columns[1:]:
        if span * width > limit:
            _, key = np.unique(key, return_inverse=True)
            span = len(key)
        key, span = key * width + column, span * width
    return key


def _counted(batches: Iterator[pa.RecordBatch], routes: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Counts of words (with their ids) and of the suffixes of routes."""
    sizes = np.zeros(0, dtype=np.int64)
    seen: dict[int, int] = {}
    names = ["lang", "word", "id", "route", "n"]
    for langs, data, offsets in _chunks(batches):
        t = Tokens(langs, data, offsets)
        ids = t.ids(seed)
        if len(ids):
            nothing = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([t.langs, t.words.cast(pa.large_string()).cast(pa.string()), pa.array(ids.view(np.int64)), nothing, pa.array(t.counts)], names=names)
        found = leading(ids[t.codes[:-1]], ids[t.codes[1:]])[t.goes_on[:-1]] % np.uint64(routes)
        at, sizes = np.unique(found, return_counts=True)
        for route, n in zip(at.tolist(), sizes.tolist(), strict=True):
            seen[route] = seen.get(route, 0) + n
    none = pa.nulls(len(seen))
    yield pa.RecordBatch.from_arrays([none.cast(pa.string()), none.cast(pa.string()), none.cast(pa.int64()), pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=names)


def _smallest(values: np.ndarray) -> np.ndarray:
    """The values in as few bytes each as they need."""
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


def _blocks(batches: Iterator[pa.RecordBatch], routes: int, divided: dict[int, int], longest: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Different suffixes of each chunk with their numbers, a row for each route: words' ids, then columns of places among them, then numbers."""
    for langs, data, offsets in _chunks(batches):
        t = Tokens(langs, data, offsets)
        columns = t.suffixes(longest)
        if not len(columns[0]):
            continue
        key = packed(columns, len(t.counts) + 1)
        order = np.argsort(key, kind="stable")
        firsts = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        numbers = np.diff(np.r_[firsts, len(order)])
        columns = [x[order[firsts]] for x in columns]
        ids = np.r_[np.uint64(0), t.ids(seed)]
        head = leading(ids[columns[0]], ids[columns[1]])
        route = (head % np.uint64(routes)).astype(np.int64)
        part = np.zeros(len(route), dtype=np.int64)
        if divided:
            whole = head
            for column in columns[2:]:
                whole = leading(whole, ids[column])
            keys = np.array(sorted(divided))
            at = np.minimum(np.searchsorted(keys, route), len(keys) - 1)
            parts = np.where(keys[at] == route, np.array([divided[k] for k in keys.tolist()])[at], 1)
            part = (whole % parts.astype(np.uint64)).astype(np.int64)
        place = np.lexsort((part, route))
        cuts = np.flatnonzero(np.r_[True, (np.diff(route[place]) != 0) | (np.diff(part[place]) != 0), True])
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            here = place[a:b]
            used, local = np.unique(np.concatenate([x[here] for x in columns]), return_inverse=True)
            local = _smallest(local)
            n = _smallest(numbers[here])
            out.append((int(route[here[0]]), int(part[here[0]]), ids[used].tobytes(), local.itemsize, local.tobytes(), n.itemsize, n.tobytes()))
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]
        # A few rows at a time, since each holds many suffixes.
        for a in range(0, len(out), 16):
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out[a : a + 16], strict=True), kinds, strict=True)], names=["route", "part", "ids", "wide", "places", "broad", "numbers"])


def quicksorted(columns: np.ndarray, numbers: np.ndarray, fewest: int, classes: np.ndarray, whole: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Phrases of pointers: ``depth, pointers, counts``, one pointer into the columns for each phrase of ``depth`` words.

    Column ``d`` of pointer ``i`` is its word ``d`` (0: none).  Pointers start in
    the partitions that ``classes`` names; equal leading words must share one.  Every round
    cuts each partition in three around the word of one of its pointers.  Parts
    with fewer than ``fewest`` places go; without ``whole``, only those at full depth.
    """
    longest = len(columns)
    order = np.argsort(classes, kind="stable")
    _, part = np.unique(classes[order], return_inverse=True)
    depth = np.zeros(int(part[-1]) + 1 if len(part) else 0, dtype=np.int64)
    least = np.where(np.arange(longest + 1) < longest, fewest if whole else 1, fewest)
    turn = 0
    while len(order):
        sizes = np.bincount(part, minlength=len(depth))
        ends = np.cumsum(sizes)
        keys = columns[depth[part], order]
        # The middle pointer, then others: a fixed sequence of places that no order of the input meets for long.
        middle = ends - sizes + (sizes * (0.5 + turn * 0.618033988749895) % sizes).astype(np.int64)
        turn += 1
        pivots = keys[middle][part]
        pieces, depths = [], []
        count = 0
        for side in (-1, 0, 1):
            at = np.flatnonzero(keys < pivots if side < 0 else keys > pivots if side > 0 else keys == pivots)
            pointers, mine = order[at], part[at]
            if not len(at):
                continue
            level = depth + (side == 0)
            totals = np.bincount(mine, weights=numbers[pointers], minlength=len(depth))
            if side == 0:
                heads = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
                some = totals[mine[heads]] >= least[level[mine[heads]]]
                for d in range(2, longest + 1):
                    named = heads[some & (level[mine[heads]] == d)]
                    if len(named):
                        yield d, pointers[named], totals[mine[named]].astype(np.int64)
                going = level[mine] < longest
                following = columns[np.minimum(level[mine], longest - 1), pointers]
                going &= following > 0
                pointers, mine = pointers[going], mine[going]
                totals = np.bincount(mine, weights=numbers[pointers], minlength=len(depth))
            # Below full depth, a part can only hold phrases as frequent as itself.
            enough = totals[mine] >= (fewest if whole else 1)
            pointers, mine = pointers[enough], mine[enough]
            if not len(pointers):
                continue
            starts = np.r_[True, mine[1:] != mine[:-1]]
            pieces.append((pointers, np.cumsum(starts) - 1 + count))
            depths.append(level[mine[starts]])
            count += len(depths[-1])
        order = np.concatenate([p for p, _ in pieces]) if pieces else np.zeros(0, dtype=np.int64)
        part = np.concatenate([s for _, s in pieces]) if pieces else np.zeros(0, dtype=np.int64)
        depth = np.concatenate(depths) if depths else np.zeros(0, dtype=np.int64)


def _mined(blocks: list[tuple], longest: int, fewest: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """Phrases of one route (or of a part of one)."""
    ids = c.distinct(np.concatenate([np.zeros(1, dtype=np.uint64), *(np.frombuffer(b[2], dtype=np.uint64) for b in blocks)]))
    sizes = [len(b[6]) // b[5] for b in blocks]
    table, numbers = np.empty((longest, sum(sizes)), dtype=np.int32), np.empty(sum(sizes), dtype=np.int64)
    at = 0
    for (_, _, held, wide, places, broad, n), size in zip(blocks, sizes, strict=True):
        code = np.searchsorted(ids, np.frombuffer(held, dtype=np.uint64)).astype(np.int32)
        table[:, at : at + size] = code[np.frombuffer(places, dtype=f"u{wide}")].reshape(longest, -1)
        numbers[at : at + size] = np.frombuffer(n, dtype=f"u{broad}")
        at += size
    classes = ((leading(ids[table[0]], ids[table[1]]) >> np.uint64(40)) % np.uint64(FIRST_CLASSES)).astype(np.int16)
    order = np.argsort(classes, kind="stable")
    heads = np.flatnonzero(np.r_[True, np.diff(classes[order]) != 0])
    cuts = np.unique(np.r_[heads[np.searchsorted(heads, np.arange(0, len(order), STRIP_ROWS)).clip(max=len(heads) - 1)], len(order)])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        some = order[a:b]
        columns = table[:, some]
        for depth, pointers, totals in quicksorted(columns, numbers[some], fewest, classes[some], whole):
            words = ids[columns[:depth, pointers].T.reshape(-1)].view(np.int64)
            spots = np.arange(0, len(words) + 1, depth, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(spots), pa.array(words)), pa.array(totals)], names=["gram", "f"])


def _sorted_routes(batches: Iterator[pa.RecordBatch], divided: set[int], longest: int, fewest: int) -> Iterator[pa.RecordBatch]:
    """Mine the routes of a partition, which come one after another."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if held and held[0][:2] != row[:2]:
                yield from _mined(held, longest, fewest, held[0][0] not in divided)
                held = []
            held.append(row)
    if held:
        yield from _mined(held, longest, fewest, held[0][0] not in divided)


def _spoken(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))


def word_counts(texts: DataFrame, routes: int) -> tuple[DataFrame, DataFrame, int]:
    """``lang, word, id, n`` of all words, ``route, n`` of all routes, and the seed with which ids are free of collisions."""
    seed = 0
    while True:
        rows = texts.mapInArrow(lambda batches, seed=seed: _counted(batches, routes, seed), "lang string, word string, id long, route long, n long")
        counts = c.stored(rows.groupBy("lang", "word", "id", "route").agg(F.sum("n").alias("n")))
        words = counts.filter("word IS NOT NULL").select("lang", "word", "id", "n")
        # 0 stands for the end of a piece.
        if words.groupBy("id").count().filter("count > 1 OR id = 0").isEmpty():
            return words, counts.filter("word IS NULL").select("route", "n"), seed
        seed += 1


def phrases(texts: DataFrame, routes: int, sizes: DataFrame, seed: int, longest: int = LONGEST, fewest: int = FEWEST, rows: int = ROUTE_ROWS) -> DataFrame:
    """``gram, f`` of every phrase of 2 to ``longest`` words with at least ``fewest`` places."""
    # Only routes that are too long are listed: never more than one for each ``2 * rows`` suffixes.
    divided = {r["route"]: math.ceil(r["n"] / rows) for r in sizes.filter(F.col("n") > 2 * rows).toLocalIterator()}
    long = set(divided)
    sent = texts.mapInArrow(lambda batches: _blocks(batches, routes, divided, longest, seed), "route long, part long, ids binary, wide int, places binary, broad int, numbers binary")
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(routes + sum(divided.values()), 100_000))
    met = sent.repartition(parts, "route", "part").sortWithinPartitions("route", "part")
    found = met.mapInArrow(lambda batches: _sorted_routes(batches, long, longest, fewest), "gram array<long>, f long")
    return found.groupBy("gram").agg(F.sum("f").alias("f")).filter(F.col("f") >= fewest)


def _looked_up(rows: DataFrame, key: str, side: DataFrame, hot: DataFrame, values: list[str]) -> DataFrame:
    """``rows`` with the values of ``side`` (unique by ``key``); keys of ``hot``, a bounded part of ``side``, are looked up by broadcast.

    Where a hot key has answered, the row goes to the shuffle under a key of its
    own, so no task gets the rows of a frequent part.
    """
    near = F.broadcast(hot.select(F.col(key), F.struct(*values).alias("_hot")))
    rows = rows.join(near, key, "left")
    alone = F.array(F.xxhash64(*rows.columns), F.lit(-1).cast("long"), F.lit(-1).cast("long"), F.lit(-1).cast("long"))
    far = side.select(F.col(key).alias("_key"), F.struct(*values).alias("_far"))
    rows = rows.withColumn("_own", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(alone))
    rows = rows.join(far, F.col("_own") == F.col("_key"), "left").withColumn("_value", F.coalesce("_hot", "_far"))
    return rows.select("*", *(F.col(f"_value.{v}").alias(v) for v in values)).drop("_hot", "_far", "_key", "_own", "_value")


def _exact_score(a: Column, left: Column, right: Column) -> Column:
    """``floor(SCALE * a * a / (left * right))``, in whole numbers of up to 38 digits."""
    big = lambda x: x.cast("decimal(19,0)")
    top = (big(a) * big(a)).cast("decimal(31,0)") * F.lit(SCALE).cast("decimal(7,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), (big(left) * big(right)).cast("decimal(38,0)"))


def _first_rows(df: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group with their ``rank``, chosen in shares of the group first."""
    shares = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.withColumn("_share", F.pmod(F.xxhash64("gram"), F.lit(shares)))
    df = df.withColumn("_place", F.row_number().over(Window.partitionBy(group, "_share").orderBy(*order))).filter(F.col("_place") <= most).drop("_place", "_share")
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).filter(F.col("rank") <= most)


def mine(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, fewest: int = FEWEST, share: int = SHARE, top: int = TOP, route_bytes: int = ROUTE_BYTES, route_rows: int = ROUTE_ROWS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's first ``top`` phrases."""
    c.small_batches(docs.sparkSession)
    texts = _spoken(docs, lang_col, text_col)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    routes = max(1, math.ceil(size / route_bytes))
    words, sizes, seed = word_counts(texts, routes)
    spoken = c.stored(words.groupBy("lang").agg(F.sum("n").alias("n")))
    total = spoken.agg(F.sum("n")).first()[0] or 0
    grams = c.stored(phrases(texts, routes, sizes, seed, longest, fewest, route_rows))
    alone = words.filter(F.col("n") >= fewest).select(F.array("id").alias("gram"), F.col("n").alias("f"), "lang")
    parts = alone.union(grams.filter(F.size("gram") < longest).select("gram", "f", F.lit(None).cast("string")))
    # Each of the longest - 1 lengths has at most HOT_SHARE of these.
    hot = c.stored(parts.filter(F.col("f") >= max(fewest, math.ceil(total / HOT_SHARE))))

    cuts = grams.select("gram", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("gram") - 1)).alias("k"))
    sides = [("l", F.slice("whole", F.lit(1), F.col("k"))), ("r", F.slice("whole", F.col("k") + 1, F.size("whole")))]
    cuts = cuts.withColumnRenamed("gram", "whole")
    for name, piece in sides:
        values = parts.select("gram", F.col("f").alias(name), F.col("lang").alias(f"lang_{name}"))
        cuts = _looked_up(cuts.withColumn("gram", piece), "gram", values, hot.select("gram", F.col("f").alias(name), F.col("lang").alias(f"lang_{name}")), [name, f"lang_{name}"]).drop("gram")
    cuts = cuts.withColumn("score", _exact_score(F.col("a"), F.col("l"), F.col("r")))
    scored = cuts.groupBy(F.col("whole").alias("gram"), "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.max("lang_l").alias("lang"))

    inner = grams.filter(F.size("gram") > 2).select("f", "gram", F.explode(F.sequence(F.lit(2), F.size("gram") - 1)).alias("size"))
    inner = inner.select("f", "gram", "size", F.explode(F.sequence(F.lit(1), F.size("gram") - F.col("size") + 1)).alias("start"))
    longer = inner.groupBy(F.slice("gram", F.col("start"), F.col("size")).alias("gram")).agg(F.max("f").alias("longer"))
    left = scored.join(longer, "gram", "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    left = left.select("gram", "lang", "a", "cut.l", "cut.r", "cut.score")

    # Words are needed for phrases that can still be among the first: all that tie with the last one of their share stay.
    shares = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(shares))).orderBy(F.desc("score"), F.desc("a"))
    short = c.stored(left.withColumn("place", F.rank().over(by)).filter(F.col("place") <= top).drop("place"))
    spelled = short.select(F.col("gram").alias("whole"), F.posexplode("gram").alias("at", "id"))
    named = words.filter(F.col("n") >= fewest).select(F.array("id").alias("gram"), "word", "n")
    common = named.filter(F.col("n") >= math.ceil(total / HOT_SHARE))
    spelled = _looked_up(spelled.withColumn("gram", F.array("id")), "gram", named, common, ["word"])
    spelled = spelled.groupBy(F.col("whole").alias("gram")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    first = _first_rows(short.join(spelled, "gram"), "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return first.join(spoken, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
