"""Operator 10, best-fit packing: bin completion branch-and-bound over the histogram of lengths.

Every document is tokenized, ends with a separator id, and is cut into pieces
only where it is longer than a sequence.  All pieces of one length are
interchangeable, so the plan is made on the histogram of lengths, which has at most
``capacity`` rows however many documents there are.

* The incumbent is best-fit decreasing.
* Bin completion takes the longest piece left, enumerates the undominated
  fillings of the room beside it (a filling is dominated when its pieces fit into the
  pieces of another), least waste first, and uses a filling as often as the counts
  allow, or once.  A branch ends when its sequences and the least number that the
  rest needs (its total, or pieces of which no two fit together) reach the incumbent.
* A filling holds as many pieces as fit: one that the enumeration leaves open is
  completed, largest pieces first.
* The search ends when a plan meets the lower bound, or after ``DIVES`` steps for each
  distinct length (``SEARCH_NODES`` at least; a way down to a first whole plan takes
  more than one for each) with the best plan so far; every plan places every piece.

Spark then numbers the pieces of each length, in salted groups of about
``GROUP_ROWS``, so a hot length is spread over tasks, and each number takes its place in the plan.

Tokens of ASCII stretches between which the tokenizer always separates are looked
up in a table that each worker fills by calling the tokenizer; texts that contain one of
its special tokens are handed to it as a whole.

Edge cases: a null or empty text is the separator alone; repeated rows are documents
of their own; rows without an id are packed too; other columns are ignored, so their
names cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopygrid.llm import common as c

CAPACITY = 4096
SEPARATOR = 1
#: Steps of the search: at least, and for each distinct length.
SEARCH_NODES, DIVES = 3000, 4
#: Fillings tried for one piece, at most.
WIDTH = 12
#: Pieces of one length that one task numbers, about.
GROUP_ROWS = 65_536
#: Entries of a worker's table of tokens, at most (it starts again when full).
TABLE_ROWS = 2_000_000

#: Kinds of bytes of lower-cased text: 0 white space, 1 letter, 2 digit, 3 sign, 4 not to be cut from its neighbours.
_KIND = np.full(256, 4, dtype=np.uint8)
_KIND[c.byte_set((9, 13), (32, 32))] = 0
_KIND[c.byte_set((97, 122))] = 1
_KIND[c.byte_set((48, 57))] = 2
_KIND[c.byte_set((33, 38), (40, 47), (58, 64), (91, 96), (123, 126))] = 3


def _kinds(lowered: np.ndarray) -> np.ndarray:
    """Kinds of bytes; the Latin letters U+00C0 to U+024F are letters, without the signs U+00D7 and U+00F7 and without
    U+0130, which the tokenizer takes for a letter and a sign."""
    kind = _KIND[lowered]
    lead = np.flatnonzero((lowered[:-1] >= 0xC3) & (lowered[:-1] <= 0xC9))
    follow = lowered[lead + 1]
    first = lowered[lead]
    lead = lead[((first != 0xC3) | ((follow != 0x97) & (follow != 0xB7))) & ((first != 0xC4) | (follow != 0xB0))]
    kind[lead] = kind[lead + 1] = 1
    return kind


class Encoder:
    """Ids of blocks of texts."""

    def __init__(self, path: str, separator: int = SEPARATOR) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.separator = separator
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.places = np.zeros(0, dtype=np.int64)
        # Entry 0 is the separator.
        self.starts, self.counts, self.ids = np.zeros(1, dtype=np.int64), np.ones(1, dtype=np.int64), np.array([self.separator], dtype=np.uint32)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        done = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(done.ids, dtype=np.uint32)
        counts = np.bincount(np.array(done.word_ids, dtype=np.int64), minlength=len(words)) if len(ids) else np.zeros(len(words), dtype=np.int64)
        first = len(self.counts)
        self.starts = np.r_[self.starts, len(self.ids) + np.r_[0, np.cumsum(counts)[:-1]].astype(np.int64)]
        self.counts, self.ids = np.r_[self.counts, counts], np.r_[self.ids, ids]
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.places = np.insert(self.hashes, at, hashes), np.insert(self.places, at, first + np.arange(len(hashes)))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids (each text ends with the separator), and where each text's begin (one more than texts)."""
        rows = len(offsets) - 1
        lowered = c.LOWER[data]
        kind = _kinds(lowered)
        solid = kind > 0
        if len(data):
            before, after = kind[:-1], kind[1:]
            cut = np.r_[True, (before == 0) | ((before != after) & (before < 4) & (after < 4)) | ((before == 2) & (after == 2))]
            cut[offsets[(offsets > 0) & (offsets < len(data))]] = True
            starts = np.flatnonzero(cut & solid)
            ends = np.flatnonzero(np.r_[(cut | ~solid)[1:], True] & solid) + 1
        else:
            starts = ends = np.zeros(0, dtype=np.int64)
        found, first, which = np.unique(c.Hasher(lowered).ranges(starts, ends), return_index=True, return_inverse=True)
        new = np.flatnonzero(~c.among(found, self.hashes))
        if len(self.counts) + len(new) > TABLE_ROWS:
            self.clear()
            new = np.arange(len(found))
        if len(new):
            self._learn(found[new], [lowered[starts[i] : ends[i]].tobytes().decode() for i in first[new].tolist()])
        entry = self.places[np.searchsorted(self.hashes, found)][which] if len(found) else np.zeros(0, dtype=np.int64)
        edges = np.searchsorted(c.row_of(starts, offsets), np.arange(rows + 1))
        entry = np.insert(entry, edges[1:], 0)
        counts = self.counts[entry]
        ends_of = np.cumsum(counts)
        flat = self.ids[np.repeat(self.starts[entry] - (ends_of - counts), counts) + np.arange(int(ends_of[-1]) if rows else 0)]
        bounds = np.r_[0, ends_of][np.r_[0, edges[1:] + np.arange(1, rows + 1)]]
        text = data.tobytes() if any(len(s) <= len(data) for s in self.special) else b""
        odd = sorted({int(c.row_of(np.array([i]), offsets)[0]) for s in self.special for i in _find(text, s)})
        if odd:
            parts = [flat[a:b] for a, b in pairwise(bounds)]
            for i in odd:
                whole = text[offsets[i] : offsets[i + 1]].decode()
                parts[i] = np.array([*self.tokenizer.encode(whole, add_special_tokens=False).ids, self.separator], dtype=np.uint32)
            flat, bounds = np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]
        return flat, bounds


def _find(text: bytes, part: bytes):
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + 1)


def worker_encoder(path: str, separator: int) -> Encoder:
    """One encoder for each worker process, so later tasks find its table filled."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_canopygrid_encoders", {})
    if (path, separator) not in kept:
        kept[path, separator] = Encoder(path, separator)
    return kept[path, separator]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, separator: int = SEPARATOR, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of every piece."""
    c.small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        encoder = worker_encoder(tokenizer_path, separator)
        for batch in batches:
            for first, end, data, offsets in c.text_blocks(batch.column("text")):
                flat, bounds = encoder.encode(data, offsets)
                owner, piece, start, length, crc, ids = [], [], [], [], [], []
                for i in range(end - first):
                    for k, a in enumerate(range(int(bounds[i]), int(bounds[i + 1]), capacity)):
                        part = flat[a : min(a + capacity, int(bounds[i + 1]))]
                        owner.append(first + i)
                        piece.append(k)
                        start.append(k * capacity)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.astype("<u4", copy=False).data))
                        if with_ids:
                            ids.append(part.astype(np.int32))
                columns = [batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(c.releasing(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


Plan = list[tuple[tuple[int, ...], int]]


def best_fit(histogram: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing: lengths of a sequence, and how many sequences have them."""
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:
                # New sequences take as many pieces of this length as fit.
                fit = min(capacity // length, left)
                rooms.setdefault(capacity - fit * length, []).append(((length,) * fit, left // fit))
                left -= left // fit * fit
                continue
            held, times = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
            fit = min(room // length, left)
            used = min(times, left // fit)
            if times > used:
                rooms.setdefault(room, []).append((held, times - used))
            rooms.setdefault(room - fit * length, []).append((held + (length,) * fit, used))
            left -= used * fit
    return [entry for entries in rooms.values() for entry in entries]


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """Sequences that any plan needs: by the total, and by long pieces with the rest that no room beside them takes."""
    total = sum(k * v for k, v in histogram.items())
    best = -(-total // capacity)
    ordered = sorted(histogram)
    for small in [0, *(k for k in ordered if 2 * k <= capacity)]:
        large = sum(histogram[k] for k in ordered if k > capacity - small)
        middle = [(k, histogram[k]) for k in ordered if 2 * k > capacity and k <= capacity - small]
        count = sum(v for _, v in middle)
        rest = sum(k * histogram[k] for k in ordered if small <= k and 2 * k <= capacity)
        room = count * capacity - sum(k * v for k, v in middle)
        best = max(best, large + count + max(0, -(-(rest - room) // capacity)))
        if len(ordered) > 256:
            break
    return best


def _dominated(one: tuple[int, ...], other: tuple[int, ...]) -> bool:
    """Whether the pieces of ``one`` fit into the pieces of ``other`` (first fit)."""
    if len(other) > len(one) or one == other:
        return False
    rooms = list(other)
    for x in one:
        for i, room in enumerate(rooms):
            if room >= x:
                rooms[i] -= x
                break
        else:
            return False
    return True


class Completion:
    """Bin completion over counts of lengths."""

    def __init__(self, histogram: dict[int, int], capacity: int, nodes: int) -> None:
        self.capacity, self.nodes = capacity, nodes
        self.counts = np.zeros(capacity + 1, dtype=np.int64)
        for length, count in histogram.items():
            self.counts[length] = count
        self.goal = lower_bound(histogram, capacity)
        self.best = best_fit(histogram, capacity)
        self.least = sum(times for _, times in self.best)
        #: Whole plans that the search found, each better than the one before.
        self.completed = 0

    def _filled(self, held: tuple[int, ...], room: int) -> tuple[int, ...]:
        """``held`` with the largest pieces that still fit, until none does."""
        out, left = list(held), room - sum(held)
        top = left
        while top > 0:
            fits = np.flatnonzero(self.counts[1 : top + 1])
            if not len(fits):
                break
            x = int(fits[-1]) + 1
            more = min(left // x, int(self.counts[x]) - held.count(x))
            out += [x] * max(more, 0)
            left -= x * max(more, 0)
            top = min(left, x - 1)
        return tuple(sorted(out, reverse=True))

    def fillings(self, room: int) -> list[tuple[int, ...]]:
        """Undominated fillings of a room, least waste first, at most ``WIDTH``."""
        have = np.where(self.counts > 0)[0]
        have = have[have <= room]
        if not len(have):
            return [()]
        floor = np.maximum.accumulate(np.where(self.counts > 0, np.arange(self.capacity + 1), 0))
        found = {(int(have[-1]),)}
        second = np.minimum(floor[room - have], floor[have])
        twice = (second == have) & (self.counts[have] < 2)
        second = np.where(twice, floor[np.maximum(have - 1, 0)], second)
        pairs = np.flatnonzero((second > 0) & (have + second > have[-1]))
        for i in pairs[np.argsort(-(have + second)[pairs], kind="stable")][:WIDTH].tolist():
            found.add((int(have[i]), int(second[i])))
        if max(map(sum, found)) < room:
            spent = 0
            stack: list[tuple[tuple[int, ...], int]] = [((), room)]
            while stack and spent < 6 * WIDTH:
                held, left = stack.pop()
                spent += 1
                top = held[-1] if held else room
                options = have[(have <= left) & (have <= top)]
                if held:
                    options = options[[self.counts[x] > held.count(x) for x in options.tolist()]] if len(options) < 64 else options[self.counts[options] > (options == top) * held.count(top)]
                if not len(options):
                    if held:
                        found.add(held)
                    continue
                for x in options[-6:].tolist():
                    stack.append(((*held, int(x)), left - int(x)))
        found = {self._filled(f, room) if sum(f) < room else f for f in found}
        kept = [f for f in found if all(self.counts[x] >= f.count(x) for x in f) and not any(_dominated(f, o) for o in found)]
        return sorted(kept, key=lambda f: (-sum(f), len(f), [-x for x in f]))[:WIDTH] or [()]

    def branches(self):
        """Ways to use the longest piece left: pieces of a sequence, and how many such sequences."""
        longest = int(np.flatnonzero(self.counts)[-1])
        self.counts[longest] -= 1
        fillings = self.fillings(self.capacity - longest)
        self.counts[longest] += 1
        for filling in fillings:
            whole = (longest, *filling)
            most = min(int(self.counts[x]) // whole.count(x) for x in set(whole))
            yield whole, most
            if most > 1:
                yield whole, 1

    def run(self) -> Plan:
        left = int((np.arange(self.capacity + 1) * self.counts).sum())
        if self.least == self.goal or not left:
            return self.best
        path: list[tuple[tuple[int, ...], int]] = []
        open_branches = [self.branches()]
        used = spent = 0
        while open_branches and spent < self.nodes:
            step = next(open_branches[-1], None)
            if step is None:
                open_branches.pop()
                if path:
                    pieces_, times = path.pop()
                    np.add.at(self.counts, list(pieces_), times)
                    left += sum(pieces_) * times
                    used -= times
                continue
            spent += 1
            pieces_, times = step
            if used + times + -(-(left - sum(pieces_) * times) // self.capacity) >= self.least:
                continue
            np.subtract.at(self.counts, list(pieces_), times)
            path.append(step)
            left -= sum(pieces_) * times
            used += times
            if left == 0:
                self.best, self.least = list(path), used
                self.completed += 1
                if self.least == self.goal:
                    break
                open_branches.append(iter(()))
            else:
                open_branches.append(self.branches())
        return self.best


def budget(histogram: dict[int, int]) -> int:
    """Steps of the search; at most ``capacity`` lengths are distinct."""
    return max(SEARCH_NODES, DIVES * len(histogram))


def plan(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int | None = None) -> Plan:
    """Sequences that hold every piece of the histogram."""
    histogram = {k: v for k, v in histogram.items() if v > 0}
    return Completion(histogram, capacity, budget(histogram) if nodes is None else nodes).run()


def pack(parts: DataFrame, capacity: int = CAPACITY, nodes: int | None = None) -> DataFrame:
    """Rows of ``parts`` (with ``doc_id, piece, length``) with ``sequence_id, offset``."""
    spark = parts.sparkSession
    parts = c.stored(parts)
    # At most ``capacity`` rows.
    sizes = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    rows: list[tuple[int, int, int, int, int]] = []
    given = dict.fromkeys(sizes, 0)
    sequence = 0
    for lengths, times in plan(sizes, capacity, nodes):
        place = 0
        for length in lengths:
            rows.append((length, given[length], sequence, place, times))
            given[length] += times
            place += length
        sequence += times
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(table)

    def place_all(batches):
        table = shared.value
        keys = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (batch.schema.get_field_index("length"), batch.schema.get_field_index("__rank")))
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            added = [pa.array(table[at, 2] + rank - table[at, 1]), pa.array(table[at, 3])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    groups = F.create_map(*[F.lit(x) for k, v in sizes.items() if v > GROUP_ROWS for x in (k, 1 + v // GROUP_ROWS)]) if any(v > GROUP_ROWS for v in sizes.values()) else None
    salts = F.coalesce(groups[F.col("length")], F.lit(1)) if groups is not None else F.lit(1)
    salted = parts.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), salts))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "__salt").count().select("length", "__salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("__inside", F.row_number().over(inside) - 1).join(starts, ["length", "__salt"])
    ranked = ranked.select(*parts.columns, (F.col("__before") + F.col("__inside")).cast("long").alias("__rank"))
    schema = parts.withColumn("sequence_id", F.lit(None).cast("long")).withColumn("offset", F.lit(None).cast("long")).schema
    return ranked.mapInArrow(c.releasing(place_all), schema)
