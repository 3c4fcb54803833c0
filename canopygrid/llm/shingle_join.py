"""Operator 5, n-gram Jaccard join: PartEnum signatures, verified exactly, as connected components.

Texts are lower-cased (A-Z) and cut into words; a document's set has its distinct
shingles of ``WIDTH`` words as 64-bit hashes (with fewer words, the whole
sequence; without words, nothing, and such a document links with none).  Two sets link when
``intersection / union >= 3 / 4``.

* Sets of sizes ``a <= b`` can only link when ``b <= 4a / 3`` and their symmetric
  difference has at most ``(a + b) / 7`` elements.  Sizes fall into bands of
  ratio 4/3, so a pair lies in one band or in neighbouring ones.
* For each band the feature domain is dealt into ``n1`` parts.  With at most ``k``
  differences, at most ``k`` parts differ, so any ``k + 1`` parts hold an equal
  one.  A signature is the content of one part.  Every set enumerates, for its
  band and the next larger one, ``k + 1`` of its ``n1`` parts, in one order that
  all sets share (fullest parts first, empty ones last): the first equal part of
  a linking pair is then enumerated by both.
* Shingles that are common in a bounded sample (license lines, passages that
  many documents share) would give many documents one signature.  The parts are
  therefore dealt over the other shingles; sets with too few of those to fill
  ``k + 1`` parts enumerate parts of the whole domain too.  Which shingles the sample
  finds changes how much work there is, never the result.
* Signatures are shuffled as packed blocks.  Sets that share one are grouped.
  Each set is verified against one other set of its groups; connected
  components contract; pairs of a group that are still in different components
  are verified when their parity sketches do not exclude them.  So a group of many
  near copies costs about one comparison a member, and no link between components
  is lost.

Equal sets are one node, so copies need no comparison.  Nodes are 64-bit
fingerprints of sets.

Edge cases: a null text is empty; rows without an id take part (a component of such
rows only has a null id); rows that repeat an id or a text each stay; other columns
are ignored, so their names cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopygrid.llm import common as c
from canopygrid.llm.graph import components

WIDTH = 5
#: Parts of the domain for each element of the largest set of a band.
PARTS = 0.45
#: Signatures of one packed block, and of one bucket, about: a task looks at one bucket at a time.
BLOCK_SIGNATURES, BUCKET_SIGNATURES = 1 << 19, 1 << 18
#: Documents of the sample that finds common shingles, about; their least count there; and how many are kept at most.
SAMPLE_DOCS, SAMPLE_COUNT, COMMON_ROWS = 8192, 2, 1 << 18
#: Bits of the parity sketch that excludes pairs, at least.
SKETCH_BITS = 1024
#: Members of the groups of one hub that one task holds, about.
PART_MEMBERS = 20_000
_SPACE = c.byte_set((9, 13), (32, 32))
_PART_SEED = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    for first, end, data, offsets in c.text_blocks(texts):
        data = c.LOWER[data]
        starts, ends = c.runs(~_SPACE[data], offsets)
        tokens = c.Hasher(data).ranges(starts, ends)
        edges = np.searchsorted(c.row_of(starts, offsets), np.arange(end - first + 1))
        shingles = c.rolling(tokens, width)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a >= width:
                yield c.distinct(shingles[a : b - width + 1])
            else:
                yield c.rolling(tokens[a:b], b - a) if b > a else np.zeros(0, dtype=np.uint64)


def fingerprint(shingles: np.ndarray) -> int:
    """Signed 64-bit number of a set."""
    total = c.mix(shingles ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(c.mix(np.array([total]))[0].view(np.int64))


def band_edges(largest: int) -> np.ndarray:
    """Smallest sizes of the bands, until beyond ``largest`` by two bands."""
    edges = [1]
    while edges[-1] <= largest:
        edges.append(4 * edges[-1] // 3 + 1)
    edges += [4 * edges[-1] // 3 + 1]
    return np.array([*edges, 4 * edges[-1] // 3 + 1])


_EDGES = band_edges(1 << 40)


def _enumerate(shingles: np.ndarray, mixed: np.ndarray, band: int, most: int, empties: bool, seed: int) -> np.ndarray:
    """The first ``most`` parts of a set for a band, as signatures."""
    parts = np.uint64(int(PARTS * (_EDGES[band + 1] - 1)) + 2)
    part = ((shingles >> np.uint64(32)) * parts) >> np.uint64(32)
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, dtype=np.int64)
    tag = c.mix(np.array([band * 4 + seed], dtype=np.uint64))
    content = np.add.reduceat(mixed, starts) if len(starts) else np.zeros(0, dtype=np.uint64)
    filled = part[starts]
    signatures = c.mix(content + c.mix(filled + tag))
    if len(signatures) > most:
        counts = np.minimum(np.diff(np.r_[starts, len(part)]), 65535).astype(np.uint64)
        order = ((np.uint64(65535) - counts) << np.uint64(48)) | (signatures >> np.uint64(16))
        return signatures[np.argpartition(order, most - 1)[:most]]
    if empties and len(signatures) < most:
        empty = np.setdiff1d(np.arange(int(parts), dtype=np.uint64), filled, assume_unique=True)
        none = c.mix(c.mix(empty + tag))
        return np.r_[signatures, np.sort(none)[: most - len(signatures)]]
    return signatures


def signatures(shingles: np.ndarray, common: np.ndarray, is_common: np.ndarray) -> np.ndarray:
    """All signatures that one set enumerates."""
    size = len(shingles)
    band = int(np.searchsorted(_EDGES, size, side="right")) - 1
    rare = shingles
    if len(common):
        maybe = np.flatnonzero(is_common[shingles & np.uint64(len(is_common) - 1)])
        rare = np.delete(shingles, maybe[c.among(shingles[maybe], common)]) if len(maybe) else shingles
    mixed = c.mix(rare * _PART_SEED)
    largest = 4 * size // 3
    out = []
    for b in (band, band + 1):
        if b > band and largest < _EDGES[b]:
            continue
        most = int(size + (min(largest, _EDGES[b + 1] - 1) if b == band else largest)) // 7 + 1
        found = _enumerate(rare, mixed, b, most, len(common) == 0, 0)
        out.append(found)
        if len(common) and len(found) < most:
            out.append(_enumerate(shingles, c.mix(shingles * _PART_SEED), b, most, True, 1))
    return np.concatenate(out)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_shingles, node, place`` of each row; ``place`` is a hash of the text."""

    def run(batches):
        for batch in batches:
            found = [(len(s), fingerprint(s) if len(s) else None) for s in shingle_sets(batch.column(1), width)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([k for _, k in found], pa.int64()), batch.column(2)],
                names=["doc_id", "n_shingles", "node", "place"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("place")).mapInArrow(c.releasing(run), f"doc_id {kind}, n_shingles long, node long, place long")


def _common_shingles(docs: DataFrame, rows: int, width: int) -> np.ndarray:
    """Shingles of several documents of a sample; at most ``COMMON_ROWS``."""

    def run(batches):
        for batch in batches:
            found = list(shingle_sets(batch.column(0), width))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64))], names=["shingle"])

    share = min(1.0, SAMPLE_DOCS / max(rows, 1))
    picked = docs.filter(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30))).select("text").dropDuplicates()
    found = picked.mapInArrow(c.releasing(run), "shingle long").groupBy("shingle").count().filter(F.col("count") >= SAMPLE_COUNT)
    rows = found.orderBy(F.desc("count"), "shingle").limit(COMMON_ROWS).select("shingle").toArrow()
    return np.sort(rows.column("shingle").to_numpy().view(np.uint64))


def _packed(docs: DataFrame, width: int, common: np.ndarray, buckets: int) -> DataFrame:
    """Blocks of signatures by bucket: nodes, signatures of each, and 6 bytes of each signature."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def pack(found: list[np.ndarray], nodes: list[int]) -> pa.RecordBatch:
        every = np.concatenate(found)
        owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
        bucket = ((every >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        order = np.argsort(bucket.astype(np.min_scalar_type(buckets)), kind="stable")
        every, owner, bucket = every[order], owner[order], bucket[order]
        keys = np.array(nodes, dtype=np.int64)
        out: list[tuple] = []
        edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            heads = np.flatnonzero(np.r_[True, owner[a + 1 : b] != owner[a : b - 1]])
            counts = np.diff(np.r_[heads, b - a]).astype(np.uint32)
            low = every[a:b].view(np.uint8).reshape(-1, 8)[:, :6]
            out.append((int(bucket[a]), keys[owner[a:b][heads]].tobytes(), counts.tobytes(), low.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), *(pa.array([x[i] for x in out], pa.binary()) for i in (1, 2, 3))], names=["bucket", "nodes", "counts", "low"])

    def run(batches):
        common = shared.value
        is_common = np.zeros(1 << 20, dtype=bool)
        is_common[common & np.uint64(len(is_common) - 1)] = True
        found, nodes, size = [], [], 0
        for batch in batches:
            for shingles in shingle_sets(batch.column(0), width):
                if len(shingles):
                    found.append(signatures(shingles, common, is_common))
                    nodes.append(fingerprint(shingles))
                    size += len(found[-1])
                    if size >= BLOCK_SIGNATURES:
                        yield pack(found, nodes)
                        found, nodes, size = [], [], 0
        if found:
            yield pack(found, nodes)

    return docs.select("text").mapInArrow(c.releasing(run), "bucket int, nodes binary, counts binary, low binary")


def _groups(packed: DataFrame, partitions: int) -> DataFrame:
    """``gid, members``: the distinct lists of nodes that share a signature."""

    def shared(nodes: list[bytes], counts: list[bytes], low: list[bytes]) -> pa.RecordBatch:
        key = np.concatenate([np.repeat(np.frombuffer(n, dtype=np.int64), np.frombuffer(k, dtype=np.uint32)) for n, k in zip(nodes, counts, strict=True)])
        wide = np.zeros((len(key), 8), dtype=np.uint8)
        wide[:, :6] = np.frombuffer(b"".join(low), dtype=np.uint8).reshape(-1, 6)
        mark = wide.reshape(-1).view(np.uint64)
        order = np.argsort(mark)
        mark, key = mark[order], key[order]
        same = mark[1:] == mark[:-1]
        twice = np.r_[False, same] | np.r_[same, False]
        mark, key = mark[twice], key[twice]
        order = np.lexsort((key, mark))
        mark, key = mark[order], key[order]
        fresh = np.r_[True, (mark[1:] != mark[:-1]) | (key[1:] != key[:-1])][: len(mark)]
        mark, key = mark[fresh], key[fresh]
        heads = np.flatnonzero(np.r_[True, mark[1:] != mark[:-1]][: len(mark)])
        sizes = np.diff(np.r_[heads, len(mark)])
        heads, sizes = heads[sizes > 1], sizes[sizes > 1]
        if not len(heads):
            return None
        total = np.add.reduceat(np.r_[c.mix(key.view(np.uint64)), np.uint64(0)], np.c_[heads, heads + sizes].ravel())[::2]
        gid, first = np.unique(c.mix(total + sizes.astype(np.uint64)), return_index=True)
        heads, sizes = heads[first], sizes[first]
        at = np.repeat(heads - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        members = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(key[at]))
        return pa.RecordBatch.from_arrays([pa.array(gid.view(np.int64)), members], names=["gid", "members"])

    def run(batches):
        now, kept = None, ([], [], [])
        for batch in batches:
            for bucket, *rest in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if bucket != now and kept[0]:
                    out = shared(*kept)
                    if out is not None:
                        yield out
                    kept = ([], [], [])
                now = bucket
                for have, more in zip(kept, rest, strict=True):
                    have.append(more)
        if kept[0]:
            out = shared(*kept)
            if out is not None:
                yield out

    dealt = packed.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(c.releasing(run), "gid long, members array<long>").dropDuplicates(["gid"])


def _verified(pairs: DataFrame, docs: DataFrame, places: DataFrame, width: int) -> DataFrame:
    """``src, dst`` of the pairs of nodes that link; only the sets of those nodes are made again."""
    pairs = c.stored(pairs)
    sets = _sets_at(docs, places, pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), width).select("node", "shingles")

    def run(batches):
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("left_set"), batch.column("right_set"), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in (left, right))
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * common >= 75 * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column("src"), batch.column("dst")], names=["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("src"), F.col("shingles").alias("left_set"))
    right = sets.select(F.col("node").alias("dst"), F.col("shingles").alias("right_set"))
    return c.stored(pairs.join(left, "src").join(right, "dst").mapInArrow(c.releasing(run), "src long, dst long"))


def sketch(shingles: np.ndarray) -> bytes:
    """Parities of the numbers of elements in as many bins as a power of two, at least two for each element.

    Two sets differ by at least as many elements as their sketches by bits.  The
    sketch of half as many bins is its two halves combined by exclusive or.
    """
    bits = max(SKETCH_BITS, 1 << (2 * len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches brought to the size of the smallest, as rows of 64-bit numbers."""
    size = min(map(len, sketches))
    out = np.zeros((len(sketches), size // 8), dtype=np.uint64)
    for i, one in enumerate(sketches):
        np.bitwise_xor.reduce(np.frombuffer(one, dtype=np.uint64).reshape(-1, size // 8), axis=0, out=out[i])
    return out


def _near(left: np.ndarray, right: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether sketches allow sets with these sums of sizes to link."""
    return np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64) <= sizes // 7


def _close_heads(first: DataFrame, sketches: DataFrame) -> DataFrame:
    """``src, dst`` of the pairs that sizes and sketches allow."""

    def run(batches):
        for batch in batches:
            a, b = (batch.column(i).to_numpy() for i in (2, 4))
            x, y = (batch.column(i).to_pylist() for i in (3, 5))
            keep = [3 * max(p, q) <= 4 * min(p, q) and bool(_near(*np.vsplit(_folded([u, v]), 2), np.array([p + q]))[0]) for p, q, u, v in zip(a, b, x, y, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    left = sketches.select(F.col("node").alias("src"), F.col("n").alias("a"), F.col("sketch").alias("x"))
    right = sketches.select(F.col("node").alias("dst"), F.col("n").alias("b"), F.col("sketch").alias("y"))
    return first.join(left, "src").join(right, "dst").select("src", "dst", "a", "x", "b", "y").mapInArrow(c.releasing(run), "src long, dst long")


def _close_pairs(groups: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of nodes in one of ``gid, hub, members`` groups, of different roots, that sizes and sketches allow.

    ``known`` has ``node, root, n, sketch``.  Groups of one hub have much the same
    members, so they are dealt together, and a node's sketch travels once for them all;
    a hub with many groups is cut into several parts.
    """

    def pairs(node: np.ndarray, root: np.ndarray, n: np.ndarray, bits: np.ndarray) -> Iterator[np.ndarray]:
        order = np.lexsort((node, n))
        node, root, n, bits = node[order], root[order], n[order], bits[order]
        step = max(1, (1 << 20) // len(node))
        for i in range(0, len(node), step):
            some = slice(i, i + step)
            # Later ones in the order of sizes, up to 4/3 of the size.
            end = int(np.searchsorted(n, 4 * n[some][-1] // 3, side="right"))
            x, y = np.nonzero((root[some, None] != root[None, i:end]) & (3 * n[None, i:end] <= 4 * n[some, None]) & (np.arange(len(n[some]))[:, None] < np.arange(end - i)[None, :]))
            x, y = x + i, y + i
            for a in range(0, len(x), 1 << 14):
                left, right = x[a : a + (1 << 14)], y[a : a + (1 << 14)]
                near = _near(bits[left], bits[right], n[left] + n[right])
                yield np.sort(np.c_[node[left[near]], node[right[near]]], axis=1)

    def run(batches):
        for batch in batches:
            found = []
            for held, lists in zip(batch.column("held"), batch.column("lists"), strict=True):
                held, lists = held.values, lists.values
                node, root, n = (held.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                order = np.argsort(node)
                node, root, n, bits = node[order], root[order], n[order], _folded(held.field(3).to_pylist())[order]
                at = np.searchsorted(node, lists.flatten().to_numpy(zero_copy_only=False))
                edges = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    some = at[a:b]
                    if (root[some] != root[some[0]]).any():
                        found += pairs(node[some], root[some], n[some], bits[some])
            every = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(every[:, 0]), pa.array(every[:, 1])], names=["src", "dst"])

    parts = groups.groupBy("hub").agg(F.ceil(F.sum(F.size("members")) / PART_MEMBERS).alias("parts"))
    dealt = groups.join(parts, "hub").withColumn("part", F.pmod("gid", "parts")).select("hub", "part", "members")
    nodes = dealt.select("hub", "part", F.explode("members").alias("node")).distinct().join(known, "node")
    held = nodes.groupBy("hub", "part").agg(F.collect_list(F.struct("node", "root", "n", "sketch")).alias("held"))
    lists = dealt.groupBy("hub", "part").agg(F.collect_list("members").alias("lists"))
    return held.join(lists, ["hub", "part"]).select("held", "lists").mapInArrow(c.releasing(run), "src long, dst long").dropDuplicates()


def _sets_at(docs: DataFrame, places: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """``node, n, shingles, sketch`` of some nodes, made from their documents at ``places`` (``node, __id, __place``)."""

    def run(batches):
        for batch in batches:
            found = [x for x in shingle_sets(batch.column(0), width) if len(x)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([fingerprint(x) for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary()), pa.array([sketch(x) for x in found], pa.binary())],
                names=["node", "n", "shingles", "sketch"],
            )

    wanted = c.stored(places.join(nodes, "node", "left_semi").select("__id", "__place"))
    side = F.broadcast(wanted) if c.fits_broadcast(wanted) else wanted
    at = F.xxhash64("text").eqNullSafe(F.col("__place")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    texts = docs.join(side, at, "left_semi").select("text")
    return texts.mapInArrow(c.releasing(run), "node long, n long, shingles binary, sketch binary").dropDuplicates(["node"])


def _joined(docs: DataFrame, width: int, id_col: str, text_col: str, with_links: bool) -> DataFrame:
    """``doc_id, n_shingles, component_id``, and ``n_links`` if asked for."""
    spark = docs.sparkSession
    c.small_batches(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sets = c.stored(_sets(docs, width))
    rows, elements = sets.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    common = _common_shingles(docs, rows, width)
    # A set enumerates two sevenths of its elements for each of up to two bands, and one part more.
    buckets = min(1 << 30, 1 + (4 * int(elements) // 7 + 2 * rows) // BUCKET_SIGNATURES)
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets // 8)
    groups = c.stored(_groups(_packed(docs, width, common, buckets), partitions))

    members = groups.select("gid", F.explode("members").alias("node"))
    reps = sets.filter("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc_id", "place")).alias("rep"))
    company = groups.select(F.explode("members").alias("node"), (F.size("members") - 1).alias("others")).groupBy("node").agg(F.sum("others").alias("company"))
    places = c.stored(company.join(reps, "node").select("node", "company", F.col("rep.doc_id").alias("__id"), F.col("rep.place").alias("__place")))
    sketches = c.stored(_sets_at(docs, places, places.select("node"), width).select("node", "n", "sketch"))

    # One comparison for each node: with the hub (the node of most company) of the group that it meets most.
    hubs = members.join(places.select("node", "company"), "node").groupBy("gid").agg(F.max(F.struct("company", "node")).alias("best"))
    groups = c.stored(groups.join(hubs.select("gid", F.col("best.node").alias("hub")), "gid").select("gid", "hub", "members"))
    counted = groups.select(F.col("hub").alias("src"), F.explode("members").alias("dst")).filter("src <> dst").groupBy("src", "dst").count()
    first = counted.groupBy("dst").agg(F.max(F.struct("count", "src")).alias("best")).select(F.col("best.src").alias("src"), "dst")
    links = _verified(_close_heads(first, sketches), docs, places, width)
    roots = components(links)

    # What is left: pairs of a group that the first links have not joined.
    known = sketches.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "n", "sketch")
    more = _verified(_close_pairs(groups, c.stored(known)), docs, places, width)
    links = c.stored(links.union(more).dropDuplicates())
    roots = components(links)

    known_roots = sets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = known_roots.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = known_roots.join(least, "root", "left")
    columns = ["doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")]
    if not with_links:
        return named.select(*columns)

    # Every pair of a group that sizes and sketches allow, as if each node were a component of its own.
    alone = sketches.select("node", F.col("node").alias("root"), "n", "sketch")
    every = _verified(_close_pairs(groups, alone), docs, places, width)
    copies = sets.filter("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("copies"))
    both = every.select(F.col("src").alias("near"), F.col("dst").alias("node")).union(every.select(F.col("dst").alias("near"), F.col("src").alias("node")))
    ends = both.join(copies.withColumnRenamed("node", "near"), "near").groupBy("node").agg(F.sum("copies").alias("others"))
    counted = named.join(copies, "node", "left").join(ends, "node", "left")
    return counted.select(*columns, (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))


def component_ids(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id``."""
    return _joined(docs, width, id_col, text_col, False)


def join(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id, n_links``.

    ``n_links`` counts the other rows that the row links with, rows of an equal set among
    them.  All pairs that share a signature and pass sizes and sketches are verified for
    it, so it costs the square of the different sets of a group; ``component_ids`` does not.
    """
    return _joined(docs, width, id_col, text_col, True)


def deduplicated(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` without the documents that link, directly or not, to one with a smaller id; rows without an id stay."""
    found = component_ids(docs, width, id_col, text_col)
    return c.without_ids(docs, c.stored(found.filter("doc_id <> component_id").select("doc_id").distinct()), id_col)
