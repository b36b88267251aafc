"""MinHash near-dedup with fast similarity sketching.

A document's set is its distinct five-word shingles (the whole sequence, if
shorter).  Its sketch has T coordinates, filled by rounds of hashed bin
placement: in round r < T every element falls into one bin with a value that
begins with r, and a bin keeps its smallest value; in round T + i every element
falls into bin i.  So every coordinate is filled at the latest then, and the
share of coordinates in which two sketches agree is concentrated about the
Jaccard similarity of their sets (Dahlgaard, Knudsen and Thorup, 2017).

1. Documents with equal sets become one node (128-bit digest of the set).
2. Bands of BAND coordinates put nodes into buckets.
3. Star: each node is held against the least node of its buckets, on full sets;
   these links are parents, so pointer jumping gives the first components.
4. Blocks: buckets that still hold several components are cut into blocks of
   bounded size, those of the largest component apart; every pair of blocks, but
   for pairs inside the largest component, goes to one task.  So a bucket costs in proportion to its
   members where few lie outside its largest component.  Members whose sketch agrees
   with none of another component are put aside first; the rest is compared on
   full sets, until all in a block that can be linked are.  Blocks are large beside WIDE, so
   a bucket's rows are at most 2 * WIDE / BLOCK times its members, but where bytes bound a block.
5. Wide buckets, with over WIDE members outside the largest component, are
   clouds of texts that are alike in part.  There members meet by shingle: of
   two similar sets, the rarest (1 - threshold) of each must have a shingle in
   common, in any order of shingles that all share.  Rarest first, what a cloud has
   in common comes last, and its members do not meet.  This loses no link.
6. Components of the components by hooking to the least neighbour and pointer jumping.

No pair of a group is ever emitted beyond a spanning forest of its links, no
group is in one task, and nothing about single documents reaches the driver.
Hot buckets, hubs, components and sets are dealt into parts where tables are joined on them.
A link is lost only if all 25 bands miss it (5e-5 at similarity 0.80, 5e-7 at
0.85, under 1e-8 from 0.88), or if its sketches agree in under AGREE of the
coordinates (under 1e-7).

Defined cases: null and empty texts, and texts of separators, have an empty set
and are linked with nothing; a null id is a document whose component is that of
its texts' other ids, or null; unlike texts under one id, or under no id, are
documents of their own; rows alike are linked; no rows give no rows;
other columns are ignored by ``components`` and kept by ``keep_one``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .cluster import discard, release, row_key, shuffle_parts, spread_join, stored, unused
from .quality_rules import WORD

SHINGLE = 5
T, BAND = 128, 5
BANDS = T // BAND
AGREE = 0.6
#: least similarity, in hundredths, of two linked documents
THRESHOLD = 80
#: members of a hub that one task holds against it
MEMBERS = 256
#: members of one block, and bytes of sets in it; members outside the largest component from which a bucket is wide
BLOCK, BLOCK_BYTES, WIDE = 2048, 32 << 20, 8192
#: bytes of bits that are held at once where the sets of a block are compared
BITS_BYTES = 32 << 20
CHUNK = 1 << 20

_LOW = tv.U64((1 << 56) - 1)
_SEEDS = tv.mix64(np.arange(1, 2 * T + 1, dtype=np.uint64) * tv.U64(0x9E3779B97F4A7C15))
_ROUNDS = np.arange(2 * T, dtype=np.uint64) << tv.U64(56)


def sketch(elements: np.ndarray) -> np.ndarray:
    """The T coordinates of a non-empty set of 64-bit hashes."""
    out = np.full(T, ~tv.U64(0))
    at_once = max(1, ceil(T * 6 / len(elements)))
    for r in range(0, T, at_once):
        seeds = slice(r, min(r + at_once, T))
        h = tv.mix64(elements[None, :] ^ _SEEDS[seeds, None])
        np.minimum.at(out, (h >> tv.U64(57)).astype(np.int64).ravel(), ((h & _LOW) | _ROUNDS[seeds, None]).ravel())
        if out.max() >> tv.U64(56) < T:
            return out
    for i in np.flatnonzero(out >> tv.U64(56) >= T):
        out[i] = (tv.mix64(elements ^ _SEEDS[T + i]) & _LOW).min() | _ROUNDS[T + i]
    return out


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text with words."""
    for first, offsets, raw in tv.chunks(column, CHUNK):
        raw = tv.lower_ascii(raw)
        hashes, rows, _, _ = tv.words(raw, offsets)
        grams, at = tv.windows(hashes, rows, SHINGLE)
        owner = rows[at]
        every = np.arange(len(offsets))
        cuts, words = np.searchsorted(owner, every), np.searchsorted(rows, every)
        for i in range(len(offsets) - 1):
            if cuts[i] < cuts[i + 1]:
                yield first + i, np.unique(grams[cuts[i] : cuts[i + 1]])
            elif words[i] < words[i + 1]:
                own = hashes[words[i] : words[i + 1]]
                yield first + i, np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), np.uint64)


def _digest(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = tv.mix64(np.arange(BANDS, dtype=np.uint64) + tv.U64(977))
    for b in batches:
        n, nodes, coordinates, rows = np.zeros(b.num_rows, np.int64), [None] * b.num_rows, [], []
        for i, elements in shingle_sets(b.column(1)):
            n[i], nodes[i] = len(elements), _digest(elements)
            coordinates.append(sketch(elements))
            rows.append(i)
        s = np.array(coordinates, np.uint64).reshape(-1, T)
        keys = np.broadcast_to(salt, (len(s), BANDS)).copy()
        with np.errstate(over="ignore"):
            for k in range(BAND):
                keys = tv.mix64(keys * tv.U64(0x9E3779B97F4A7C15) ^ s[:, k : BANDS * BAND : BAND])
        keys = keys.view(np.int64).tolist()
        low = [x.tobytes() for x in (s & tv.U64(255)).astype(np.uint8)]
        bands, small = [None] * b.num_rows, [None] * b.num_rows
        for j, i in enumerate(rows):
            bands[i], small[i] = keys[j], low[j]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.binary()), pa.array(n), pa.array(bands, pa.list_(pa.int64())), pa.array(small, pa.binary()), b.column(2)], names=["doc_id", "node", "n_shingles", "bands", "low", "tag"])


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, node (digest of the set), n_shingles, bands, low (8 bits a coordinate) and tag (of id and text) of each document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", tag().alias("tag"))
    return rows.mapInArrow(_sketches, f"doc_id long, node binary, n_shingles long, bands array<long>, low binary, tag {TAG}")


TAG = "struct<a: long, b: long>"


def tag() -> Column:
    """Names a row by its id and text."""
    return row_key(F.col("doc_id").cast("long"), F.col("text"))


def _sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """id and set of the needed nodes (id, tag of a row that has it), from the texts again."""
    rows = docs.select(tag().alias("tag"), "text").join(needed.select("id", "tag").hint("merge"), "tag").select("id", "text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            # rows alike follow each other in the sorted join: one is enough
            own = b.column(0).to_numpy()
            fresh = np.flatnonzero(own != np.r_[own[:1] + 1 if last is None else [last], own[:-1]])
            last = int(own[-1]) if len(own) else last
            b = b.take(pa.array(fresh))
            ids, out, held = [], [], 0
            for i, elements in shingle_sets(b.column(1)):
                ids.append(b.column(0)[i].as_py())
                out.append(elements.tobytes())
                held += len(out[-1])
                if held > BLOCK_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["id", "set"])
                    ids, out, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["id", "set"])

    return rows.mapInArrow(build, "id long, set binary")


def similar(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    """100 * |a and b| >= threshold * |a or b| for sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= threshold * (len(a) + len(b) - both)


def shared(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The number of elements that the sets i[k] and j[k] have in common, for pairs in the order of i.

    Elements of several sets get a bit each, some at a time, so a pair costs an AND of two rows;
    where such elements are very many beside those of a set, the sets themselves are searched.
    """
    out = np.zeros(len(i), np.int64)
    used = np.unique(np.r_[i, j])
    if not len(used):
        return out
    sizes = np.array([len(sets[k]) for k in used])
    _, place, times = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    several = times[place] > 1
    rows, columns = np.repeat(np.arange(len(used)), sizes)[several], number[place[several]]
    width = int(number[-1]) + 1
    if width > 1000 * sizes.mean():
        for k, (p, q) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            a, b = (sets[p], sets[q]) if len(sets[p]) <= len(sets[q]) else (sets[q], sets[p])
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            out[k] = (b[at] == a).sum()
        return out
    i, j = np.searchsorted(used, i), np.searchsorted(used, j)
    firsts, starts = np.unique(i, return_index=True)
    step = max(64, BITS_BYTES // len(used) * 8 // 64 * 64)
    for low in range(0, width, step):
        here = (columns >= low) & (columns < low + step)
        r, c = rows[here], columns[here] - low
        bits = np.zeros((len(used), -(-min(step, width - low) // 64)), tv.U64)
        np.bitwise_or.at(bits, (r, c >> 6), tv.U64(1) << (c & 63).astype(tv.U64))
        for p, a, b in zip(firsts.tolist(), starts.tolist(), [*starts[1:].tolist(), len(i)], strict=True):
            out[a:b] += np.bitwise_count(bits[j[a:b]] & bits[p]).sum(1, dtype=np.int64)
    return out


def _star_links(sets: DataFrame, edges: DataFrame, threshold: int) -> DataFrame:
    """The edges (id, hub) whose sets are similar.

    A hub's set goes once to each of its salts; members follow it in a sorted
    partition, so a task holds one hub's set and one member's at a time.
    """
    sizes = stored(edges.groupBy("hub").agg(F.count(F.lit(1)).alias("n")), "hubs")
    parts = F.ceil(F.col("n") / F.lit(MEMBERS)).cast("int")
    salted = spread_join(edges, sizes.select("hub", parts.alias("parts")), "hub", sizes, F.col("id")).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    hubs = sizes.select("hub", F.col("hub").alias("id"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"), F.lit(0).alias("role"))
    roles = salted.select("hub", "id", "salt", F.lit(1).alias("role")).unionByName(hubs)
    rows = roles.join(sets, "id").select("hub", "salt", "role", "id", "set")
    rows = rows.repartition(shuffle_parts(sets.sparkSession), "hub", "salt").sortWithinPartitions("hub", "salt", "role")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for b in batches:
            ids, to = [], []
            for h, role, i, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), strict=True):
                elements = np.frombuffer(s.as_buffer(), np.uint64)
                if role == 0:
                    hub, own = h, elements.copy()
                elif h == hub and similar(own, elements, threshold):
                    ids.append(i)
                    to.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(to, pa.int64())], names=["a", "b"])

    out = stored(rows.mapInArrow(verify, "a long, b long"), "star")
    discard(sizes)
    release(out.sparkSession)
    return out


class _Forest:
    """Union-find over the labels of one block."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x


def _several(members: DataFrame) -> DataFrame:
    """The buckets that hold several components: bucket, n, top (the largest of them) and few (members outside it)."""
    mixed = members.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo != hi").select("bucket", "n")
    mixed = stored(mixed, "mixed")
    by_comp = spread_join(members, mixed.select("bucket"), "bucket", mixed, F.col("id")).groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("m"))
    tops = by_comp.groupBy("bucket").agg(F.sum("m").alias("n"), F.max(F.struct("m", "comp")).alias("x"))
    tops = stored(tops.select("bucket", "n", F.col("x.comp").alias("top"), (F.col("n") - F.col("x.m")).alias("few")), "several")
    discard(mixed)
    return tops


def _numbers(members: DataFrame, weight: str) -> DataFrame:
    """The buckets (bucket, n) that hold several components, and the numbers of blocks (a, b) of their largest component and of the others."""
    size = lambda own: F.greatest(F.ceil(F.sum(own.cast("long")) / F.lit(BLOCK)), F.ceil(F.sum(F.when(own, F.col(weight)).otherwise(0)) / F.lit(BLOCK_BYTES))).cast("int")
    major = F.col("comp") == F.col("top")
    sizes = members.groupBy("bucket").agg(size(major).alias("a"), size(~major).alias("b"), size(F.lit(True)).alias("all"), F.count(F.lit(1)).alias("n")).filter("a > 0 AND b > 0")
    # a bucket that fits is one block
    return sizes.select("bucket", "n", F.when(F.col("all") > 1, F.col("a")).otherwise(0).alias("a"), F.when(F.col("all") > 1, F.col("b")).otherwise(1).alias("b"))


def _blocks(members: DataFrame, weight: str, sizes: DataFrame | None = None) -> DataFrame:
    """members (bucket, id, comp, top, ...) -> a row for each pair of blocks that a member is in; ``mine`` tells its block.

    The largest component's blocks come first; they are paired with those of the others, which are paired with all.
    ``sizes`` are the members' ``_numbers``, stored by who can delete them: they are read several times.
    """
    sizes = _numbers(members, weight) if sizes is None else sizes
    major = F.col("comp") == F.col("top")
    rows = spread_join(members, sizes.select("bucket", "a", "b"), "bucket", sizes.select("bucket", "n"), F.col("id"))
    h, first = F.xxhash64("id"), major & (F.col("a") > 0)
    rows = rows.withColumn("mine", F.when(first, F.pmod(h, F.col("a"))).otherwise(F.col("a") + F.pmod(h, F.col("b"))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.when(first, F.col("a")).otherwise(F.lit(0)), F.col("a") + F.col("b") - 1)))
    return rows.withColumn("x", F.least("mine", "other")).withColumn("y", F.greatest("mine", "other")).drop("other", "a", "b")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The groups of rows alike in the first ``keys`` columns of a sorted partition."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(i).to_numpy() for i in range(keys)], 1)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            key = tuple(k[i].tolist())
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _pairs(group: pa.Table, threshold: int) -> tuple[np.ndarray, ...]:
    """(ids, components, mine, agreement by rows i and j > i of unlike components and fitting sizes) of one pair of blocks."""
    ids, comp, mine, n = (group[c].to_numpy() for c in ("id", "comp", "mine", "n"))
    low = np.frombuffer(b"".join(group["low"].to_pylist()), np.uint8).reshape(-1, T)
    x, y = group["x"][0].as_py(), group["y"][0].as_py()
    found_i, found_j = [], []
    for i in range(len(ids) - 1):
        rest = slice(i + 1, None)
        fits = (comp[rest] != comp[i]) & (100 * np.minimum(n[rest], n[i]) >= threshold * np.maximum(n[rest], n[i]))
        if x != y:  # pairs inside one block are met where that block is paired with itself
            fits &= mine[rest] != mine[i]
        at = np.flatnonzero(fits) + i + 1
        if len(at):
            at = at[(low[at] == low[i]).sum(1) >= AGREE * T]
            found_i.append(np.full(len(at), i))
            found_j.append(at)
    none = np.zeros(0, np.int64)
    return ids, comp, np.concatenate(found_i) if found_i else none, np.concatenate(found_j) if found_j else none


def _promising(members: DataFrame, threshold: int) -> DataFrame:
    """The members, stored, whose sketch agrees with one of another component in their bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            _, _, i, j = _pairs(group, threshold)
            some = np.unique(np.r_[i, j]).astype(np.int64)
            yield from group.select(names).take(pa.array(some)).combine_chunks().to_batches()

    names = ["bucket", "id", "comp", "top", "n", "low"]
    weighed = members.withColumn("w", F.lit(T))
    sizes = stored(_numbers(weighed, "w"), "numbers")
    rows = _blocks(weighed, "w", sizes).select("bucket", "x", "y", "mine", "id", "comp", "top", "n", "low")
    rows = rows.repartition(shuffle_parts(members.sparkSession), "bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    out = stored(rows.mapInArrow(run, "bucket long, id long, comp long, top long, n long, low binary").distinct(), "hopeful")
    discard(sizes)
    release(out.sparkSession)
    return out


def _block_links(members: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links between components, stored, on full sets, that join all of a block that can be joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            _, comp, i, j = _pairs(group, threshold)
            sets_of = [np.frombuffer(s.as_buffer(), np.uint64) for column in group["set"].chunks for s in column]
            both, sizes = shared(sets_of, i, j), np.array([len(s) for s in sets_of])
            good = 100 * both >= threshold * (sizes[i] + sizes[j] - both)
            forest, a, b = _Forest(), [], []
            for p, q in np.unique(np.stack([comp[i[good]], comp[j[good]]], 1), axis=0).tolist():
                u, v = forest.root(p), forest.root(q)
                if u != v:
                    forest.up[u] = v
                    a.append(p)
                    b.append(q)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    weighed = members.withColumn("w", F.col("n") * 8)
    sizes = stored(_numbers(weighed, "w"), "numbers")
    rows = _blocks(weighed, "w", sizes).join(sets, "id").select("bucket", "x", "y", "mine", "id", "comp", "n", "low", "set")
    rows = rows.repartition(shuffle_parts(members.sparkSession), "bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    out = stored(rows.mapInArrow(run, "a long, b long"), "blocks")
    discard(sizes)
    release(out.sparkSession)
    return out


def _rare(sets: DataFrame, sizes: DataFrame, threshold: int) -> DataFrame:
    """bucket (a shingle) and id: the shingles by which a set must meet every set that is similar to it.

    A set of n shares threshold * n with any that is similar, so one of its first n - threshold * n + 1
    is among the first of the other; the order is by number of sets, then by value.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, s in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(s.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), i)), pa.array(x)], names=["id", "shingle"])

    every = stored(sets.mapInArrow(explode, "id long, shingle long"), "shingles")
    counts = stored(every.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "counts")
    shared = spread_join(every, counts.select("shingle", F.col("n").alias("f")), "shingle", counts, F.col("id"))
    by_set = shared.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("f", "shingle"))).alias("s")).join(sizes, "id")
    # shingles of one set only come first in the order and are left out
    first = F.size("s") - F.floor((F.col("n") * F.lit(threshold) + 99) / 100).cast("int") + 1
    out = stored(by_set.select("id", F.explode(F.slice("s", F.lit(1), F.greatest(first, F.lit(0)))).alias("x")).select(F.col("x.shingle").alias("bucket"), "id"), "rare")
    discard(every, counts)
    return out


def _links_between(docs: DataFrame, nodes: DataFrame, members: DataFrame, threshold: int) -> DataFrame:
    """(a, b): links between the components of members (bucket, id, comp), on full sets."""
    sketch_of = nodes.select("id", "n", "low")
    places = lambda ids: nodes.select("id", "tag").join(ids.distinct(), "id", "left_semi")
    several = _several(members)
    opened = spread_join(members, several.select("bucket", "top", "few"), "bucket", several, F.col("id")).join(sketch_of, "id")
    opened = stored(opened, "open")
    narrow = opened.filter(F.col("few") <= WIDE)
    hopeful = _promising(narrow, threshold)
    out = _block_links(hopeful, _sets(docs, places(hopeful.select("id"))), threshold)
    wide = opened.filter(F.col("few") > WIDE).select("id", "comp", "n", "low").dropDuplicates(["id"])
    if several.filter(F.col("few") > WIDE).limit(1).count():
        wide = stored(wide, "wide")
        sets = stored(_sets(docs, places(wide.select("id"))), "sets")
        met = _rare(sets, wide.select("id", "n"), threshold)
        rare = met.join(wide.select("id", "comp"), "id")
        several_rare = _several(rare)
        close = stored(spread_join(rare, several_rare.select("bucket", "top"), "bucket", several_rare, F.col("id")).join(sketch_of, "id"), "close")
        near = _promising(close, threshold)
        narrower, out = out, stored(out.unionByName(further := _block_links(near, sets, threshold)), "blocks")
        discard(wide, sets, met, several_rare, close, near, narrower, further)
    discard(several, opened, hopeful)
    return out


def _counted(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def _jump(parents: DataFrame) -> DataFrame:
    """(v, p) with p <= v -> (v, root), by pointer jumping."""
    table = stored(parents, "parents")
    while True:
        up = table.select(F.col("v").alias("p"), F.col("p").alias("_p"))
        both = spread_join(table.select("v", "p"), up, "p", _counted(table, "p"), F.col("v"), "left")
        further = stored(both.select("v", F.coalesce("_p", "p").alias("p"), (F.coalesce("_p", "p") != F.col("p")).alias("moved")), "parents")
        discard(table)
        if further.filter("moved").limit(1).count() == 0:
            return further
        table = further


def roots(links: DataFrame) -> DataFrame:
    """(v, p) for every end of the links (a, b): p is the least end of its component."""
    edges = stored(links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    found = None
    while True:
        both = edges.select(F.col("b").alias("v"), F.col("a").alias("p")).unionByName(edges.select(F.col("a").alias("v"), F.col("a").alias("p")))
        step = _jump(both.groupBy("v").agg(F.min("p").alias("p")))
        if found is None:
            found = step
        else:
            s = step.select(F.col("v").alias("p"), F.col("p").alias("_p"))
            found = stored(spread_join(found.select("v", "p"), s, "p", _counted(found, "p"), F.col("v"), "left").select("v", F.coalesce("_p", "p").alias("p")), "roots")
        left, right = step.select(F.col("v").alias("a"), F.col("p").alias("ra")), step.select(F.col("v").alias("b"), F.col("p").alias("rb"))
        again = spread_join(spread_join(edges, left, "a", _counted(edges, "a"), F.col("b")), right, "b", _counted(edges, "b"), F.col("a"))
        edges = stored(again.filter("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
        if edges.limit(1).count() == 0:
            return found.select("v", "p")


def components(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable) and kept of every document.

    ``tag`` (of id and text) and ``comp`` (null for an empty set) tell rows of one id apart.
    """
    rows = stored(sketched(docs), "sketches")
    filled = rows.filter("n_shingles > 0")
    firsts = [F.first(c).alias(name) for c, name in (("tag", "tag"), ("n_shingles", "n"), ("bands", "bands"), ("low", "low"))]
    nodes = filled.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), *firsts)
    nodes = stored(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    exploded = nodes.select("id", F.explode("bands").alias("bucket"))
    buckets = exploded.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).filter("hub != last").drop("last")
    buckets = stored(buckets, "buckets")
    members = stored(spread_join(exploded, buckets.select("bucket", "hub"), "bucket", buckets, F.col("id")), "members")

    # star: each node against the least node of its buckets
    edges = stored(members.filter("id != hub").groupBy("id").agg(F.min("hub").alias("hub")), "edges")
    ends = edges.select("id").unionByName(edges.select(F.col("hub").alias("id"))).distinct()
    star = _star_links(_sets(docs, nodes.select("id", "tag").join(ends, "id", "left_semi")), edges, threshold)
    first = _jump(star.distinct().select(F.col("a").alias("v"), F.col("b").alias("p")))
    own = first.select(F.col("v").alias("id"), F.col("p").alias("root"))

    # blocks: buckets that hold several components after that
    fresh = stored(members.join(own, "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("comp")), "labelled")
    discard(buckets, members, edges, star)
    more = _links_between(docs, nodes, fresh, threshold)
    discard(fresh)
    up = roots(more).select(F.col("v").alias("comp"), F.col("p").alias("top"))
    discard(more)
    release(docs.sparkSession)

    labelled = nodes.select("id", "node", "doc_id", "copies").join(own, "id", "left").withColumn("comp", F.coalesce("root", "id"))
    labelled = spread_join(labelled, up, "comp", _counted(own, "root").withColumnRenamed("root", "comp"), F.col("id"), "left").withColumn("comp", F.coalesce("top", "comp"))
    labelled = stored(labelled.select("id", "node", "doc_id", "copies", "comp"), "labels")
    discard(first)
    least = stored(labelled.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "least")
    by_node = spread_join(labelled, least.drop("n"), "comp", least.select("comp", "n"), F.col("id")).select("node", "component_id", "comp")
    out = spread_join(rows.select("doc_id", "n_shingles", "node", "tag"), by_node, "node", nodes.select("node", F.col("copies").alias("n")), F.col("tag"), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "tag", "comp")


def keep_one(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of docs, all their columns: one of each component, and all with an empty set."""
    kept = components(docs, threshold).filter("kept AND comp IS NOT NULL")
    names = docs.columns
    own, theirs = unused(docs, "_own", "_theirs")
    chosen = kept.groupBy("comp").agg(F.min("tag").alias(theirs)).select(theirs)
    one = docs.withColumn(own, tag()).join(chosen, F.col(own) == F.col(theirs), "left_semi").dropDuplicates([own]).select(*names)
    return one.unionByName(docs.filter(~F.coalesce(F.col("text").rlike(WORD), F.lit(False))))
