"""Prefix trie of conversations: nodes by chained digests of their turns, and sums over subtrees.

Conversations are first rebuilt: the first h turns are those of a base
conversation, h a checksum of the id, the rest are their own.

* Turns are ranged by conversation and order, so even one conversation is many tasks' work;
  each task counts within its part, and the few conversations that cross parts get an offset.
* A prefix's name is a chain of SHA-256 digests.  The chain is in two levels, so a long
  conversation isn't one task's: within blocks of ``BLOCK`` turns, all at once, then over
  the digests of a conversation's blocks.  Every prefix is exploded; a node is a group of
  equal depth and digest.
* A node belongs to its smallest member, so each conversation owns the lower end of its
  path, a chain of nodes.  Sums over a subtree are the rest of the chain that the node is in,
  plus the whole of each chain that starts below it: one sum for each chain is exploded to all ancestors
  of the chain's first node, instead of one for each node, so the rows are as many as turns and
  not as the square of a conversation's length.
* The ids that end at a node are joined in order by two streaming steps, ranges first.

Defined cases: turns are ordered by turn (null first), then role, then text; a
null role or text is empty; rows alike are turns each; rows without a conv_id
belong to no conversation and are left out; conversations whose turns all go are members of the root alone; no
rows give no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import spread_join, stored

#: a conversation's base is that of the hundred it is in; most turns that it takes from there
BASE, MOST_HEAD = 100, 5
#: turns in a block of a chain of digests; depths in a span of a chain of sums
BLOCK, SPAN = 256, 1024
#: ids in a piece of a node's list
PIECE = 1 << 16
ROOT = hashlib.sha256(b"root").digest()
NONE = hashlib.sha256(b"").hexdigest()

_TURN = "digest binary, chars long"


def _chained(before: Column, after: Column) -> Column:
    return F.unhex(F.sha2(F.concat(before, after), 256))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), digest of role and text, chars of the text, of every turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        F.unhex(F.sha2(named, 256)).alias("digest"),
        F.char_length(text).cast("long").alias("chars"),
        F.rand(1).alias("any"),  # deals out rows alike, which may change places
    )
    keys = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("any")]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "digest", "chars")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carried = TaskContext.get().partitionId(), None, 0
        for b in batches:
            ids = b.column(0).to_numpy()
            if not len(ids):
                continue
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            lengths = np.diff([*starts, len(ids)])
            nth = np.arange(len(ids), dtype=np.int64) - np.repeat(starts, lengths)
            if ids[0] == last:
                nth[: lengths[0]] += carried
            last, carried = ids[-1], int(nth[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), b.column(0), pa.array(nth), *b.columns[1:]], names=["part", "conv_id", "nth", "digest", "chars"])

    turns = stored(ranged.mapInArrow(counted, f"part int, conv_id long, nth long, {_TURN}"), "turns")
    # only a part's first and last conversation can cross into another part: two rows a part at most
    edges = turns.groupBy("part").agg(F.array(F.min("conv_id"), F.max("conv_id")).alias("ids")).select(F.explode("ids").alias("conv_id")).distinct()
    shares = turns.join(F.broadcast(edges), "conv_id", "left_semi").groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shares.select("conv_id", "part", F.sum("n").over(earlier).alias("offset"))
    placed = turns.join(F.broadcast(offsets), ["conv_id", "part"], "left")
    return placed.select("conv_id", (F.col("nth") + F.coalesce("offset", F.lit(0))).alias("pos"), "digest", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id, n turns after rebuilding) and their rebuilt turns (conv_id, n, pos, digest, chars)."""
    early = F.when(F.col("pos") < MOST_HEAD, F.struct("pos", "digest", "chars"))
    own = stored(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"), F.array_sort(F.collect_list(early)).alias("first")), "conversations")
    base = own.select(F.col("conv_id").alias("base"), F.col("first").alias("head"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_HEAD + 1)
    convs = own.select("conv_id", "own", h.cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % BASE).alias("base")).join(base, "base", "left")
    convs = convs.withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,digest:binary,chars:bigint>>")), F.lit(1), F.col("h")))
    convs = convs.select("conv_id", "own", "h", "head", (F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))
    heads = convs.select("conv_id", "n", F.inline("head"))
    rests = spread_join(turns, convs.select("conv_id", "n", "h", F.size("head").alias("from_base")), "conv_id", own.select("conv_id", F.col("own").alias("n")), F.col("pos"))
    rests = rests.filter("pos >= h").select("conv_id", "n", (F.col("pos") - F.col("h") + F.col("from_base")).alias("pos"), "digest", "chars")
    return convs.select("conv_id", "n"), heads.unionByName(rests)


def _block_chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chain of digests within each block."""
    for b in batches:
        chains = []
        for turns in b.column(3):
            digest, chain = ROOT, []
            for turn in turns.as_py():
                digest = hashlib.sha256(digest + turn["digest"]).digest()
                chain.append(digest)
            chains.append(chain)
        chars = [[t["chars"] for t in turns.as_py()] for turns in b.column(3)]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(chains, pa.list_(pa.binary())), pa.array(chars, pa.list_(pa.int64()))], names=["conv_id", "block", "n", "digests", "chars"])


def _over_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For blocks by conversation in order: the chain over the blocks before, and the digest of the prefix that ends there."""
    conv, chain, ended = None, ROOT, ROOT
    for b in batches:
        chains, befores = [], []
        for c, end in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if c != conv:
                conv, chain, ended, first = c, ROOT, ROOT, True
            chains.append(chain)
            befores.append(ended)
            ended = end if first else hashlib.sha256(chain + end).digest()
            chain, first = hashlib.sha256(chain + end).digest(), False
        yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(chains, pa.binary()), pa.array(befores, pa.binary())], names=["conv_id", "block", "chain", "before"])


def prefixes(turns: DataFrame) -> DataFrame:
    """A row for each block of a rebuilt conversation: conv_id, block, n (of the conversation), digests and chars of
    the prefixes that end in it, before (the digest of the prefix before it)."""
    blocked = turns.withColumn("block", F.floor(F.col("pos") / BLOCK)).groupBy("conv_id", "block").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "digest", "chars"))).alias("turns"))
    chained = blocked.select("conv_id", "block", "n", "turns").mapInArrow(_block_chains, "conv_id long, block long, n long, digests array<binary>, chars array<long>")
    blocks = stored(chained, "blocks")
    one, more = blocks.filter(F.col("n") <= BLOCK), blocks.filter(F.col("n") > BLOCK)
    ends = more.select("conv_id", "block", F.element_at("digests", -1).alias("end"))
    over = ends.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_over_blocks, "conv_id long, block long, chain binary, before binary")
    later = F.when(F.col("block") > 0, F.transform("digests", lambda x: _chained(F.col("chain"), x))).otherwise(F.col("digests"))
    columns = ["conv_id", "block", "n", "digests", "chars", "before"]
    return one.withColumn("before", F.lit(ROOT)).select(columns).unionByName(more.join(over, ["conv_id", "block"]).withColumn("digests", later).select(columns))


def node_groups(blocks: DataFrame) -> DataFrame:
    """Every node but the root: depth, digest, parent (digest), conv_id (smallest member), n_convs, chars, n_children."""
    place = F.posexplode(F.arrays_zip("digests", "chars")).alias("k", "x")
    rows = blocks.select("conv_id", "block", "digests", "before", place)
    parent = F.when(F.col("k") == 0, F.col("before")).otherwise(F.element_at("digests", F.greatest(F.col("k"), F.lit(1))))
    rows = rows.select((F.col("block") * BLOCK + F.col("k") + 1).alias("depth"), F.col("x.digests").alias("digest"), parent.alias("parent"), "conv_id", F.col("x.chars").alias("chars"))
    groups = rows.groupBy("depth", "digest").agg(F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("chars").alias("chars"))
    nodes = stored(groups, "trie-groups")
    children = nodes.groupBy(F.col("parent").alias("digest")).agg(F.count(F.lit(1)).alias("n_children"))
    return nodes.join(children, "digest", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids in order, joined by commas for each node, a piece of at most PIECE at a time."""
    node, held, first, out = None, [], 0, []

    def close():
        if held:
            out.append((node, first, ",".join(map(str, held))))
            held.clear()

    def batch():
        made = pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], names=["digest", "first", "ids"])
        out.clear()
        return made

    for b in batches:
        for digest, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if digest != node or len(held) >= PIECE:
                close()
                node, first = digest, conv
            held.append(conv)
        if out:
            yield batch()
    close()
    if out:
        yield batch()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each node, which come in order."""
    node, running, out = None, None, []

    def batch():
        made = pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.binary(), pa.string()), strict=True)], names=["digest", "ends_sha256"])
        out.clear()
        return made

    for b in batches:
        for digest, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if digest == node:
                running.update(b"," + ids.encode())
            else:
                if node is not None:
                    out.append((node, running.hexdigest()))
                node, running = digest, hashlib.sha256(ids.encode())
        if out:
            yield batch()
    if node is not None:
        out.append((node, running.hexdigest()))
        yield batch()


def ends(convs: DataFrame, blocks: DataFrame) -> DataFrame:
    """digest and ends_sha256 of the nodes where conversations end."""
    last = blocks.filter((F.col("block") + 1) * BLOCK >= F.col("n")).select(F.element_at("digests", -1).alias("digest"), "conv_id")
    rows = last.unionByName(convs.filter("n = 0").select(F.lit(ROOT).alias("digest"), "conv_id"))
    ranged = rows.repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    pieces = ranged.mapInArrow(_pieces, "digest binary, first long, ids string")
    return pieces.repartition("digest").sortWithinPartitions("digest", "first").select("digest", "ids").mapInArrow(_hashed, "digest binary, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """A row per node: depth, digest, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs, turns = rebuilt(ordered_turns(conversations))
    blocks = stored(prefixes(turns), "prefixes")
    convs = stored(convs, "rebuilt")
    n, smallest = convs.agg(F.count(F.lit(1)), F.min("conv_id")).head()

    values = {"saved": (F.col("n_convs") - 1) * F.col("chars"), "leaves": (F.col("n_children") == 0).cast("long")}
    nodes = stored(node_groups(blocks).withColumns(values), "nodes")
    sums = ["saved", "leaves"]

    # along the chain that each conversation owns: within spans, then over spans
    spans = nodes.withColumn("span", F.floor(F.col("depth") / SPAN))
    below = Window.partitionBy("conv_id", "span").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("conv_id").orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    totals = spans.groupBy("conv_id", "span").agg(*(F.sum(x).alias(x) for x in sums), F.min(F.struct("depth", "digest", "parent")).alias("top"))
    carried = totals.select("conv_id", "span", *(F.coalesce(F.sum(x).over(later), F.lit(0)).alias(f"{x}_later") for x in sums))
    along = spans.select("*", *(F.sum(x).over(below).alias(f"{x}_below") for x in sums)).join(carried, ["conv_id", "span"])
    along = along.select("depth", "digest", "conv_id", "n_convs", "n_children", *((F.col(f"{x}_below") + F.col(f"{x}_later")).alias(x) for x in sums))

    # from each chain's first node to all its ancestors but the root, which has the sum of everything
    chains = stored(totals.groupBy("conv_id").agg(*(F.sum(x).alias(x) for x in sums), F.min("top").alias("top")).select("conv_id", *sums, "top.*").filter("depth > 1"), "chains")
    n_blocks = blocks.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    paths = spread_join(blocks.select("conv_id", "block", "digests"), chains.select("conv_id", *sums, "depth"), "conv_id", n_blocks, F.col("block"))
    above = F.greatest(F.col("depth") - 1 - F.col("block") * BLOCK, F.lit(0)).cast("int")
    ancestors = paths.select(*sums, F.explode(F.slice("digests", F.lit(1), above)).alias("digest"))
    above_sums = ancestors.groupBy("digest").agg(*(F.sum(x).alias(f"{x}_above") for x in sums))

    # a chain's first node has another conversation's node above it
    tops = chains.select("digest", F.col("parent").alias("up"))
    owners = nodes.select(F.col("digest").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    parents = spread_join(tops, owners, "up", tops.groupBy("up").agg(F.count(F.lit(1)).alias("n")), F.col("digest")).select("digest", "parent_conv_id")

    root = nodes.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in sums), F.count(F.when(F.col("depth") == 1, 1)).alias("n_children"))
    root = root.filter(F.lit(n > 0)).select(
        F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("digest"), F.lit(smallest).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"),
        F.lit(n).cast("long").alias("n_convs"), "n_children", F.greatest("leaves", F.lit(1)).alias("leaves"), "saved",
    )
    whole = along.join(above_sums, "digest", "left").join(parents, "digest", "left").select(
        "depth", "digest", "conv_id", F.when(F.col("depth") == 1, F.lit(smallest)).otherwise(F.coalesce("parent_conv_id", "conv_id")).cast("long").alias("parent_conv_id"),
        "n_convs", "n_children", *((F.col(x) + F.coalesce(f"{x}_above", F.lit(0))).alias(x) for x in ("leaves", "saved")),
    )
    out = whole.unionByName(root).join(ends(convs, blocks), "digest", "left")
    return out.select("depth", "digest", "conv_id", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"))
