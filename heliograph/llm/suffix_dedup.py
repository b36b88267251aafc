"""Suffix dedup: remove every byte under a LENGTH-byte string that starts elsewhere too.

Bucket-pointer refinement over a sparse set of suffixes.  The identifier of a
q-gram is a 64-bit name of its content, so a refined identifier is known at
every offset without numbering the buckets across the cluster.

1. Initial buckets.  Every LENGTH-byte string belongs to the bucket of its least
   q-gram identifier; strings that start side by side mostly share it, so a
   document is cut into runs (about one in 80 bytes) and only runs are dealt out.
   A bucket with one run is done: its strings occur nowhere else.
2. Refinement.  Runs of a bucket are sorted on identifiers of later offsets:
   the identifier at LENGTH bytes is made from those at 0, Q, 2Q ... and that
   of a run from those of its first and last string, each level reusing the
   last.  Runs alike throughout are done: all their strings occur again.
3. In buckets that still hold unlike runs, one run of each kind is cut into
   cells of CELL strings, placed by the least q-gram.  Cells are first put
   together by what all their strings share, then told apart by all they cover:
   a cell alone in its bucket is done, and so are cells alike throughout.
4. Cells of one bucket that are unlike are refined to single strings.

Names are 64 bits, and strings are only compared within a bucket, so 128 bits
stand for a string; 128 bits of id and text (``ka``, ``kb``) stand for a row.
Removal is judged on the input texts.  A bucket may hold any share of the runs:
hot ones are dealt into parts where a table is joined on the bucket alone.

Defined cases: a null text is empty; texts under LENGTH bytes lose nothing;
cuts fall between bytes, also inside a character; rows alike, with one id or
several, are copies of each other; unlike texts under one id, or under no id, are
judged apart; a null id is kept as null; no rows give no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .cluster import discard, row_key, spread_join, stored

LENGTH, Q = 200, 40
REACH = LENGTH - Q + 1
CHUNK = 1 << 18
#: strings of one cell, beginning side by side
CELL = 20

_A, _B = tv.U64(0x9E3779B97F4A7C15), tv.U64(0xC2B2AE3D27D4EB4F)


def _join(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The identifier of a string from those of its two parts."""
    with np.errstate(over="ignore"):
        z = x * _A + (y ^ (y >> tv.U64(32))) * _B
        z ^= z >> tv.U64(29)
        return z


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over every ``width`` neighbours, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = pick(x[:-step], x[step:])
        done += step
    return x


def gram_ids(raw: np.ndarray) -> np.ndarray:
    """The identifier of the q-gram at each byte: 8 bytes, refined by doubling to Q."""
    n = len(raw) - 7
    eight = np.ndarray((n,), "<u8", np.ascontiguousarray(raw), 0, (1,))
    with np.errstate(over="ignore"):
        eight = (eight ^ (eight >> tv.U64(31))) * _B
    eight ^= eight >> tv.U64(27)
    sixteen = _join(eight[:-8], eight[8:])
    many = _join(sixteen[:-16], sixteen[16:])
    ids = _join(many[: n - Q + 8], eight[Q - 8 : n])
    with np.errstate(over="ignore"):
        ids *= _A
    ids ^= ids >> tv.U64(32)
    return ids


def string_ids(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The identifier of the LENGTH bytes at each of the places: refined on the identifiers at later offsets."""
    z = grams[at]
    for offset in range(Q, LENGTH, Q):
        z = _join(z, grams[at + offset])
    return tv.mix64(z)


def pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, place in its text, offsets, bytes): runs of whole texts, or overlapping parts of a long one."""
    for first, offsets, raw in tv.chunks(column, CHUNK):
        if len(offsets) > 2 or len(raw) <= 2 * CHUNK:
            yield first, 0, offsets, raw
        else:
            for i in range(0, len(raw) - LENGTH + 1, CHUNK):
                part = raw[i : i + CHUNK + LENGTH - 1]
                yield first, i, np.array([0, len(part)]), part


def find_runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """The runs of a piece: (first string, last string, place of the least q-gram, bucket, identifier)."""
    none, names = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(raw) < LENGTH:
        return none, none, none, names, names
    grams = gram_ids(raw)
    least = _sliding(grams, REACH, np.minimum)
    valid = np.ones(len(least), bool)
    for end in offsets[1:-1]:
        valid[max(0, end - LENGTH + 1) : end] = False
    change = np.empty(len(least) + 1, bool)
    change[0] = change[-1] = True
    np.not_equal(least[1:], least[:-1], out=change[1:-1])
    # a string that begins with its least q-gram ends a run, though the next may have the same again
    change[1:-1] |= (valid[1:] != valid[:-1]) | (grams[: len(least) - 1] == least[:-1])
    edges = np.flatnonzero(change)
    a, b = edges[:-1], edges[1:] - 1
    keep = valid[a]
    a, b = a[keep], b[keep]
    if not len(a):
        return none, none, none, names, names
    bucket = least[a]
    ends = _join(string_ids(grams, a), string_ids(grams, b))
    # the leftmost place of the bucket's q-gram, among those that are least somewhere
    padded = np.concatenate([np.zeros(REACH - 1, np.uint64), least, np.zeros(REACH - 1, np.uint64)])
    chosen = np.flatnonzero(_sliding(padded, REACH, np.maximum) == grams)
    at = np.searchsorted(chosen, b)
    while (wrong := grams[chosen[at]] != bucket).any():
        at[wrong] += 1
    place = chosen[at]
    return a, b, place, bucket, tv.mix64(ends + ((b - a) * 1024 + (place - a)).astype(np.uint64))


def _stretches(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches [a, b] that follow each other in a row, as one."""
    order = np.lexsort((a, row))
    row, a, b = row[order], a[order], b[order]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (a[1:] > b[:-1] + 1)])
    return row[first], a[first], b[np.r_[first[1:], len(a)] - 1]


def _emit(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Runs of the texts; whole: with their documents, and known repeats inside a piece as stretches (bucket null).

    Of runs alike in one piece one is dealt out.
    """
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        for first, base, offsets, raw in pieces(column):
            a, b, place, bucket, name = find_runs(raw, offsets)
            if not len(a):
                continue
            order = np.lexsort((a, name, bucket))
            same = (bucket[order][1:] == bucket[order][:-1]) & (name[order][1:] == name[order][:-1])
            lone = order[np.r_[True, ~same]]
            if not whole:
                # a bucket that repeats here is as good as two
                yield pa.RecordBatch.from_arrays([pa.array(bucket[order][np.r_[True, ~same] | np.r_[False, same & np.r_[True, ~same[:-1]]]].view(np.int64))], names=["bucket"])
                continue
            again = order[np.r_[False, same] | np.r_[same, False]]
            row = np.searchsorted(offsets, a, "right") - 1
            known_row, known_a, known_b = _stretches(row[again], a[again], b[again]) if len(again) else (row[:0], a[:0], b[:0])
            owner = np.r_[row[lone], known_row]
            start = np.r_[a[lone], known_a]
            size = np.r_[b[lone] - a[lone] + 1, known_b - known_a + 1]
            taken = pa.array(owner + first)
            none = np.zeros(len(known_row), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[bucket[lone].view(np.int64), none], mask=np.r_[np.zeros(len(lone), bool), np.ones(len(none), bool)]),
                    pa.array(np.r_[name[lone].view(np.int64), none]),
                    batch.column(0).take(taken),
                    batch.column(1).take(taken),
                    pa.array(start - offsets[owner] + base),
                    pa.array(size),
                    pa.array(np.r_[(place - a)[lone], none].astype(np.int32)),
                ],
                names=["bucket", "name", "ka", "kb", "at", "strings", "left"],
            )


KEY = ("ka", "kb")
RUN = "bucket long, name long, ka long, kb long, at long, strings long, left int"
ASKED = ("bucket", "at", "strings", "left", "solo")


def _asked(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(row, asked rows as ASKED, q-gram identifiers, where these begin) by stretches of each text."""
    column = batch.column(3).cast(pa.large_binary())
    lists = batch.column(2)
    flat = lists.flatten()
    cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    table = np.stack([flat.field(c).to_numpy().astype(np.int64) for c in ASKED], 1) if len(flat) else np.zeros((0, len(ASKED)), np.int64)
    for i in range(batch.num_rows):
        raw = np.frombuffer(column[i].as_buffer(), np.uint8)
        asked = table[cuts[i] : cuts[i + 1]]
        asked = asked[np.argsort(asked[:, 1], kind="stable")]
        j = 0
        while j < len(asked):
            low = int(asked[j, 1])
            k = int(np.searchsorted(asked[:, 1], low + CHUNK))
            part = asked[j:k]
            yield i, part, gram_ids(raw[low : int((part[:, 1] + part[:, 2]).max()) + LENGTH - 1]), low
            j = k


def _spread(size: np.ndarray) -> np.ndarray:
    """0 .. size - 1 for each size, one after the other."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells of the asked runs: (bucket: what its strings share, name: all that they cover, ka, kb, at, strings, left, solo)."""
    for batch in batches:
        for i, part, grams, low in _asked(batch):
            p, far = part[:, 1] + part[:, 3], part[:, 3]
            near = far - part[:, 2] + 1
            first = near // CELL
            count = far // CELL - first + 1
            run = np.repeat(np.arange(len(part)), count)
            cell = first[run] + _spread(count)
            lo, hi = np.maximum(cell * CELL, near[run]), np.minimum(cell * CELL + CELL - 1, far[run])
            shared = p[run] - cell * CELL - low
            z = grams[shared]
            for offset in (Q, 2 * Q, 3 * Q, LENGTH - CELL + 1 - Q):
                z = _join(z, grams[shared + offset])
            z = tv.mix64(_join(z ^ cell.astype(np.uint64), part[run, 0].view(np.uint64)))
            start, end = p[run] - hi, p[run] - lo
            name = tv.mix64(_join(string_ids(grams, start - low), string_ids(grams, end - low)) + ((end - start) * 1024 + hi).astype(np.uint64))
            n = len(run)
            yield pa.RecordBatch.from_arrays(
                [pa.array(z.view(np.int64)), pa.array(name.view(np.int64)), pa.array(np.full(n, batch.column(0)[i].as_py())), pa.array(np.full(n, batch.column(1)[i].as_py())), pa.array(start), pa.array(end - start + 1), pa.array(hi.astype(np.int32)), pa.array(part[run, 4] == 1)],
                names=["bucket", "name", "ka", "kb", "at", "strings", "left", "solo"],
            )


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings of the asked cells: (bucket, name, ka, kb, at, solo)."""
    for batch in batches:
        for i, part, grams, low in _asked(batch):
            size = part[:, 2]
            at = _spread(size) + np.repeat(part[:, 1], size)
            ids = string_ids(grams, at - low)
            n = len(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(part[:, 0], size)), pa.array(ids.view(np.int64)), pa.array(np.full(n, batch.column(0)[i].as_py())), pa.array(np.full(n, batch.column(1)[i].as_py())), pa.array(at), pa.array(np.repeat(part[:, 4], size) == 1)],
                names=["bucket", "name", "ka", "kb", "at", "solo"],
            )


def _cut(raw: bytes, packed: list[int] | None) -> tuple[list[tuple[int, int]], bytes]:
    """The removed spans of a text, and what is left."""
    if not packed:
        return [], raw
    x = np.array(packed, np.int64)
    start, end = x >> 20, (x >> 20) + (x & ((1 << 20) - 1)) + LENGTH - 1
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    fresh = np.r_[True, start[1:] > end[:-1]]
    first = np.flatnonzero(fresh)
    spans = list(zip(start[first].tolist(), end[np.r_[first[1:], len(start)] - 1].tolist(), strict=True))
    kept, at = [], 0
    for s, e in spans:
        kept.append(raw[at:s])
        at = e
    return spans, b"".join([*kept, raw[at:]])


def _kinds(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (bucket, name, ..., solo): a row of each kind with its number ``n``, and the buckets (bucket, n) of several kinds.

    solo: false for a row that is known to occur again and only stands for its kind.
    """
    carried = (*KEY, "at", "strings", "left")
    kinds = rows.groupBy("bucket", "name").agg(F.count(F.lit(1)).alias("n"), F.min("solo").alias("solo"), *[F.first(c).alias(c) for c in carried])
    kinds = stored(kinds, "kinds")
    return kinds, stored(kinds.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "unlike")


def _unlike(kinds: DataFrame, buckets: DataFrame) -> DataFrame:
    """A row of each kind in the buckets of several."""
    left = spread_join(kinds, buckets.select("bucket"), "bucket", buckets, F.col("name"))
    return left.withColumn("solo", F.col("solo") & (F.col("n") == 1))


def _again(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """Where the rows (bucket, name, ka, kb, at, strings) of kinds (bucket, name, n) that occur twice are; one kind may have any share of them."""
    kind = F.struct("bucket", "name").alias("kind")
    twice = kinds.filter("n > 1").select(kind, "n")
    return spread_join(rows.select(kind, *KEY, "at", "strings"), twice.select("kind"), "kind", twice, F.xxhash64("ka", "at")).drop("kind")


def _looked_up(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """ka, kb, the asked rows as a list, no longer than the text, and the text: one row for each text that is asked for."""
    own = asked.select(*KEY, F.struct("bucket", "at", "strings", "left", F.col("solo").cast("int").alias("solo")).alias("x"))
    own = own.groupBy(*KEY).agg(F.collect_list("x").alias("asked"))
    return texts.join(own, list(KEY)).dropDuplicates(list(KEY)).select(*KEY, "asked", "text")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, ka and kb (names of the row), and text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_key", row_key(F.col("doc_id"), F.col("text"))).select("doc_id", F.col("_key.a").alias("ka"), F.col("_key.b").alias("kb"), "text")


def duplicated(docs: DataFrame) -> DataFrame:
    """ka, kb and packed stretches of strings (start << 20 | number) that occur elsewhere."""
    some = _keyed(docs).filter(F.octet_length("text") >= LENGTH).select(*KEY, "text")
    shared = some.select("text").mapInArrow(lambda b: _emit(b, False), "bucket long").groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = stored(shared, "buckets")
    runs = some.mapInArrow(lambda b: _emit(b, True), RUN)
    # a null bucket is a stretch that repeats within its piece; the outer join keeps it
    held = spread_join(runs, shared.select("bucket", F.lit(True).alias("_shared")), "bucket", shared, F.col("name"), "left").filter("_shared OR bucket IS NULL").drop("_shared")
    held = stored(held, "runs")
    discard(shared)
    open_runs = held.filter("bucket IS NOT NULL").withColumn("solo", F.lit(True))
    kinds, mixed = _kinds(open_runs)
    alike = _again(open_runs, kinds)

    form = "bucket long, name long, ka long, kb long, at long, strings long, left int, solo boolean"
    cells = stored(_looked_up(some, _unlike(kinds, mixed)).mapInArrow(_cells, form), "cells")
    cell_kinds, cells_mixed = _kinds(cells)
    alike_cells = _again(cells.filter("solo"), cell_kinds)

    form = "bucket long, name long, ka long, kb long, at long, solo boolean"
    strings = stored(_looked_up(some, _unlike(cell_kinds, cells_mixed)).mapInArrow(_strings, form), "strings")
    twice = strings.groupBy("bucket", "name").agg(F.count(F.lit(1)).alias("n"))
    single = _again(strings.filter("solo").withColumn("strings", F.lit(1).cast("long")), stored(twice.filter("n > 1"), "twice"))
    inside = held.filter("bucket IS NULL").select(*KEY, "at", "strings")
    found = alike.unionByName(alike_cells).unionByName(single).unionByName(inside)
    found = stored(found.groupBy(*KEY).agg(F.collect_set(F.shiftleft("at", 20).bitwiseOR(F.col("strings"))).alias("found")), "found")
    discard(held, kinds, mixed, cells, cell_kinds, cells_mixed, strings)
    return found


def remove_repeats(docs: DataFrame, with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans of every document; with_bytes: also what is left."""
    rows = _keyed(docs).join(duplicated(docs), list(KEY), "left").select("doc_id", "found", "text")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for packed, text in zip(batch.column(1), batch.column(2).cast(pa.large_binary()), strict=True):
                raw = text.as_py() or b""
                spans, kept = _cut(raw, packed.as_py())
                for into, x in zip(out, (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": s, "end": e} for s, e in spans], kept), strict=True):
                    into.append(x)
            columns = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string()), pa.array(out[4], span)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
            if with_bytes:
                columns, names = [*columns, pa.array(out[5], pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>"
    return rows.mapInArrow(cut, schema + (", kept binary" if with_bytes else ""))
