"""Benchmark decontamination: n-gram seeds and Smith-Waterman alignment.

Tokens are runs of letters and digits, A-Z in lower case, and single characters
of scripts without spaces (Chinese, Japanese, Thai, Lao, Myanmar, Khmer).  Every
SEED-gram of a test item is a seed, however many documents hold it, so that an edited copy is
found however often the edit is repeated.  A document is aligned with every item
it shares a seed with, around each hit; the score of the best local alignment is
divided by that of the item with itself.  Only alignments are left out whose
tokens in common cannot reach the score.  A document that shares no SEED-gram
with an item is not aligned with it.  Items of fewer than LEAST tokens are too
short to tell an edit from another text: they match, with score 1, documents that
hold all their tokens in a row (the first place counts), so an item of one word
matches every document with that word.

The test items are a query set: they are taken in blocks of about BLOCK_BYTES,
each held by every task: benchmarks up to that size take one scan of the documents,
larger ones a scan for each block.

Defined cases: null texts have no tokens; items without tokens match
nothing; a null doc_id or item_id is carried as
null; equal items match alike, and so do rows alike; no rows, or no items, give
no rows; extra columns are ignored by ``matches`` and kept by ``without_matches``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .cluster import row_key, stored, unused

SEED, LEAST = 3, 8
MATCH, MISMATCH, GAP = 2, -1, -1
SCORE = 0.4
BLOCK_BYTES = 32 << 20
CHUNK = 1 << 20
#: bits of the table that sifts n-grams before the exact search
SIEVE = 22

_KIND = np.zeros(256, np.uint8)
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
#: by the first two bytes of a character: scripts without spaces, U+2E80 to U+A4CF, U+F900 to U+FAFF, U+20000 on, and four of Asia's south-east
_LONE = np.zeros((256, 256), bool)
_LONE[0xE2, 0xBA:0xC0] = _LONE[0xE3:0xEA, 0x80:0xC0] = _LONE[0xEA, 0x80:0x94] = _LONE[0xEF, 0xA4:0xAC] = _LONE[0xF0, 0xA0:0xC0] = True
_LONE[0xE0, 0xB8:0xBC] = _LONE[0xE1, 0x80:0x83] = _LONE[0xE1, 0x9E:0xA0] = True


MATCHES = "doc_id long, tag struct<a: long, b: long>, item_id long, score double, start_byte long, end_byte long"


def tag() -> Column:
    """Names a row by its id and text."""
    return row_key(F.col("doc_id").cast("long"), F.col("text"))


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, row, start, end) of every token."""
    raw = tv.lower_ascii(raw)
    kind = _KIND[raw]
    lead = np.flatnonzero(raw[:-1] >= 0xE0)
    lead = lead[_LONE[raw[lead], raw[lead + 1]]]
    width = 3 + (raw[lead] >= 0xF0)
    fits = lead + width <= len(raw)
    lead, width = lead[fits], width[fits]
    lone = (2 + np.arange(len(lead)) % 2).astype(np.uint8)  # neighbours differ, so each is a run
    for k in range(4):
        kind[lead[k < width] + k] = lone[k < width]
    starts, ends = tv.runs(kind, offsets)
    return tv.hash_spans(raw, starts, ends), np.searchsorted(offsets, starts, "right") - 1, starts, ends


def _spread(size: np.ndarray) -> np.ndarray:
    """0 .. size - 1 for each size, one after the other."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


class Items:
    """A block of test items in flat arrays: their tokens, and the SEED-grams with the items that hold each."""

    def __init__(self, ids: list, texts: list[str | None]) -> None:
        self.ids, own_tokens = [], []
        #: items under LEAST tokens: length -> hash of the whole -> ids
        self.short: dict[int, dict[int, list]] = {}
        for i, text in zip(ids, texts, strict=True):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            own = tokens(raw, np.array([0, len(raw)]))[0]
            if len(own) >= LEAST:
                self.ids.append(i)
                own_tokens.append(own)
            elif len(own):
                whole = int(tv.windows(own, np.zeros(len(own), np.int64), len(own))[0][0])
                self.short.setdefault(len(own), {}).setdefault(whole, []).append(i)
        self.flat = np.concatenate(own_tokens) if own_tokens else np.zeros(0, np.uint64)
        self.cuts = np.cumsum([0, *map(len, own_tokens)])
        #: each token by its place among the distinct ones
        self.words, self.flat_words = np.unique(self.flat, return_inverse=True)
        item = np.repeat(np.arange(len(own_tokens)), np.diff(self.cuts))
        grams, at = tv.windows(self.flat, item, SEED)
        self.grams, place = np.unique(grams, return_inverse=True)
        held = np.unique(np.stack([place, item[at]]), axis=1) if len(grams) else np.zeros((2, 0), np.int64)
        self.holders = held[1].astype(np.int32)
        self.holder_cuts = np.searchsorted(held[0], np.arange(len(self.grams) + 1))

    def tokens(self, item: int) -> np.ndarray:
        return self.flat[self.cuts[item] : self.cuts[item + 1]]

    def sieve(self) -> np.ndarray:
        table = np.zeros(1 << SIEVE, bool)
        table[(self.grams & tv.U64((1 << SIEVE) - 1)).astype(np.int64)] = True
        return table

    def candidates(self, text: np.ndarray, place: np.ndarray, at: np.ndarray, least: float, marks: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item, first tokens of the hits) of the items that one text shares a gram with and enough tokens for the score.

        marks: one False for each distinct token, and left so.
        """
        size = self.holder_cuts[place + 1] - self.holder_cuts[place]
        item = self.holders[np.repeat(self.holder_cuts[place], size) + _spread(size)]
        order = np.argsort(item, kind="stable")
        item, hit = item[order], np.repeat(at, size)[order]
        cuts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
        some = item[cuts]
        own = np.unique(text)
        seen = np.searchsorted(self.words, own)
        seen[seen == len(self.words)] = 0
        seen = seen[self.words[seen] == own]
        marks[seen] = True
        lengths = self.cuts[some + 1] - self.cuts[some]
        held = marks[self.flat_words[np.repeat(self.cuts[some], lengths) + _spread(lengths)]]
        enough = MATCH * np.add.reduceat(held.astype(np.int64), np.cumsum(lengths) - lengths) >= least * MATCH * lengths
        marks[seen] = False
        ends = np.r_[cuts[1:], len(item)]
        for k in np.flatnonzero(enough).tolist():
            yield int(some[k]), hit[cuts[k] : ends[k]]


def hits(hashes: np.ndarray, rows: np.ndarray, items: Items, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gram, first token) of every SEED-gram that an item has."""
    grams, at = tv.windows(hashes, rows, SEED)
    some = np.flatnonzero(sieve[(grams & tv.U64((1 << SIEVE) - 1)).astype(np.int64)])
    grams, at = grams[some], at[some]
    place = np.searchsorted(items.grams, grams)
    place[place == len(items.grams)] = 0
    good = items.grams[place] == grams if len(items.grams) else np.zeros(len(grams), bool)
    return place[good], at[good]


def short_hits(hashes: np.ndarray, rows: np.ndarray, items: Items) -> Iterator[tuple[int, int, int, object]]:
    """(row, first token, token after the last, item id) of the first place of every short item in a row."""
    for n, ids in items.short.items():
        grams, at = tv.windows(hashes, rows, n)
        some = np.flatnonzero(np.isin(grams, np.array(list(ids), np.uint64)))
        seen = set()
        for g, p in zip(grams[some].tolist(), at[some].tolist(), strict=True):
            row = int(rows[p])
            if (row, g) not in seen:
                seen.add((row, g))
                for i in ids[g]:
                    yield row, p, p + n, i


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: the best local score and the tokens of text, [start, end), that it spans."""
    n = len(text)
    ramp = np.arange(n + 1, dtype=np.int64) * -GAP
    score, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best, span = 0, (0, 0)
    for word in item:
        diagonal = score[:-1] + np.where(text == word, MATCH, MISMATCH)
        up = score[1:] + GAP
        step = np.maximum(diagonal, up)
        from_ = np.where(diagonal >= up, origin[:-1], origin[1:])
        here = np.arange(1, n + 1)
        from_ = np.where(step > 0, from_, here)
        step = np.r_[0, np.maximum(step, 0)]
        # gaps along the text: the best of all earlier places less the way from there
        lifted = step + ramp
        reach = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == reach, np.arange(n + 1), 0))
        origin = np.r_[0, from_][source]
        score = reach - ramp
        k = int(score.argmax())
        if score[k] > best:
            best, span = int(score[k]), (int(origin[k]), k)
    return best, *span


def _regions(at: np.ndarray, reach: int, total: int) -> list[tuple[int, int]]:
    """Stretches of tokens within reach of the hits, joined where they overlap."""
    out: list[tuple[int, int]] = []
    for p in np.unique(at).tolist():
        lo, hi = max(0, p - reach), min(total, p + SEED + reach)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def best_match(item: np.ndarray, text: np.ndarray, at: np.ndarray, least: float) -> tuple[float, int, int]:
    """The best alignment of an item around its hits: (score, first token, last token + 1)."""
    full = MATCH * len(item)
    found = (0.0, 0, 0)
    for lo, hi in _regions(at, len(item) + len(item) // 2, len(text)):
        region = text[lo:hi]
        if MATCH * np.isin(item, region).sum() < least * full:  # no alignment can reach the score
            continue
        score, s, e = align(item, region)
        if score / full > found[0]:
            found = (score / full, lo + s, lo + e)
    return found


def _block(docs: DataFrame, items: Items, least: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tag().alias("tag"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        sieve, marks = block.sieve(), np.zeros(len(block.words), bool)
        for b in batches:
            out: list[tuple] = []
            for first, offsets, raw in tv.chunks(b.column(2), CHUNK):
                hashes, owner, starts, ends = tokens(raw, offsets)
                place, at = hits(hashes, owner, block, sieve)
                of_hit = owner[at]
                cuts = np.searchsorted(owner, np.arange(len(offsets)))
                for row in np.unique(of_hit).tolist():
                    lo, some = int(cuts[row]), slice(*np.searchsorted(of_hit, [row, row + 1]).tolist())
                    text, base = hashes[lo : cuts[row + 1]], int(offsets[row])
                    for item, places in block.candidates(text, place[some], at[some] - lo, least, marks):
                        score, s, e = best_match(block.tokens(item), text, places, least)
                        if score >= least:
                            out.append((b.column(0)[first + row].as_py(), b.column(1)[first + row].as_py(), block.ids[item], score, int(starts[lo + s]) - base, int(ends[lo + e - 1]) - base))
                for row, s, e, i in short_hits(hashes, owner, block):
                    base = int(offsets[row])
                    out.append((b.column(0)[first + row].as_py(), b.column(1)[first + row].as_py(), i, 1.0, int(starts[s]) - base, int(ends[e - 1]) - base))
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = [pa.int64(), pa.struct([("a", pa.int64()), ("b", pa.int64())]), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "tag", "item_id", "score", "start_byte", "end_byte"])

    return stored(texts.mapInArrow(run, MATCHES), "matches")


def matches(docs: DataFrame, benchmark: DataFrame, least: float = SCORE) -> DataFrame:
    """A row for each document and item that align: doc_id, tag, item_id, score (0 to 1), and the bytes spanned."""
    spark = docs.sparkSession
    items = benchmark.filter("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    blocks = max(1, -(-total // BLOCK_BYTES))
    out = None
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        held = Items([r["item_id"] for r in part], [r["text"] for r in part])
        if held.ids or held.short:
            found = _block(docs, held, least)
            out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], MATCHES)
    return out


def without_matches(docs: DataFrame, benchmark: DataFrame, least: float = SCORE) -> DataFrame:
    """The rows of docs, all their columns, that align with no item."""
    names = docs.columns
    own, theirs = unused(docs, "_own", "_theirs")
    bad = matches(docs, benchmark, least).select(F.col("tag").alias(theirs)).distinct()
    return docs.withColumn(own, tag()).join(bad, F.col(own) == F.col(theirs), "left_anti").select(*names)
