"""Vectorised word hashing over Arrow string columns.

Texts are taken as UTF-8 bytes straight from the Arrow buffers.  A chunk joins
many short texts (or holds one long text) so that the numpy calls are paid per
chunk, not per document.  Null texts count as empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: space and the ASCII controls from tab to carriage return
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

_ODD = U64(0x9E3779B97F4A7C15)
_BASE = U64(0xD6E8FEB86659FD93)
_BYTE_CODE = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_POWERS = np.ones(1, U64)
#: bytes hashed at a time, and the longest span that is hashed as a whole
PIECE, LONG = 1 << 18, 1 << 16


def mix64(x: np.ndarray | np.uint64) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U64(27))
        x = x * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def powers(n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64 (kept between calls)."""
    global _POWERS
    if len(_POWERS) < n:
        m = 1 << (n - 1).bit_length()
        p = np.full(m, _BASE, U64)
        p[0] = 1
        with np.errstate(over="ignore"):
            _POWERS = np.multiply.accumulate(p)
    return _POWERS[:n]


def chunks(column: pa.Array, target_bytes: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, bytes) of runs of rows of about ``target_bytes``.

    ``offsets`` starts at 0 and has one entry more than the run has rows; the
    text of the run's i-th row is ``bytes[offsets[i]:offsets[i + 1]]``.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + target_bytes, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, offsets[i : j + 1] - offsets[i], raw[offsets[i] : offsets[j]]
        i = j


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case; every other byte as it is."""
    return np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)


def runs(kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of one non-zero kind within a row."""
    n = len(kind)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.empty(n + 1, bool)
    change[0] = change[n] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:n])
    change[offsets] = True
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    keep = kind[starts] != 0
    return starts[keep], ends[keep]


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each of the disjoint, ascending spans.

    Works on PIECE bytes at a time; spans over LONG bytes are hashed by blocks.
    """
    length = ends - starts
    out = np.empty(len(starts), U64)
    large = length > LONG
    if large.any():
        out[~large] = hash_spans(raw, starts[~large], ends[~large])
        for i in np.flatnonzero(large):
            cuts = np.arange(starts[i], ends[i], LONG)
            h = U64(length[i])
            for x in hash_spans(raw, cuts, np.r_[cuts[1:], ends[i]]):
                with np.errstate(over="ignore"):
                    h = mix64(h * _ODD ^ x)
            out[i] = h
        return out
    done = np.cumsum(length)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(done, done[i] - length[i] + PIECE, "right")))
        out[i:j] = _hash_some(raw, starts[i:j], length[i:j])
        i = j
    return out


def _hash_some(raw: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    total = int(length.sum())
    first = np.cumsum(length) - length
    within = np.arange(total, dtype=np.int64) - np.repeat(first, length)
    at = within + np.repeat(starts, length)
    with np.errstate(over="ignore"):
        terms = _BYTE_CODE[raw[at]] * powers(int(length.max()))[within]
        return mix64(np.add.reduceat(terms, first) + length.astype(U64) * _ODD)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start, end) of every word, a run without separators."""
    starts, ends = runs((~SEPARATOR[raw]).view(np.uint8), offsets)
    rows = np.searchsorted(offsets, starts, "right") - 1
    return hash_spans(raw, starts, ends), rows, starts, ends


def windows(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every window of n words that stays in one row."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out = np.zeros(m, U64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ hashes[k : k + m]) * (_ODD + U64(2 * k)) + (out >> U64(29))
    at = np.flatnonzero(rows[:m] == rows[n - 1 :])
    return mix64(out[at]), at
