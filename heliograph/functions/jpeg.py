"""A baseline JPEG writer in numpy: three full-size components, and Huffman codes made for the image."""

from __future__ import annotations

import heapq
import struct

import numpy as np

#: steps of the coefficients of brightness and of color at quality 50, by rows (fixed values)
STEPS = (
    "16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62 "
    "18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99",
    "17 18 24 47 99 99 99 99 18 21 26 66 99 99 99 99 24 26 56 99 99 99 99 99 47 66 99 99 99 99 99 99" + " 99" * 32,
)
LONGEST_CODE = 16
#: RGB to brightness and two colors (fixed values)
COLORS = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])
#: coefficients by diagonals, in turns from either end
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
_K = np.arange(8)
COSINES = np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16) * np.where(_K == 0, np.sqrt(1 / 8), 0.5)[:, None]
#: places in a block: its first value, then a value (after its runs of 16 zeros), and its end
_A_VALUE, _END, _BLOCK = 4, 64 * 4, 65 * 4


def _steps(quality: int) -> list[np.ndarray]:
    scale = 200 - 2 * quality if quality >= 50 else 5000 // quality
    return [np.clip((np.array(t.split(), int) * scale + 50) // 100, 1, 255) for t in STEPS]


def _coefficients(image: np.ndarray, quality: int) -> np.ndarray:
    """Blocks x 64 whole numbers: of each 8 x 8 pixels, the three components one after the other."""
    h, w = image.shape[:2]
    whole = np.pad(image.astype(np.float64), ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge")
    parts = whole @ COLORS.T
    parts[:, :, 0] -= 128
    blocks = parts.reshape(whole.shape[0] // 8, 8, whole.shape[1] // 8, 8, 3).transpose(0, 2, 4, 1, 3).reshape(-1, 3, 8, 8)
    waves = COSINES @ blocks @ COSINES.T
    light, color = _steps(quality)
    return np.rint(waves.reshape(-1, 3, 64) / np.stack([light, color, color])).astype(np.int64).reshape(-1, 64)[:, ZIGZAG]


def code_lengths(counts: np.ndarray) -> dict[int, int]:
    """Bits of each symbol that occurs; a place is left so that no code is all ones."""
    symbols = sorted(np.flatnonzero(counts).tolist(), key=lambda s: -counts[s])
    weights = [*counts[symbols].tolist(), 1]
    while True:
        heap = [(n, k, (k,)) for k, n in enumerate(weights)]
        depth = [0] * len(weights)
        heapq.heapify(heap)
        while len(heap) > 1:
            (m, _, a), (n, k, b) = heapq.heappop(heap), heapq.heappop(heap)
            for leaf in a + b:
                depth[leaf] += 1
            heapq.heappush(heap, (m + n, k, a + b))
        if max(depth) <= LONGEST_CODE:
            break
        weights = [n // 2 + 1 for n in weights]  # flatter, so the tree is
    return dict(zip(symbols, sorted(depth), strict=False))  # the longest is the place left


def _codes(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(code and bits of each symbol, and the table's bytes)."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    code, bits = np.zeros(256, np.int64), np.zeros(256, np.int64)
    at = before = 0
    for s in order:
        at <<= lengths[s] - before
        before = lengths[s]
        code[s], bits[s] = at, before
        at += 1
    return code, bits, bytes(np.bincount(list(lengths.values()), minlength=LONGEST_CODE + 1)[1:].tolist()) + bytes(order)


def _size(x: np.ndarray) -> np.ndarray:
    """Bits of the magnitude."""
    return np.frexp(np.abs(x).astype(np.float64))[1].astype(np.int64)


def jpeg(image: np.ndarray, quality: int = 84) -> bytes:
    """An RGB image (height x width x 3 bytes) as a JPEG file."""
    blocks = _coefficients(image, quality)
    n = len(blocks)
    first = blocks[:, 0].reshape(-1, 3)
    steps = np.diff(first, axis=0, prepend=0).reshape(-1)
    own, place = np.nonzero(blocks[:, 1:])
    values, place = blocks[own, place + 1], place + 1
    starts = np.r_[True, own[1:] != own[:-1]] if len(own) else np.zeros(0, bool)
    run = place - np.where(starts, 0, np.r_[0, place[:-1]][: len(place)]) - 1
    full = run // 16
    last = np.zeros(n, np.int64)
    np.maximum.at(last, own, place)
    open_ = np.flatnonzero(last < 63)
    # (place in the file, symbol, value) of first values, runs of 16 zeros, values and ends
    skip = np.repeat(np.arange(len(own)), full)
    nth = np.arange(len(skip)) - np.repeat(np.cumsum(full) - full, full)
    at = np.concatenate([np.arange(n) * _BLOCK, own[skip] * _BLOCK + place[skip] * _A_VALUE + nth, own * _BLOCK + place * _A_VALUE + 3, open_ * _BLOCK + _END])
    symbol = np.concatenate([_size(steps), np.full(len(skip), 0xF0), (run % 16) * 16 + _size(values), np.zeros(len(open_), np.int64)])
    extra = np.concatenate([steps, np.zeros(len(skip), np.int64), values, np.zeros(len(open_), np.int64)])
    is_first = np.arange(len(at)) < n
    tables, code, bits = [], np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for kind, some in ((0x00, is_first), (0x10, ~is_first)):
        c, b, table = _codes(code_lengths(np.bincount(symbol[some], minlength=256)))
        code[some], bits[some] = c[symbol[some]], b[symbol[some]]
        tables.append(bytes([kind]) + table)
    more = _size(extra)
    word = (code << more) | np.where(extra < 0, extra + (1 << more) - 1, extra)
    order = np.argsort(at, kind="stable")
    word, width = word[order], (bits + more)[order]
    which = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    stream = (np.repeat(word, width) >> (np.repeat(width, width) - 1 - which)) & 1
    stream = np.r_[stream, np.ones(-len(stream) % 8, np.int64)].astype(np.uint8)
    body = np.packbits(stream).tobytes().replace(b"\xff", b"\xff\x00")

    def segment(kind: int, data: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, kind, len(data) + 2) + data

    h, w = image.shape[:2]
    return b"".join(
        [
            b"\xff\xd8",
            segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"),
            *[segment(0xDB, bytes([k, *t[ZIGZAG].tolist()])) for k, t in enumerate(_steps(quality))],
            segment(0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes([1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1])),
            *[segment(0xC4, t) for t in tables],
            segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])),
            body,
            b"\xff\xd9",
        ]
    )
