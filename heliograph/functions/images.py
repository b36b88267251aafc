"""Image kernels in numpy, applied through Arrow to decoded images.

An image is height x width x channels bytes, RGB or RGBA.  Spark's image source
gives BGR or BGRA rows; ``pixels`` turns them round.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .jpeg import jpeg

SIDE = 224
#: means and deviations of the image model's channels (fixed values)
MEAN = np.array([0.48145466, 0.4578275, 0.40821073], np.float32)
DEVIATION = np.array([0.26862954, 0.26130258, 0.27577711], np.float32)
VISIBLE, MATTE, FIT = 8, 128, 208
#: weights of a descriptor's groups: colors, alpha, histogram, gradients, luminance (fixed values)
GROUP_WEIGHTS = (0.30, 0.15, 0.20, 0.20, 0.15)
GROUP_ENDS = (0, 192, 256, 320, 448, 512)
THUMBNAIL = (420, 320)
#: the EXIF tag of the orientation (fixed value)
ORIENTATION = 0x0112


def pixels(data: bytes, height: int, width: int, channels: int, turn: int = 1) -> np.ndarray:
    """The image as shown, height x width; turn: how its rows are stored, 1 to 8 (see ``orientation``)."""
    a = np.frombuffer(data, np.uint8).reshape(*((width, height) if turn > 4 else (height, width)), channels)
    if turn > 4:
        a = a.transpose(1, 0, 2)
    a = a[:: -1 if turn in (3, 4, 7, 8) else 1, :: -1 if turn in (2, 3, 6, 7) else 1]
    if channels == 1:
        return np.repeat(a, 3, 2)
    return a[:, :, [2, 1, 0, 3][:channels]]


def orientation(head: bytes) -> int:
    """The EXIF orientation (1 to 8) in the first segments of a JPEG file; 1 where none is stated or the header is broken."""
    at = 2
    while head[:2] == b"\xff\xd8" and head[at : at + 1] == b"\xff" and at + 4 <= len(head):
        size = int.from_bytes(head[at + 2 : at + 4], "big")
        tiff = head[at + 10 : at + 2 + size]
        if head[at + 1] == 0xE1 and head[at + 4 : at + 10] == b"Exif\0\0" and tiff[:2] in (b"II", b"MM"):
            number = lambda x, n: int.from_bytes(tiff[x : x + n], "little" if tiff[:2] == b"II" else "big")  # noqa: B023, E731
            first = number(4, 4)
            entries = range(first + 2, min(first + 2 + 12 * number(first, 2), len(tiff) - 11), 12)
            found = next((number(x + 8, 2) for x in entries if number(x, 2) == ORIENTATION), 1)
            return found if 1 <= found <= 8 else 1
        if head[at + 1] == 0xDA or size < 2:  # the image itself
            break
        at += 2 + size
    return 1


@lru_cache(64)
def _cubic_weights(source: int, scaled: int, offset: int, count: int) -> tuple[int, np.ndarray]:
    """(first source place, count x places) integer weights of an antialiased cubic resize, in units of 2 ** -22."""
    scale = source / scaled
    reach = max(1.0, scale)
    center = (np.arange(count) + offset + 0.5) * scale
    lo = np.maximum(0, np.floor(center - 2 * reach + 0.5)).astype(np.int64)
    hi = np.minimum(source, np.floor(center + 2 * reach + 0.5)).astype(np.int64)
    first, last = int(lo.min()), int(hi.max())
    place = np.arange(first, last)
    t = np.abs((place[None, :] - center[:, None] + 0.5) / reach)
    w = np.where(t < 1, (1.5 * t - 2.5) * t * t + 1, np.where(t < 2, ((-0.5 * t + 2.5) * t - 4) * t + 2, 0.0))
    w[(place[None, :] < lo[:, None]) | (place[None, :] >= hi[:, None])] = 0
    w = w / w.sum(1, keepdims=True) * (1 << 22)
    return first, np.trunc(w + np.where(w < 0, -0.5, 0.5)).astype(np.int64)


def _resample(a: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted sums along the first axis, rounded to bytes."""
    flat = a.reshape(len(a), -1).astype(np.float64)  # sums stay under 2 ** 53, so they are exact
    total = np.zeros((len(weights), flat.shape[1]))
    for i, row in enumerate(weights):
        some = np.flatnonzero(row)
        total[i] = row[some].astype(np.float64) @ flat[some]
    out = (total.astype(np.int64) + (1 << 21)) >> 22
    return np.clip(out, 0, 255).astype(np.uint8).reshape(len(weights), *a.shape[1:])


def _area(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """A smooth resize: box averages when shrinking, linear between pixels when growing."""

    def along(x: np.ndarray, n: int) -> np.ndarray:
        m = len(x)
        if n < m:
            sums = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, 0)])
            edge = np.arange(n + 1) * m / n
            low = np.minimum(edge.astype(int), m - 1)
            at = sums[low] + (edge - low)[:, None, None] * x[low]
            return (at[1:] - at[:-1]) * (n / m)
        place = np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
        low = np.minimum(place.astype(int), max(m - 2, 0))
        part = (place - low)[:, None, None]
        return x[low] * (1 - part) + x[np.minimum(low + 1, m - 1)] * part

    out = along(a.astype(np.float64), height)
    return along(out.transpose(1, 0, 2), width).transpose(1, 0, 2)


def _bounds(alpha: np.ndarray) -> tuple[int, int, int, int] | None:
    rows, columns = np.flatnonzero((alpha > VISIBLE).any(1)), np.flatnonzero((alpha > VISIBLE).any(0))
    return (rows[0], rows[-1] + 1, columns[0], columns[-1] + 1) if len(rows) else None


def _fit(height: int, width: int, most_h: int, most_w: int) -> tuple[int, int]:
    k = min(most_h / height, most_w / width)
    return max(1, int(height * k)), max(1, int(width * k))


def _premultiplied(a: np.ndarray) -> np.ndarray:
    alpha = a[:, :, 3:].astype(np.float64)
    return np.concatenate([a[:, :, :3] * alpha / 255, alpha], 2)


def model_input(image: np.ndarray) -> np.ndarray:
    """3 x SIDE x SIDE floats: the short side at SIDE, the middle, channels normalised.

    A transparent image is cut to what is visible and set on a grey matte whole.
    """
    if image.size == 0:
        raise ValueError("Cannot embed an empty image")
    if image.shape[2] == 4 and (image[:, :, 3] != 255).any():
        matte = np.full((SIDE, SIDE, 3), float(MATTE))
        box = _bounds(image[:, :, 3])
        if box:
            part = image[box[0] : box[1], box[2] : box[3]]
            h, w = _fit(*part.shape[:2], FIT, FIT)
            small = _area(_premultiplied(part), h, w)
            y, x = (SIDE - h) // 2, (SIDE - w) // 2
            matte[y : y + h, x : x + w] = small[:, :, :3] + matte[y : y + h, x : x + w] * (1 - small[:, :, 3:] / 255)
        rgb = np.clip(np.rint(matte), 0, 255).astype(np.uint8)
    else:
        rgb = image[:, :, :3]
    h, w = rgb.shape[:2]
    if (h, w) != (SIDE, SIDE):
        scale = float(SIDE) / min(h, w)
        dh, dw = int(h * scale), int(w * scale)
        first, columns = _cubic_weights(w, dw, (dw - SIDE) // 2, SIDE)
        top, rows = _cubic_weights(h, dh, (dh - SIDE) // 2, SIDE)
        band = rgb[top : top + rows.shape[1], first : first + columns.shape[1]]
        across = _resample(np.ascontiguousarray(band.transpose(1, 0, 2)), columns)
        rgb = _resample(np.ascontiguousarray(across.transpose(1, 0, 2)), rows)
    values = (rgb.astype(np.float32) / np.float32(255) - MEAN) / DEVIATION
    return np.ascontiguousarray(values.transpose(2, 0, 1))


# fixed values of the descriptor: a canvas of 32 x 32 and its mean over 8 x 8; alpha from 0.03 on counts as shown; four levels a
# channel; luminance weights 0.2126, 0.7152, 0.0722, and 11, 16, 5 of 32 for whole numbers; eight directions in cells of 8 x 8
def descriptor(image: np.ndarray) -> np.ndarray:
    """512 floats at length 1: coarse colors, silhouette, color histogram, edge directions, luminance.

    Scaling is by area, so values agree with other implementations in kind, not
    bit by bit.
    """
    if image.size == 0:
        raise ValueError("Cannot describe an empty image")
    if image.shape[2] == 4:
        box = _bounds(image[:, :, 3])
        if box:
            image = image[box[0] : box[1], box[2] : box[3]]
    else:
        image = np.concatenate([image, np.full((*image.shape[:2], 1), 255, np.uint8)], 2)
    h, w = _fit(*image.shape[:2], 32, 32)
    canvas = np.zeros((32, 32, 4))
    y, x = (32 - h) // 2, (32 - w) // 2
    canvas[y : y + h, x : x + w] = np.rint(_area(_premultiplied(image), h, w))
    out = np.zeros(512)
    small = np.rint(_area(canvas, 8, 8))
    out[0:192] = small[:, :, :3].reshape(-1) / 255
    out[192:256] = small[:, :, 3].reshape(-1) / 255
    alpha = canvas[:, :, 3] / 255
    shown = alpha > 0.03
    straight = np.clip(np.rint(canvas[:, :, :3] / np.maximum(alpha, 1e-9)[:, :, None]), 0, 255).astype(int) // 64
    np.add.at(out, 256 + (straight @ np.array([16, 4, 1]))[shown], alpha[shown])
    light = canvas[:, :, :3] @ np.array([0.2126, 0.7152, 0.0722]) / 255 + 0.5 * (1 - alpha)
    dx, dy = light[1:31, 2:] - light[1:31, :-2], light[2:, 1:31] - light[:-2, 1:31]
    size, angle = np.hypot(dx, dy), (np.arctan2(dy, dx) + np.pi) * (8 / (2 * np.pi))
    turn = np.floor(angle)
    yy, xx = np.mgrid[1:31, 1:31]
    cell = 320 + ((yy // 8) * 4 + xx // 8) * 8
    np.add.at(out, cell + turn.astype(int) % 8, size * (1 - (angle - turn)))
    np.add.at(out, cell + (turn.astype(int) + 1) % 8, size * (angle - turn))
    grey = (small[:, :, 0] * 11 + small[:, :, 1] * 16 + small[:, :, 2] * 5) // 32 / 255
    luminance = (grey + 0.5 * (1 - small[:, :, 3] / 255)).reshape(-1)
    out[448:] = luminance - luminance.mean()
    for k, weight in enumerate(GROUP_WEIGHTS):
        group = slice(GROUP_ENDS[k], GROUP_ENDS[k + 1])
        norm = (out[group] ** 2).sum()
        if norm > 1e-12:
            out[group] *= np.sqrt(weight / norm)
    if (out**2).sum() < 1e-12:
        out[192] = 1
    return (out / np.sqrt((out**2).sum())).astype(np.float32)


def thumbnail(image: np.ndarray) -> bytes:
    """The image within THUMBNAIL: a PNG if it has alpha, else a JPEG."""
    h, w = image.shape[:2]
    if h > THUMBNAIL[1] or w > THUMBNAIL[0]:
        h, w = _fit(h, w, THUMBNAIL[1], THUMBNAIL[0])
        image = np.clip(np.rint(_area(image, h, w)), 0, 255).astype(np.uint8)
    return png(image) if image.shape[2] == 4 else jpeg(image)


def png(image: np.ndarray) -> bytes:
    """RGB or RGBA as a PNG."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w, c = image.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, w * c)], 1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {3: 2, 4: 6}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def described(images: DataFrame, kernel: Callable[[np.ndarray], np.ndarray] = descriptor, column: str = "descriptor") -> DataFrame:
    """images (path, width, height, channels, data, turn, error) -> path, the kernel's floats, error.

    An image that fails has its error, and the others go on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors, errors = [], []
            for row in b.to_pylist():
                try:
                    if row["error"]:
                        raise ValueError(row["error"])
                    vectors.append(np.asarray(kernel(pixels(row["data"], row["height"], row["width"], row["channels"], row["turn"]))).reshape(-1))
                    errors.append(None)
                except Exception as e:  # one bad image is one row's error
                    vectors.append(None)
                    errors.append(str(e) or type(e).__name__)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("path")), pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], names=["path", column, "error"])

    return images.select("path", "width", "height", "channels", "data", "turn", "error").mapInArrow(run, f"path string, {column} array<float>, error string")
