import numpy as np
import pytest

from heliograph.functions import images, jpeg
from heliograph.sources import files

RNG = np.random.default_rng(7)


def smooth(h, w):
    y, x = np.mgrid[:h, :w]
    return np.stack([x * 255 // max(1, w - 1), y * 255 // max(1, h - 1), (x + y) * 255 // max(1, h + w - 2)], 2).astype(np.uint8)


PICTURES = {
    "smooth": smooth(97, 131),
    "one": smooth(1, 1),
    "row": smooth(1, 70),
    "flat": np.full((16, 16, 3), 200, np.uint8),
    "black": np.zeros((9, 8, 3), np.uint8),
    "noise": RNG.integers(0, 256, (64, 80, 3), np.uint8),
    "sparse": np.where((np.mgrid[:64, :64].sum(0) % 31 == 0)[:, :, None], 255, 30).astype(np.uint8).repeat(3, 2),
}


def test_decoded(spark, tmp_path):
    """Another decoder reads what was written, near the picture; the coarser the steps the farther."""
    for name, a in PICTURES.items():
        for quality in (20, 84, 100):
            (tmp_path / f"{name}-{quality}.jpg").write_bytes(jpeg.jpeg(a, quality))
    rows = {r.path.rsplit("/", 1)[1][:-4]: r for r in files.images(spark, f"file://{tmp_path}").collect()}
    assert len(rows) == 3 * len(PICTURES)
    for name, a in PICTURES.items():
        far = {}
        for quality in (20, 84, 100):
            r = rows[f"{name}-{quality}"]
            assert (r.error, r.height, r.width) == (None, *a.shape[:2]), name
            far[quality] = np.abs(images.pixels(r.data, r.height, r.width, r.channels).astype(int) - a).mean()
        assert far[100] <= 2, (name, far)
        assert far[84] < (25 if name == "noise" else 8), (name, far)
        assert far[100] <= far[20] + 0.5, (name, far)


@pytest.mark.parametrize("counts", [[5], [1, 1], [0, 7, 0, 1], [2**k for k in range(30)], list(range(256)), [1] * 256])
def test_code_lengths(counts):
    """Every symbol has a code of 16 bits at most, and with the place left the codes just fit."""
    lengths = jpeg.code_lengths(np.array(counts + [0] * (256 - len(counts))))
    assert set(lengths) == {k for k, n in enumerate(counts) if n}
    assert max(lengths.values()) <= 16 and sum(2.0 ** -x for x in lengths.values()) < 1
    assert all(lengths[a] <= lengths[b] for a in lengths for b in lengths if counts[a] > counts[b])


def test_thumbnails():
    """A photograph's is a JPEG, that of an image with alpha a PNG, both within their frame."""
    photo, clear = images.thumbnail(smooth(800, 600)), images.thumbnail(np.dstack([smooth(50, 60), np.full((50, 60), 9, np.uint8)]))
    assert photo[:3] == b"\xff\xd8\xff" and clear[:4] == b"\x89PNG"
    at = photo.index(b"\xff\xc0")
    h, w = int.from_bytes(photo[at + 5 : at + 7], "big"), int.from_bytes(photo[at + 7 : at + 9], "big")
    assert h <= 320 and w <= 420 and (h == 320 or w == 420)
