import hashlib
import struct

import numpy as np
import pytest

from heliograph.functions import bpe, images
from heliograph.operators import dml
from heliograph.schema import ITEMS, THUMBNAILS, Similarity
from heliograph.sources import files
from heliograph.streaming import watch

from .test_search import item


def flat(color, size=64, alpha=None):
    a = np.zeros((size, size, 3 if alpha is None else 4), np.uint8)
    a[:, :, :3] = color
    if alpha is not None:
        a[:, :, 3] = alpha
    return a


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "lib"
    (root / "sub").mkdir(parents=True)
    for name, color in {"red.png": (255, 0, 0), "sub/blue.PNG": (0, 0, 255)}.items():
        (root / name).write_bytes(images.png(flat(color)))
    (root / "alpha.png").write_bytes(images.png(flat((9, 9, 9), 8, 100)))
    (root / "broken.png").write_bytes(b"not an image")
    (root / "notes.txt").write_text("x")
    return root


def test_scan(spark, folder):
    rows, reachable, errors = files.scan(spark, [f"file://{folder}", f"file://{folder}/sub", f"file://{folder}/none"])
    assert len(reachable) == 2 and len(errors) == 1 and "stays" in errors[0]
    out = dml.first_root_wins(rows).collect()
    assert sorted(r.name for r in out) == ["alpha.png", "blue.PNG", "broken.png", "red.png"]
    assert {r.ordinal for r in out} == {0} and all(r.bytes > 0 and r.modified > 10**12 for r in out)
    assert files.scan(spark, [])[0].count() == 0


def test_images_and_errors(spark, folder):
    rows = files.images(spark, f"file://{folder}")
    out = {r.path.rsplit("/", 1)[1]: r for r in images.described(rows.filter("path not like '%.txt'")).collect()}
    assert out["broken.png"].error and out["broken.png"].descriptor is None
    assert len(out["red.png"].descriptor) == 512 and out["red.png"].error is None and len(out["alpha.png"].descriptor) == 512
    red = [r for r in rows.collect() if r.path.endswith("red.png")][0]
    assert images.pixels(red.data, red.height, red.width, red.channels)[0, 0].tolist() == [255, 0, 0]


def exif(turn, order="<"):
    """A segment that states an orientation."""
    tiff = {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HIHHHIIHHIHHI", 42, 8, 2, 0x0100, 3, 1, 7, 0x0112, 3, 1, turn, 0, 0)
    return b"\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("turn", range(1, 9))
def test_orientation(turn, order):
    jfif = b"\xff\xe0" + struct.pack(">H", 16) + bytes(14)
    for head in (exif(turn, order), jfif + exif(turn, order)):
        assert images.orientation(b"\xff\xd8" + head + b"\xff\xda\0\2") == turn
    shown = np.arange(6, dtype=np.uint8).reshape(2, 3, 1)
    ways = [lambda a: a, lambda a: a[:, ::-1], lambda a: a[::-1, ::-1], lambda a: a[::-1], lambda a: a.swapaxes(0, 1), lambda a: np.rot90(a), lambda a: a[::-1, ::-1].swapaxes(0, 1), lambda a: np.rot90(a, -1)]
    stored = np.ascontiguousarray(ways[turn - 1](shown))  # what a camera that is held so writes
    assert (images.pixels(stored.tobytes(), 2, 3, 1, turn)[:, :, :1] == shown).all()


@pytest.mark.parametrize("head", [b"", b"\xff\xd8", b"\xff\xd8\xff\xe1", b"\xff\xd8\xff\xe1\0\0", b"\x89PNG", b"\xff\xd8" + exif(9), b"\xff\xd8" + exif(6)[:20], b"\xff\xd8\xff\xda\0\4" + exif(6)])
def test_no_orientation(head):
    assert images.orientation(head) == 1


def test_turned_photographs(spark, tmp_path):
    """A photograph from a camera on its side is upright, also without its neighbours being JPEG."""
    jvm = spark.sparkContext._jvm
    plain = jvm.java.awt.image.BufferedImage(48, 32, 1)
    for x in range(24):
        for y in range(32):
            plain.setRGB(x, y, 0xFF0000)
    at = tmp_path / "upright.jpg"
    assert jvm.javax.imageio.ImageIO.write(plain, "jpg", jvm.java.io.File(str(at)))
    raw = at.read_bytes()
    (tmp_path / "side.JPEG").write_bytes(raw[:2] + exif(6) + raw[2:])
    (tmp_path / "other.png").write_bytes(images.png(flat((1, 2, 3))))
    for where in (f"file://{tmp_path}", [f"file://{tmp_path}/{n}" for n in ("upright.jpg", "side.JPEG", "other.png")]):
        out = {r.path.rsplit("/", 1)[1]: r for r in files.images(spark, where).collect()}
        assert {n: (r.width, r.height, r.turn) for n, r in out.items()} == {"upright.jpg": (48, 32, 1), "side.JPEG": (32, 48, 6), "other.png": (64, 64, 1)}
        a = images.pixels(out["side.JPEG"].data, 48, 32, 3, 6)
        assert a[:20, :, 0].min() > 150 and a[28:, :, 0].max() < 100  # its left half is on top
    assert files.images(spark, [f"file://{tmp_path}/other.png"]).head().turn == 1


#: SHA-256 of the model input of a pattern, by width and height (fixed values)
INPUTS = {
    (224, 4096): "e3f3d75f5ac33fb38cac7643eaa87ee68df4561e5bb9d6a8c6ec3a3bfb870923",
    (4096, 224): "7a2cd40d5ec5730720fafc014d82ff0c0341f20818c1a3f2491a810ce2ea92d7",
    (301, 233): "166c581f1341e5c673829f60d0d2f69883d7ab403792ef03de01a7e3a0d6d666",
    (233, 301): "9b758de9815bc3053a6ea4d06fcba25912985237d7272d57e7647bb4f758ec19",
    (17, 4097): "6df8ede7847a6df126344da0ac24c7761f02287b258709d4a0a891a7cc5350a8",
}


@pytest.mark.parametrize("size", INPUTS)
def test_model_input(size):
    w, h = size
    y, x = np.mgrid[0:h, 0:w]
    pattern = np.stack([(x * 17 + y * 13) % 256, (x * 3 + y * 19) % 256, (x * 11 + y * 7) % 256], 2).astype(np.uint8)
    assert hashlib.sha256(images.model_input(pattern).tobytes()).hexdigest() == INPUTS[size]


def test_model_input_of_thin_and_transparent_images():
    assert images.model_input(np.zeros((1_000_000, 1, 3), np.uint8)).shape == (3, 224, 224)
    grey = images.model_input(flat((255, 0, 0), 10, 0))
    assert np.allclose(grey[0], (128 / 255 - images.MEAN[0]) / images.DEVIATION[0])
    shown = flat((255, 0, 0), 40, 0)
    shown[10:20, 5:30, 3] = 255
    middle = images.model_input(shown)[:, 112, 112] * images.DEVIATION + images.MEAN
    assert middle == pytest.approx([1, 0, 0], abs=0.01)
    with pytest.raises(ValueError):
        images.model_input(np.zeros((0, 0, 3), np.uint8))


def ellipse(size, color, alpha=True):
    y, x = np.mgrid[0:size, 0:size]
    inside = ((x - size / 2) / (size / 2.2)) ** 2 + ((y - size / 2) / (size / 3.2)) ** 2 < 1
    a = np.zeros((size, size, 4), np.uint8)
    a[inside] = (*color, 255)
    return a


def test_descriptor_properties():
    cosine = lambda a, b: float(images.descriptor(a) @ images.descriptor(b))
    red = ellipse(128, (220, 30, 30))
    assert cosine(red, ellipse(96, (220, 30, 30))) > 0.98
    assert cosine(red, ellipse(128, (30, 30, 220))) < cosine(red, ellipse(96, (220, 30, 30))) - 0.15
    hidden = red.copy()
    hidden[hidden[:, :, 3] == 0, :3] = 200
    assert np.allclose(images.descriptor(red), images.descriptor(hidden))
    padded = np.zeros((200, 200, 4), np.uint8)
    padded[30:158, 40:168] = red
    assert cosine(red, padded) > 0.999
    assert images.descriptor(flat((1, 2, 3), 8, 0))[192] == pytest.approx(1)
    assert np.linalg.norm(images.descriptor(flat((1, 2, 3)))) == pytest.approx(1, abs=1e-6)
    assert Similarity


def test_thumbnails(spark):
    data = images.thumbnail(np.zeros((1000, 2000, 4), np.uint8))
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and int.from_bytes(data[16:20], "big") == 420 and int.from_bytes(data[20:24], "big") == 210
    rows = spark.createDataFrame([item(1, thumb="thumb:a"), item(2, thumb="/file.png"), item(3, thumb="thumb:z")], ITEMS)
    got = {r.id: r.data and bytes(r.data) for r in files.thumbnails_of(rows, spark.createDataFrame([("thumb:a", b"x")], THUMBNAILS)).collect()}
    assert got == {1: b"x", 2: None, 3: None}


@pytest.fixture(scope="module")
def words():
    return files.vocabulary("/opt/tokenizers/word_bpe_49k.json")


#: token ids without the padding (fixed values)
IDS = {"a photo of a cat": [320, 1125, 539, 320, 2368], "  A PHOTO\n of a CAT  ": [320, 1125, 539, 320, 2368], "": []}


@pytest.mark.parametrize("text", IDS)
def test_bpe(words, text):
    ids = bpe.Tokenizer(*words).encode(text)
    assert ids == [bpe.START, *IDS[text]] + [bpe.END] * (76 - len(IDS[text]))
    assert sum(bpe.attention_mask(ids)) == len(IDS[text]) + 2


def test_bpe_against_the_library(words, spark):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file("/opt/tokenizers/word_bpe_49k.json")
    own = bpe.Tokenizer(*words)
    texts = ["it's the CAT's 3rd café, naïve résumé!", "日本語 テスト", "emoji 😀😀 and…dots", "x" * 300, "they'll we've I'm 1234567", "word " * 100, "<|endoftext|> tail"]
    for t in texts[:-1]:
        ids = reference.encode(t, add_special_tokens=False).ids[:75]
        assert own.encode(t) == [bpe.START, *ids] + [bpe.END] * (76 - len(ids))
    assert own.encode(texts[-1])[1] == bpe.END
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = [r[0] for r in df.select(bpe.token_ids(spark, df["t"], *words)).collect()]
    assert got == [*map(own.encode, texts), None]


def test_settings_and_manifest(tmp_path):
    path = str(tmp_path / "s.ini")
    files.write_settings(path, {"ocr": "true", "updates/daily": "1"})
    assert files.read_settings(path) == {"ocr": "true", "updates/daily": "1"}
    big = tmp_path / "m.json"
    big.write_text("x" * 70_000)
    with pytest.raises(ValueError):
        files.manifest_text(str(big))


def test_watched_folder(spark, folder, tmp_path):
    root = f"file://{tmp_path}/items"
    dml.publish(spark.createDataFrame([], ITEMS), root)

    def save(batch, number):
        new = batch.selectExpr("path", "folder", "name", "modified", "bytes").withColumn("id", (watch.F.xxhash64("path")))
        columns = [watch.F.col(f.name) if f.name in new.columns else watch.F.lit(None).cast(f.dataType).alias(f.name) for f in ITEMS]
        dml.publish(dml.upsert(dml.current(spark, root), new.select(*columns)), root)

    for _ in range(2):
        watch.indexed(watch.watched(spark, f"file://{folder}", 2), save, f"file://{tmp_path}/cp", once=True).awaitTermination(120)
        n = dml.current(spark, root).count()
        (folder / "green.png").write_bytes(images.png(flat((0, 255, 0))))
    assert (n, dml.current(spark, root).select("path").distinct().count()) == (5, 5)
