import os
import threading
import time

import numpy as np
import pytest

from heliograph.functions import images
from heliograph.functions.text import Term
from heliograph.operators.indexer import Indexer, Library, Model
from heliograph.operators.search import FixedEmbedder, Searcher
from heliograph.operators.versions import Versions
from heliograph.schema import Catalog, Mode, SearchRequest, Similarity

from .test_files_and_images import flat


def embed(x: np.ndarray) -> list[float]:
    """Mean colors, centred: enough to tell flat images apart."""
    v = x.mean((1, 2)).astype(float) + 3
    return [*v.tolist(), 1.0]


@pytest.fixture
def setup(spark, tmp_path):
    root = tmp_path / "pics"
    root.mkdir()
    for name, color in {"red_sword.png": (255, 0, 0), "copy.png": (255, 0, 0), "BlueShield2.png": (0, 0, 255)}.items():
        (root / name).write_bytes(images.png(flat(color)))
    return root, Library(spark, f"file://{tmp_path}/lib")


def names(library):
    return sorted(r["name"] for r in library.table("items").collect())


def test_life_of_a_library(setup, spark):
    root, library = setup
    indexer = Indexer(library, embed, bank=[("red", embed(images.model_input(flat((255, 0, 0))))), ("blue", embed(images.model_input(flat((0, 0, 255)))))])
    first = indexer.scan([f"file:{root}"])
    assert (first["changed"], first["inference"], first["reused"], first["failed"]) == (3, 2, 1, 0)
    rows = {r["name"]: r for r in library.table("items").collect()}
    assert rows["BlueShield2.png"].search_name == "Blue Shield 2.png" and rows["copy.png"].thumb == rows["red_sword.png"].thumb
    assert rows["red_sword.png"].tags.startswith("red") and library.table("thumbnails").count() == 2 and library.table("appearances").count() == 3

    again = indexer.scan()
    assert (again["changed"], again["skipped"]) == (0, 3)

    library.set_notes(rows["red_sword.png"].id, "mine")
    library.set_favorite(rows["red_sword.png"].id, True)
    (root / "red_sword.png").write_bytes(images.png(flat((0, 255, 0))))
    (root / "broken.png").write_bytes(b"no image")
    (root / "copy.png").unlink()
    third = indexer.scan()
    assert (third["changed"], third["failed"], third["skipped"]) == (1, 1, 1) and "broken.png" in third["errors"][0]
    row = [r for r in library.table("items").collect() if r["name"] == "red_sword.png"][0]
    assert (row.notes, row.favorite, row.id) == ("mine", True, rows["red_sword.png"].id)
    assert names(library) == ["BlueShield2.png", "red_sword.png"]
    assert library.table("appearances").count() == 2

    forced = indexer.scan(force=True, files_a_batch=1)
    assert (forced["inference"], forced["batches"]) == (2, 3)

    gone = indexer.scan([f"file:{root}", f"file:{root}-offline"])
    assert "stays" in gone["errors"][0] and names(library) == ["BlueShield2.png", "red_sword.png"]

    s = Searcher(library.catalog(), FixedEmbedder({"green": embed(images.model_input(flat((0, 255, 0))))}), 4)
    assert s.search(SearchRequest(query="green")).page.head()["name"] == "red_sword.png"
    assert s.search(SearchRequest(query="shield")).page.head()["name"] == "BlueShield2.png"

    library.remove_folder(f"file:{root}")
    assert names(library) == [] and os.path.exists(root / "red_sword.png") and library.table("folders").count() == 1


def test_descriptors_alone(setup):
    root, library = setup
    Indexer(library).scan([f"file:{root}"])
    library.publish(appearances=library.table("appearances").limit(0))
    (root / "new.png").write_bytes(images.png(flat((9, 9, 9))))
    out = Indexer(library).scan(appearance_only=True)
    assert out["changed"] == 3 and library.table("appearances").count() == 3 and "new.png" not in names(library)
    s = Searcher(library.catalog(), dimensions=512)
    one = [r.id for r in library.table("items").collect() if r["name"] == "copy.png"][0]
    assert s.search(SearchRequest(similar_id=one, similarity=Similarity.APPEARANCE)).page.head()["name"] == "red_sword.png"


def test_one_writer_and_cancelling(setup):
    root, library = setup
    with library.writer(), pytest.raises(RuntimeError):
        library.set_notes(1, "x")
    indexer = Indexer(library)
    indexer.cancel()
    assert indexer.scan([f"file:{root}"])["cancelled"] and names(library) == []


def test_a_crash_between_batches_keeps_them(setup, spark, monkeypatch):
    root, library = setup
    indexer = Indexer(library, embed)
    whole, calls = indexer._batch, []

    def stops(*args):
        if calls:
            raise KeyboardInterrupt
        calls.append(1)
        whole(*args)

    monkeypatch.setattr(indexer, "_batch", stops)
    with pytest.raises(KeyboardInterrupt):
        indexer.scan([f"file:{root}"], files_a_batch=1)
    assert names(library) == [] and library.versions.names("pending") == ["000000000"]
    again = Indexer(library, embed).scan()
    assert (again["changed"], again["skipped"]) == (2, 1) and len(names(library)) == 3 and library.versions.names("pending") == []


def test_a_cancelled_scan_keeps_what_is_done(setup):
    root, library = setup
    indexer = Indexer(library, embed)
    whole = indexer._batch
    indexer._batch = lambda *args: (whole(*args), indexer.cancel())
    assert indexer.scan([f"file:{root}"], files_a_batch=1)["cancelled"] and len(names(library)) == 1


def test_a_running_batch_is_cancelled(setup, tmp_path):
    """The second batch hangs in the model; its job ends at once, and the first batch stays."""
    root, library = setup
    started = tmp_path / "started"

    def hangs(x):
        if x.shape[0] == 3 and x[0].mean() < x[2].mean():  # the blue image
            started.write_text("x")
            time.sleep(300)
        return embed(x)

    (root / "BlueShield2.png").rename(root / "zz_blue.png")
    indexer, out = Indexer(library, hangs), {}
    scan = threading.Thread(target=lambda: out.update(indexer.scan([f"file:{root}"], files_a_batch=2)))
    scan.start()
    until = time.monotonic() + 120
    while not started.exists() and time.monotonic() < until:
        time.sleep(0.1)
    cancelled = time.monotonic()
    indexer.cancel()
    scan.join(100)
    assert not scan.is_alive() and out["cancelled"] and out["batches"] == 1 and time.monotonic() - cancelled < 60
    assert names(library) == ["copy.png", "red_sword.png"] and library.versions.names("pending") == []
    again = Indexer(library, embed).scan()
    assert (again["changed"], again["skipped"]) == (1, 2)


def test_index_and_scan_agree(setup, spark):
    root, library = setup
    indexer = Indexer(library, embed)
    indexer.scan([f"file:{root}"])
    one = [r.id for r in library.table("items").collect() if r["name"] == "red_sword.png"][0]
    library.set_notes(one, "a blue shield and the red copy")
    (root / "copy.png").unlink()
    indexer.scan()
    for query in ("red", "blue shield", '"blue shield"', "sh*", "the red", "nothing"):
        by_index = library.catalog()
        by_scan = Catalog(by_index.items, by_index.appearances)
        rows = [[(r.id, round(r.score, 9), r.reason) for r in Searcher(c, None, 4).search(SearchRequest(query=query, mode=Mode.TEXT)).page.collect()] for c in (by_index, by_scan)]
        assert rows[0] == rows[1], query
        assert bool(rows[0]) == (query != "nothing")
    plan = library.catalog().index._hits(Term(("red",)))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,red)" in plan
    assert "StringStartsWith(term,re)" in library.catalog().index._hits(Term(("re",), True))._jdf.queryExecution().executedPlan().toString()


def test_states_change_at_once(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/v")
    assert v.current() == (0, {})
    v.publish(a=spark.range(1), b=spark.range(2))
    first = v.table("a")
    for k in range(2, 6):
        v.publish(a=spark.range(k))
        assert v.table("a").count() == k and v.table("b").count() == 2
        if k == 2:
            assert first.count() == 1  # a reader of the state before goes on
    assert len(v.names("a")) == 3 and len(v.names("b")) == 1 and len(v.names("states")) == 3
    number, _ = v.current()
    assert v.create(f"states/{number + 1:012d}", "{")  # a writer that is not done, or never will be
    assert v.current()[0] == number
    assert not v.create(f"states/{number + 1:012d}", "{}")
    v.publish(b=spark.range(9))
    assert v.current()[0] == number + 2 and v.table("a").count() == 5 and v.table("b").count() == 9


def test_a_lock_of_a_dead_process_is_void(setup):
    import json
    import socket
    import subprocess
    import sys

    _, library = setup
    gone = subprocess.Popen([sys.executable, "-c", ""])
    gone.wait()
    library.versions.create("LOCK", json.dumps({"host": socket.gethostname(), "pid": gone.pid}))
    with library.writer():
        assert library.versions.exists("LOCK")
    library.versions.create("LOCK", json.dumps({"host": "another", "pid": gone.pid}))
    with pytest.raises(RuntimeError), library.writer():
        pass


def test_models_get_batches_and_fall_back():
    sizes = []

    def many(x):
        sizes.append(len(x))
        if (x[:, 0, 0, 0] > 90).any():
            raise MemoryError
        return x[:, :, 0, 0]

    inputs = [np.full((3, 2, 2), k, np.float32) for k in (1, 2, 99)]
    model = Model(lambda x: x[:, 0, 0], many, fallback=lambda x: x[:, 0, 0] * 10)
    assert [v.tolist() for v in model.vectors(inputs[:2])] == [[1] * 3, [2] * 3]
    assert [v.tolist() for v in model.vectors(inputs)] == [[10] * 3, [20] * 3, [990] * 3]
    assert sizes == [2, 3]
    with pytest.raises(ZeroDivisionError):
        Model(lambda x: 1 / 0).vectors(inputs)


def test_one_spelling_of_a_folder(setup, spark, tmp_path):
    root, library = setup
    (tmp_path / "link").symlink_to(root)
    Indexer(library).scan([f"file://{tmp_path}/link/", f"file:{root}/../pics"])
    assert [r.path for r in library.table("folders").collect()] == [f"file:{root}"] and len(names(library)) == 3
