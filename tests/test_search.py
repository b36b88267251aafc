import random
import threading
import time
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.operators import search as se
from heliograph.schema import APPEARANCES, ITEMS, Catalog, Mode, Orientation, SearchRequest, Similarity, Sort


def item(i, **x):
    base = dict(id=i, path=f"/p/{x.get('name', i)}", folder="/p", name=f"{i}.png", search_name="", thumb="", width=100, height=100, bytes=1, modified=0, favorite=False, tags="", ocr="", notes="", model="cpu-v3", embedding=None)
    return tuple({**base, **x}[f.name] for f in ITEMS)


def catalog(spark, rows, looks=()):
    return Catalog(spark.createDataFrame(rows, ITEMS), spark.createDataFrame(list(looks), APPEARANCES))


def one_hot(k, d=4):
    return [1.0 if i == k else 0.0 for i in range(d)]


def ids(result):
    return [r.id for r in result.page.collect()]


@pytest.fixture(scope="module")
def many(spark):
    rows = [item(i, name=f"asset-{i * 137 % 529:03d}.png", path=f"/p/{i}", modified=i % 11, width=16 + i % 7, height=16 + i % 13, bytes=i % 3, embedding=one_hot(i % 3)) for i in range(529)]
    c = catalog(spark, rows)
    return Catalog(c.items.cache(), c.appearances), rows


@pytest.mark.parametrize("sort", list(Sort))
def test_pages_equal_a_full_sort(many, sort):
    c, rows = many
    names = [f.name for f in ITEMS]
    table = [dict(zip(names, r, strict=True)) for r in rows]
    keys = {
        Sort.RELEVANCE: lambda r: (-r["embedding"][0], -r["modified"], -r["id"]),
        Sort.NEWEST: lambda r: (-r["modified"], -r["id"]),
        Sort.OLDEST: lambda r: (r["modified"], -r["id"]),
        Sort.NAME: lambda r: (r["name"].lower(), -r["modified"], -r["id"]),
        Sort.LARGEST: lambda r: (-r["width"] * r["height"], -r["modified"], -r["id"]),
    }
    want = [r["id"] for r in sorted(table, key=keys[sort])]
    s = se.Searcher(c, se.FixedEmbedder({"x": one_hot(0)}), 4)
    request = SearchRequest(query="x", mode=Mode.VISUAL, sort=sort, limit=170)
    first = s.search(request)
    got, cursor = ids(first), first.cursor
    while len(got) < first.total:
        got += ids(s.search(replace(request, offset=len(got), cursor=cursor)))
    assert got == want and first.total == 529


def test_limits_and_dead_cursors(many):
    c, _ = many
    s = se.Searcher(c, None, 4)
    assert ids(s.search(SearchRequest(limit=-5))) == []
    first = s.search(SearchRequest(limit=3))
    assert ids(s.search(SearchRequest(limit=3, offset=9999, cursor=first.cursor))) == []
    again = s.search(SearchRequest(limit=3, offset=3, cursor=first.cursor + 7))
    assert again.offset == 0 and ids(again) == ids(first)
    other = s.search(SearchRequest(limit=3, offset=3, cursor=again.cursor, favorites=True))
    assert other.offset == 0


def test_later_generations_win(many):
    s = se.Searcher(many[0], None, 4)
    assert s.search(SearchRequest(generation=5, limit=1)) is not None
    assert s.search(SearchRequest(generation=4, limit=1)) is None


def test_metadata_beats_labels_and_exact_names_win(spark):
    c = catalog(spark, [item(1, name="red_sword.png"), item(2, name="00042.png", tags="red sword"), item(3, name="x.png", notes="red sword")])
    s = se.Searcher(c, None, 4)
    rows = s.search(SearchRequest(query="red sword", mode=Mode.TEXT)).page.collect()
    assert rows[-1].id == 2 and rows[0].id in (1, 3)
    assert {r.id: r.reason for r in rows} == {1: "Filename / description match", 3: "Filename / description match", 2: "Text found in labels or image"}
    exact = s.search(SearchRequest(query=" Red_Sword.PNG ", mode=Mode.TEXT)).page.collect()
    assert exact[0].id == 1 and exact[0].score > 0.65
    assert s.search(SearchRequest(query="red_sword", mode=Mode.TEXT)).page.collect()[0].score > 0.65


def test_text_modes(spark):
    rows = [item(i, name=f"{i:04d}.{'png' if i % 2 else 'jpg'}", path=f"/p/{i}", tags="invoice", modified=i, width=400 + i, height=300, favorite=i == 724) for i in range(725)]
    s = se.Searcher(catalog(spark, rows), None, 4)
    oldest = s.search(SearchRequest(query="invoice", mode=Mode.TEXT, sort=Sort.OLDEST, limit=650)).page.collect()
    assert (oldest[0].modified, oldest[-1].modified) == (0, 649)
    jpg = s.search(SearchRequest(query="invoice", mode=Mode.TEXT, sort=Sort.LARGEST, extension="JPG", limit=1))
    assert jpg.total == 363 and jpg.page.head().modified == 724
    assert s.search(SearchRequest(query="invoice", mode=Mode.TEXT, favorites=True)).total == 1


def test_filters(spark):
    s = se.Searcher(catalog(spark, [item(1, width=800, height=400, favorite=True, name="a%b.png"), item(2, width=300, height=800, name="noext")]), None, 4)
    total = lambda **x: s.search(SearchRequest(**x)).total
    assert total(favorites=True) == 1 and total(orientation=Orientation.PORTRAIT) == 1 and total(orientation=Orientation.SQUARE) == 0
    assert total(extension="PNG") == 1 and total(extension="%") == 0 and total(extension="p_g") == 0
    assert total(folder="/q") == 0 and total(folder="/p", favorites=True, orientation=Orientation.LANDSCAPE, extension="png") == 1


def test_broken_vectors(spark):
    v = one_hot(0)
    rows = [item(1, embedding=v), item(2, embedding=v, model="legacy-v1"), item(3, embedding=v, model="other"), item(4, embedding=v, model=None), item(5, embedding=v[:3]), item(6), item(7, embedding=[float("nan"), 0.0, 0.0, 0.0]), item(8, embedding=[float("inf"), 0.0, 0.0, 0.0]), item(9, embedding=[0.0] * 4)]
    c = catalog(spark, rows)
    assert tuple(se.availability(c, 4).head()) == (2, 1, 7)
    s = se.Searcher(c, None, 4)
    rows = s.search(SearchRequest(similar_id=2)).page.collect()
    assert [(r.id, round(r.score, 6), r.reason) for r in rows] == [(1, 1.0, "Subject similarity")]
    assert "Earlier index supported" in s.search(SearchRequest(similar_id=2)).status
    missing = s.search(SearchRequest(similar_id=6))
    assert missing.error and missing.total == 0 and missing.page is None


def test_appearance_modes(spark):
    rng = np.random.default_rng(0)
    d = [rng.normal(size=64).tolist() for _ in range(3)]
    rows = [item(i, modified=5) for i in range(4)]
    looks = [(0, 5, 1, 1, d[0]), (1, 5, 1, 1, [2 * x for x in d[0]]), (2, 5, 1, 1, d[1]), (3, 6, 1, 1, d[2])]
    s = se.Searcher(catalog(spark, rows, looks))
    for kind in (Similarity.APPEARANCE, Similarity.SHAPE, Similarity.COLOR):
        out = s.search(SearchRequest(similar_id=0, similarity=kind)).page.collect()
        assert [r.id for r in out] == [1, 2] and out[0].score == pytest.approx(1, abs=1e-6)
    assert "appearance index" in s.search(SearchRequest(similar_id=3, similarity=Similarity.SHAPE)).status


def test_text_fallback_and_references(spark):
    s = se.Searcher(catalog(spark, [item(1, name="red.png", embedding=one_hot(0)), item(2, embedding=one_hot(0), path="/ref")]), se.FixedEmbedder({"/ref": one_hot(0)}), 4)
    assert s.search(SearchRequest(query="red", mode=Mode.VISUAL)).total == 1
    assert ids(s.search(SearchRequest(reference_path="/ref"))) == [1]
    assert s.search(SearchRequest(reference_path="/none")).error
    assert s.search(SearchRequest(query="red", reference_path="/ref")).page.head().score > 1.25


def test_a_stale_search_ends(spark):
    """A search that a later request supersedes stops in the middle of its job and gives None; the next goes through."""
    slow = F.udf(lambda i: (time.sleep(60), i)[1], "long")
    rows = catalog(spark, [item(1, name="red.png")])
    s, out = se.Searcher(Catalog(rows.items.filter(slow("id") == 1), rows.appearances), None, 4), []
    thread = threading.Thread(target=lambda: out.append(s.search(SearchRequest(generation=1))))
    thread.start()
    until, tracker = time.monotonic() + 30, spark.sparkContext.statusTracker()
    while not tracker.getActiveJobsIds() and time.monotonic() < until:
        time.sleep(0.05)
    time.sleep(1)
    s.supersede(2)
    thread.join(40)
    assert not thread.is_alive() and out == [None]
    s.reload(rows)
    assert s.search(SearchRequest(generation=2)).total == 1 and s.search(SearchRequest(generation=1)) is None


def test_top_k(spark):
    df = spark.createDataFrame([(0, [0.2]), (1, [0.9]), (2, [-0.1])], "vec_id long, embedding array<float>")
    top = lambda q, k: [r.vec_id for r in se.top_k(df, q, k, 1).collect()]
    assert top([1.0], 2) == [1, 0] and top([], 2) == [] and top([1.0], 0) == [] and len(top([1.0], 99)) == 3


def test_metadata_changes(many):
    s = se.Searcher(many[0], None, 4)
    first = s.search(SearchRequest(limit=2))
    s.metadata_changed(many[0])
    assert s.search(SearchRequest(limit=2, offset=2, cursor=first.cursor)).offset == 2
    named = s.search(SearchRequest(query="asset", mode=Mode.TEXT, limit=2))
    s.metadata_changed(many[0])
    assert s.search(SearchRequest(query="asset", mode=Mode.TEXT, limit=2, offset=2, cursor=named.cursor)).offset == 0


def test_kept_tokens_give_the_same(many):
    plain, kept = se.Searcher(many[0], None, 4), se.Searcher(many[0], None, 4, keep_tokens=True)
    request = SearchRequest(query="asset 01*", mode=Mode.TEXT, limit=40)
    for _ in range(2):
        assert [(r.id, r.score) for r in plain.search(request).page.collect()] == [(r.id, r.score) for r in kept.search(request).page.collect()]
    kept.reload()
    assert kept._tokens is None


def test_catalog_scans_prune(spark, tmp_path):
    catalog(spark, [item(1, embedding=one_hot(0))]).items.write.parquet(str(tmp_path / "i"))
    plan = se.metadata(Catalog(spark.read.parquet(str(tmp_path / "i"))))._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in plan.split("ReadSchema")[1]
    filtered = spark.read.parquet(str(tmp_path / "i")).filter(F.col("folder") == "/p")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(folder,/p)" in filtered
    assert random
