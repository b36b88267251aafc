import random

import pytest
from pyspark.sql import functions as F

from heliograph.operators import dml, filters, indexing, stats
from heliograph.schema import APPEARANCES, FOLDERS, ITEMS, THUMBNAILS, Catalog

from .test_search import catalog, item


def by(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_upsert_keeps_what_people_wrote(spark):
    old = spark.createDataFrame([item(1, name="a", favorite=True, notes="mine", tags="old"), item(2, name="b", notes="n")], ITEMS)
    new = spark.createDataFrame([item(99, name="a", favorite=False, notes="", tags="new", bytes=7), item(3, name="c", tags="t")], ITEMS)
    out = dml.upsert(old, new)
    assert out.columns == old.columns
    assert by(out, "id", "path", "favorite", "notes", "tags", "bytes") == [(1, "/p/a", True, "mine", "new", 7), (2, "/p/b", False, "n", "", 1), (3, "/p/c", False, "", "t", 1)]
    assert by(dml.upsert(out, new), "id", "path", "tags") == by(out, "id", "path", "tags")


def test_upsert_can_set_null(spark):
    old = spark.createDataFrame([item(1, name="a", model="cpu-v3")], ITEMS)
    new = spark.createDataFrame([item(1, name="a", model=None)], ITEMS)
    assert dml.upsert(old, new).head().model is None


def test_insert_or_ignore(spark):
    old, new = spark.createDataFrame([("a",)], FOLDERS), spark.createDataFrame([("a",), ("b",), ("b",)], FOLDERS)
    assert by(dml.insert_or_ignore(old, new, "path"), "path") == [("a",), ("b",)]


def test_guarded_replace(spark):
    c = catalog(spark, [item(1, name="a", modified=5), item(2, name="b", modified=5)], [(1, 5, 1, 1, [1.0])])
    offered = spark.createDataFrame([("/p/a", 5, 1, 2, [2.0]), ("/p/b", 4, 1, 2, [3.0]), ("/p/z", 5, 1, 2, [4.0])], "path string, modified long, bytes long, version int, descriptor array<float>")
    assert by(dml.guarded_replace(c.appearances, c.items, offered), "photo_id", "version") == [(1, 2)]


def test_removal_cascades(spark):
    items = spark.createDataFrame([item(1, folder="/a", thumb="t1"), item(2, folder="/b", thumb="t2"), item(3, folder="/b", thumb="t1")], ITEMS)
    looks = spark.createDataFrame([(1, 1, 1, 1, None), (2, 1, 1, 1, None)], APPEARANCES)
    thumbs = spark.createDataFrame([("t1", b"1"), ("t2", b"2"), ("t3", b"3")], THUMBNAILS)
    left = dml.remove_folder(items, looks, thumbs, spark.createDataFrame([("/a",), ("/b",)], FOLDERS), "/b")
    assert [x.count() for x in left] == [1, 1, 1, 1]
    assert by(dml.orphan_thumbnails(thumbs, items), "key") == [("t3",)]


def test_prune_spares_unreachable_folders(spark):
    items = spark.createDataFrame([item(i, name=f"{f}{i}", folder=f"/{f}") for i, f in enumerate("aabb")], ITEMS)
    seen = items.filter("id = 0").select("folder", "path")
    reachable = spark.createDataFrame([("/a",)], "folder string")
    assert by(dml.prune_unseen(items, seen, reachable), "id") == [(0,), (2,), (3,)]


def test_notes_and_favorites(spark):
    items = spark.createDataFrame([item(1), item(2)], ITEMS)
    out = dml.set_favorite(dml.set_notes(items, F.col("id") == 1, F.lit("x" * 20_000)), F.col("id") == 2, F.lit(True))
    assert [(r.id, len(r.notes), r.favorite) for r in out.orderBy("id").collect()] == [(1, 16_000, False), (2, 0, True)]


def test_overlapping_roots(spark):
    files = spark.createDataFrame([("/a/x", "/a", 0), ("/a/x", "/", 1), ("/y", "/", 1)], "path string, folder string, ordinal int")
    assert by(dml.first_root_wins(files), "path", "folder") == [("/a/x", "/a"), ("/y", "/")]
    roots = spark.createDataFrame([("/A",), ("/a/b",), ("/ab",), ("/a/b/c",)], "path string")
    assert by(filters.overlapping(roots), "outer", "inner") == [("/A", "/a/b"), ("/A", "/a/b/c"), ("/a/b", "/a/b/c")]


def test_shared_results(spark):
    rows = spark.createDataFrame([(1, "h"), (2, "h"), (3, "k"), (4, "m")], "id long, h string")
    known = spark.createDataFrame([("k", 7)], "h string, vec long")
    assert by(dml.shared_results(rows, "h", known, "vec"), "id", "reused") == [(1, False), (2, True), (3, True), (4, False)]


def test_published_versions(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    dml.publish(spark.range(3), root)
    first = dml.current(spark, root)
    dml.publish(first.union(spark.range(10, 12)), root)
    assert dml.current(spark, root).count() == 5 and first.count() == 3


def entries(spark):
    rows = [(1, "/p/same", 5, 10, True, True), (2, "/p/changed", 5, 10, True, True), (3, "/p/vector", 5, 10, False, True), (4, "/p/look", 5, 10, True, False), (5, "/p/gone", 5, 10, True, True)]
    return spark.createDataFrame(rows, "id long, path string, modified long, bytes long, embedding_current boolean, appearance_current boolean")


@pytest.mark.parametrize(
    ("options", "want"),
    [
        ({}, {"same": ("unchanged", False), "changed": ("changed", True), "vector": ("stale_vector", True), "look": ("stale_appearance", False), "new": ("new", True)}),
        ({"force": True}, {"same": ("stale_vector", True), "changed": ("changed", True), "vector": ("stale_vector", True), "look": ("stale_vector", True), "new": ("new", True)}),
        ({"appearance_only": True}, {"same": ("unchanged", False), "changed": ("skipped", False), "vector": ("unchanged", False), "look": ("stale_appearance", False), "new": ("unknown", False)}),
    ],
)
def test_classification(spark, options, want):
    files = spark.createDataFrame([(f"/p/{n}", 6 if n == "changed" else 5, 10) for n in want], "path string, modified long, bytes long")
    out = indexing.classify(files, entries(spark), **options)
    assert {r.path[3:]: (r.status, r.embed) for r in out.collect()} == want
    assert indexing.jobs(out).count() == sum(s not in ("unchanged", "unknown", "skipped") for s, _ in want.values())
    assert sum(r.n for r in indexing.summary(out).collect()) == len(want)


def test_errors_are_kept_apart(spark):
    rows = spark.createDataFrame([(i, "bad" if i % 2 else None) for i in range(100)], "id long, error string")
    good, bad = indexing.split_errors(rows)
    assert good.count() == 50 and indexing.error_log(bad, "id").count() == 30


def test_stats_and_entries(spark):
    c = catalog(spark, [item(1, modified=5, embedding=[1.0, 0.0]), item(2, model=None, modified=5), item(3, model="legacy-v1", bytes=4)], [(1, 5, 1, 1, [1.0, 0.0]), (2, 6, 1, 1, [1.0, 0.0]), (3, 0, 4, 0, [1.0, 0.0])])
    assert tuple(stats.stats(c, 2).head()) == (3, 6, 2, 1, 2)
    assert by(stats.scan_entries(c, 2), "id", "embedding_current", "appearance_current") == [(1, True, True), (2, False, False), (3, False, False)]
    empty = Catalog(c.items.limit(0), c.appearances)
    assert tuple(stats.stats(empty, 2).head()) == (0, 0, 0, 0, 0)


def test_order_statistics(spark):
    values = [5.0, 1.0, 3.0, 3.0, 9.0, 7.0, 2.0]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 4.0), ("b", None)], "k string, v double")
    got = {r.k: (r.n, r.p50, r.p95, r.last) for r in stats.ranked_values(df, "v", ("k",), {"p50": stats.p50(), "p95": stats.p95(), "last": stats.p95_of_last()}).collect()}
    s = sorted(values)
    assert got == {"a": (7, s[3], s[6], s[5]), "b": (1, 4.0, 4.0, 4.0)}


@pytest.mark.parametrize("kind", ["double", "long"])
def test_hot_groups_are_selected_from_in_passes(spark, monkeypatch, kind):
    """Ranges are narrowed until few values are left; the plain groups beside them, ties, one value alone, and null groups."""
    monkeypatch.setattr(stats, "LEAST_HOT", 100)
    monkeypatch.setattr(stats, "HOT", 8)
    monkeypatch.setattr(stats, "FEW", 10)
    rng = random.Random(3)
    rows = [("hot", rng.gauss(0, 1000)) for _ in range(5000)] + [(None, float(rng.randrange(4))) for _ in range(4000)] + [("same", 7.0)] * 3000 + [("tied", float(rng.choice([1, 1, 1, rng.randrange(1000)]))) for _ in range(3000)]
    rows += [("cold", float(k)) for k in range(90)] + [("cold", None), ("one", -1.0)]
    df = spark.createDataFrame(rows, "k string, v double").select("k", F.col("v").cast(kind).alias("v")).repartition(5)
    picks = {"p50": stats.p50(), "p95": stats.p95(), "last": stats.p95_of_last(), "least": F.lit(0), "most": F.col("n") - 1}
    got = {r.k: tuple(r)[1:] for r in stats.ranked_values(df, "v", ("k",), picks).collect()}
    for k in ("hot", None, "same", "tied", "cold", "one"):
        s = sorted(v if kind == "double" else int(v) for g, v in rows if g == k and v is not None)
        n = len(s)
        assert got[k] == (n, s[n // 2], s[int(n * 0.95)], s[(n - 1) * 95 // 100], s[0], s[-1]), k
    whole = stats.ranked_values(df.filter("k = 'hot'"), "v", (), picks).head()
    assert tuple(whole) == got["hot"]


def test_digest_is_a_tree_over_keys(spark):
    """The same from any partitioning; other at any change; equal rows count; keys of both signs."""
    rng = random.Random(1)
    rows = [(rng.randrange(-(2**62), 2**62), str(k), None) for k in range(200)] + [(k, "dense", "x") for k in range(-50, 50)] + [(5, "twin", ""), (5, "twin", "")]
    digest = lambda rows, parts=1: tuple(stats.result_digest(spark.createDataFrame(rows, "id long, a string, b string").repartition(parts), "id", ["a", "b"], F.lit(1)).head())
    first = digest(rows)
    assert first[1] == len(rows) and digest(rows, 7) == digest(rows[::-1], 3) == first
    assert len({first[2], digest(rows[:-1])[2], digest([(rows[1][0], *rows[0][1:]), (rows[0][0], *rows[1][1:]), *rows[2:]])[2], digest([*rows[:-1], (5, "twin", "y")])[2]}) == 4
    assert stats.result_digest(spark.createDataFrame([], "id long, a string"), "id", ["a"], F.lit(1)).collect() == []


def test_digest_depends_on_order_and_bounds(spark):
    digest = lambda rows: stats.result_digest(spark.createDataFrame(rows, "id int, a string, b string"), "id", ["a", "b"], F.lit(1)).head().digest
    assert digest([(1, "x", "yz"), (2, "", "")]) == digest([(2, "", ""), (1, "x", "yz")])
    assert digest([(1, "x", "yz")]) != digest([(1, "xy", "z")])


def test_same_set(spark):
    make = lambda xs: spark.createDataFrame([(x,) for x in xs], "v string")
    equal = lambda a, b: stats.same_set(make(a), make(b)).head().equal
    assert equal("ab", "ba") and not equal("ab", "a") and not equal("aab", "ab") and not equal("ab", "ac")
