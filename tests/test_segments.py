import random

import pytest
from pyspark.sql import functions as F

from heliograph.functions.text import parse_query
from heliograph.operators import pages
from heliograph.operators.indexer import Library
from heliograph.operators.lexical import evidence
from heliograph.operators.segments import Segments, built, changes, due, rows_in
from heliograph.schema import ITEMS

from .test_search import item


@pytest.mark.parametrize(
    ("sizes", "start"),
    [([], None), ([5], None), ([1, 1, 1], None), ([100, 1, 1, 1], None), ([100, 1, 1, 1, 1], 1), ([100, 4, 1, 1, 1], 1), ([100, 7, 1, 1, 1], None), ([100, 7, 1, 1, 1, 1], 1), ([3, 1, 1, 1], 0), ([1000, 100, 30, 10, 10], 1), ([100, 0, 0, 0, 0], 1)],
)
def test_what_is_merged(sizes, start):
    assert due(sizes) == start


def test_a_row_is_written_again_as_often_as_a_logarithm():
    sizes, written, most = [10_000], 0, 0
    for _ in range(5_000):
        sizes.append(1)
        start = due(sizes)
        if start is not None:
            written += sum(sizes[start:])
            sizes[start:] = [sum(sizes[start:])]
        most = max(most, len(sizes))
    assert most <= 24 and written < 5_000 * 16


WORDS = "red redder blue sword shield the of old".split()


def items_of(spark, texts):
    return spark.createDataFrame([item(i, name=f"{n}.png", notes=t, favorite=f) for i, (n, t, f) in sorted(texts.items())], ITEMS)


def scored(rows):
    return sorted((r.id, round(r.relevance, 9), r.trusted, round(r.lexical, 9)) for r in rows.collect())


def agree(spark, segments, texts):
    now = items_of(spark, texts) if texts else spark.createDataFrame([], ITEMS)
    assert sorted(map(str, segments.items().collect())) == sorted(map(str, now.collect()))
    for query in ("red", '"the red"', "re* blue"):
        terms = parse_query(query, keep_stop_words=True)
        assert scored(segments.index().evidence(terms)) == scored(evidence(now, terms, only=True).select("id", "relevance", "trusted", "lexical")), query


def test_edits_and_merges_tell_what_a_rebuilt_index_tells(spark, tmp_path):
    rng, root = random.Random(5), f"file://{tmp_path}/s"
    words = lambda: " ".join(rng.choices(WORDS, k=rng.randrange(7)))
    texts = {i: (f"item{i}", words(), False) for i in range(40)}
    segments = built(spark, root, items_of(spark, texts), keep_items=True)
    agree(spark, segments, texts)
    for step in range(5):
        new = dict(texts)
        for i in rng.sample(sorted(new), 3):
            new[i] = (new[i][0], words(), new[i][2])
        new[100 + step] = (f"new{step}", words(), True)
        favorite, gone = rng.sample(sorted(texts), 2)
        new[favorite] = (*texts[favorite][:2], True)
        del new[gone]
        touched = changes(items_of(spark, texts), items_of(spark, new))
        segments, texts = segments.append(root, items_of(spark, new), touched), new
        if step == 2:
            agree(spark, segments, texts)
            segments = segments.merged(1, root)  # the base stays
            assert len(segments.folders) == 2
    agree(spark, segments, texts)
    whole = segments.merged(0, root)
    agree(spark, whole, texts)
    assert len(whole.folders) == 1 and whole.replaced() is None and whole.sizes() == [len(texts)]


def test_changes(spark):
    old = {1: ("a", "x", False), 2: ("b", "y", False), 3: ("c", "z", False), 4: ("d", "", False)}
    new = {1: ("a", "x", False), 2: ("b", "other", False), 3: ("c", "z", True), 5: ("e", "", False)}
    rows = changes(items_of(spark, old), items_of(spark, new)).collect()
    assert sorted((r.id, r.texts) for r in rows) == [(2, True), (3, False), (4, True), (5, True)]


def test_an_edit_writes_what_it_touches(spark, tmp_path):
    library = Library(spark, f"file://{tmp_path}/lib")
    library.publish(items=items_of(spark, {i: (f"item{i}", "red sword " * 20, False) for i in range(300)}))
    base = library.segments()
    library.set_notes(7, "a red shield")
    one = library.segments()
    assert one.folders[0] == base.folders[0] and len(one.folders) == 2
    assert rows_in(one.folders[1:], spark) < 12 < 10_000 < rows_in(base.folders, spark)
    library.set_favorite(7, True)
    two = library.segments()
    assert spark.read.parquet(f"{two.folders[2]}/postings").count() == 0  # no text has changed
    library.set_notes(99_999, "no such item")
    assert library.segments().folders == two.folders
    assert {r.id for r in library.catalog().index.evidence(parse_query("shield")).collect()} == {7}
    row = library.table("items").filter("id = 7").head()
    assert (row.notes, row.favorite) == ("a red shield", True)
    for k in range(4):
        library.set_notes(20 + k, f"note {k}")
    assert len(library.segments().folders) < 5 and library.table("items").count() == 300
    assert {r.id for r in library.catalog().index.evidence(parse_query("note")).collect()} == {20, 21, 22, 23}


def test_hits_read_their_terms_alone(spark, tmp_path):
    index = built(spark, f"file://{tmp_path}/s", items_of(spark, {1: ("a", "red", False)})).index()
    plan = index._hits(parse_query("red")[0])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,red)" in plan and "Join" not in plan


def test_no_items(spark, tmp_path):
    empty = built(spark, f"file://{tmp_path}/s", spark.createDataFrame([], ITEMS), keep_items=True)
    assert empty.items().collect() == [] and empty.index().evidence(parse_query("red")).collect() == []
    assert Segments(spark).items().collect() == []


# pages


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_pages_are_slices_of_the_order(spark, n):
    by = [F.col("v").desc(), F.col("id").asc()]
    rows = spark.range(n).select("id", (F.col("id") * 7 % 13).alias("v")).repartition(5)
    directory = pages.stored(rows, by)
    want = [r.id for r in rows.orderBy(*by).collect()]
    assert directory.total == n
    for offset, limit in ((0, 10), (3, 0), (n - 5, 100), (n, 5), (n // 2, 333), (0, n), (-4, 6)):
        assert [r.id for r in directory.page(offset, limit).collect()] == want[max(0, offset) : max(0, offset) + max(0, limit)], (offset, limit)
    directory.forget()


def test_a_page_reads_its_own_files(spark):
    directory = pages.stored(spark.range(20_000).repartition(4), [F.col("id").asc()])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        directory = pages.stored(spark.range(20_000).repartition(4), [F.col("id").asc()])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(directory.files) > 2
    late = directory.page(19_000, 10)
    assert len(late.inputFiles()) == 1 and [r.id for r in late.collect()] == list(range(19_000, 19_010))


def test_how_a_view_goes_on(spark):
    by = [F.col("id").asc()]
    stored = lambda rows: pages.stored(spark.createDataFrame(rows, "id long, v string").repartition(3), by)
    base = [(i, f"v{i}") for i in range(25)]
    say = lambda a, b: tuple(pages.continuation(stored(a), stored(b), ["id", "v"], 10).head())
    assert say(base, base) == ("append", 3, 25, 25)
    assert say(base, [*base, (99, "new")]) == ("append", 3, 25, 26)
    assert say(base, [*base[:24], (24, "changed"), (99, "new")]) == ("reset", 2, 25, 26)
    assert say(base, base[:20]) == ("reset", 2, 25, 20)
    assert say(base, base[1:]) == ("reset", 0, 25, 24)
    assert say([], base) == ("append", 0, 0, 25)
    assert say(base, []) == ("reset", 0, 25, 0)


def test_the_registered_index_is_made_once_and_again_where_it_is_gone(spark, sf):
    from heliograph.operators.layout import delete
    from heliograph.sources import catalog as C

    first = C.indexed(spark, sf)
    assert C.indexed(spark, sf) is first
    delete(spark, first.folders[0])
    again = C.indexed(spark, sf)
    assert again is not first and again.index().evidence(parse_query("red")).count() > 0


def test_parts_grow_with_the_input(spark, monkeypatch):
    """So a task's share stays as it is: of rows dealt out, and of postings written."""
    from heliograph.operators import layout, segments

    cores, rows = spark.sparkContext.defaultParallelism, spark.range(100)
    for size, held, parts in ((2 * layout.PART_BYTES, False, cores), (5 * cores * layout.PART_BYTES, False, 5 * cores), (20 * cores * layout.PART_BYTES, True, 20 * cores)):
        monkeypatch.setattr(layout, "input_bytes", lambda df, size=size: size)
        assert layout.dealt(rows, "id", held).rdd.getNumPartitions() == parts
    for size, held in ((20 * cores * layout.PART_BYTES, False), (1 << 62, True), (1 << 20, True)):
        monkeypatch.setattr(layout, "input_bytes", lambda df, size=size: size)
        assert layout.dealt(rows, "id", held) is rows
    assert [segments.parts(spark, n * segments.MOST_POSTINGS) for n in (10, 20, 40)] == [10, 20, 40]
    assert segments.parts(spark, 0) == 1 and segments.parts(spark, segments.LEAST_POSTINGS * 2) == min(2, cores)


def test_postings_lie_in_bounded_parts_in_order(spark, sf, tmp_path, monkeypatch):
    from heliograph.operators import segments
    from heliograph.sources import catalog

    monkeypatch.setattr(segments, "MOST_POSTINGS", 4000)
    rows = catalog.items(spark, sf).drop("embedding").limit(60)
    made = segments.built(spark, str(tmp_path), rows)
    files = [(p.name, spark.read.parquet(str(p))) for p in sorted((tmp_path).glob("*/postings/part-*.parquet"))]
    counts = [df.count() for _, df in files]
    total = made.counts[0]["tokens"]
    assert sum(counts) == total and len(counts) >= total / 4000 and max(counts) <= 3 * 4000
    ends = [(df.agg({"term": "min"}).head()[0], df.agg({"term": "max"}).head()[0]) for _, df in files]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
