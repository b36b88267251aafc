import json
import os

import pytest
from pyspark.sql import functions as F

from heliograph.streaming import events, watch


def collected(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def stream(spark, folder, rows, schema):
    folder.mkdir()
    for k, part in enumerate(rows):
        (folder / f"{k}.json").write_text("\n".join(json.dumps(r) for r in part))
        os.utime(folder / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # files are taken by age
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def test_debounce_as_a_stream_and_as_a_batch(spark, tmp_path):
    rows = [{"k": 1, "ts": "2024-01-01T00:00:00.000", "v": "a"}, {"k": 1, "ts": "2024-01-01T00:00:00.100", "v": "b"}, {"k": 1, "ts": "2024-01-01T00:00:01.000", "v": "c"}, {"k": 2, "ts": "2024-01-01T00:00:00.050", "v": "d"}]
    end = [{"k": 9, "ts": "2024-01-01T01:00:00.000", "v": "z"}]
    schema = "k long, ts timestamp, v string"
    s = stream(spark, tmp_path / "in", [rows, end, end], schema)
    got = collected(spark, events.debounced(s, "k", "ts", "180 milliseconds", F.col("v"), late="1 second"), "debounced")
    batch = events.debounced(spark.read.schema(schema).json([json_path for json_path in map(str, (tmp_path / "in").glob("0.json"))]), "k", "ts", "180 milliseconds", F.col("v")).collect()
    key = lambda r: (r.k, r.n, r.value)
    assert sorted(map(key, got)) == sorted(map(key, batch)) == [(1, 1, "c"), (1, 2, "b"), (2, 1, "d")]


def test_latest_wins(spark):
    df = spark.createDataFrame([(1, 3, "new"), (1, 2, "old"), (2, 1, "only")], "k long, g long, v string")
    assert sorted(map(tuple, events.latest_wins(df, "k", F.col("g"), F.col("v")).collect())) == [(1, 3, "new"), (2, 1, "only")]


@pytest.fixture
def with_state(spark):
    """Timers need the store that Spark keeps on disk."""
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


BASE = 1704067200000


def at(k, ms, v="x"):
    return {"k": k, "ts": f"2024-01-01T00:{ms // 60000:02d}:{ms // 1000 % 60:02d}.{ms % 1000:03d}", "v": v}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_throttle(spark, tmp_path, with_state, kind):
    """Six events of one key over 100 ms fire twice, at the ends of their intervals; a lone event of another key fires too, and so does the last."""
    one, two, nine = (1, 2, 9) if kind == "long" else ("1", "2", "9")
    rows = [at(one, ms, str(ms)) for ms in (0, 10, 30, 40, 50, 100)]
    s = stream(spark, tmp_path / "in", [[*rows[:3], at(two, 5, "lone")], rows[3:], [at(nine, 60_000)], [at(nine, 60_001)]], f"k {kind}, ts timestamp, v string")
    out = collected(spark, events.throttled(s, "k", "ts", "v", 35), f"throttled_{kind}")
    assert sorted((str(r.key), r.fired_ms - BASE, r.value) for r in out) == [("1", 35, "30"), ("1", 75, "50"), ("1", 135, "100"), ("2", 40, "lone")]


def test_refreshes(spark, tmp_path, with_state):
    """After enough changes and enough time, whichever comes last."""
    fast = [at("a", k) for k in range(10)]  # ten changes, no time
    slow = [at("a", 3000), at("a", 3001)]
    more = [at("a", 3500), at("a", 9000)]  # time, but few changes
    many = [at("a", 9001 + k) for k in range(6)]
    s = stream(spark, tmp_path / "in", [fast, slow, more, many], "k string, ts timestamp, v string")
    out = collected(spark, events.refreshes(s, "k", "ts", changes=8, milliseconds=2000), "refreshes")
    assert [(r.key, r.at_ms - BASE, r.changed) for r in out] == [("a", 3000, 11), ("a", 9005, 19)]


def test_listings_tell_of_additions_changes_and_removals(spark, tmp_path, with_state, monkeypatch):
    """Four listings: files, then one deleted, one renamed and one changed, then none, then one again."""
    monkeypatch.setattr(watch, "BUCKETS", 3)
    listings = [{"a": (1, 1), "b": (1, 1), "c": (1, 1), "d": (1, 1)}, {"a": (1, 1), "renamed": (1, 1), "d": (2, 1)}, {}, {"b": (5, 5)}]
    for k, files in enumerate(listings):
        found = spark.createDataFrame([(path, *x) for path, x in files.items()], "path string, modified long, bytes long")
        watch.listed(found, "/pics", k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    parts = sorted((tmp_path / "in").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    for k, f in enumerate(parts):
        os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    s = spark.readStream.schema(watch.LISTING).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = collected(spark, watch.differences(s), "differences")
    assert sorted((r.listing, r.path, r.change) for r in out) == [
        (0, "a", "added"), (0, "b", "added"), (0, "c", "added"), (0, "d", "added"),
        (1, "b", "removed"), (1, "c", "removed"), (1, "d", "changed"), (1, "renamed", "added"),
        (2, "a", "removed"), (2, "d", "removed"), (2, "renamed", "removed"), (3, "b", "added"),
    ]
