import base64
import gzip
import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from heliograph.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, payload string, nth int"
ROWS = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (5, "http://ü/é", "<p>ünï \r\n\r\n WARC/1.1\r\n\r\n</p>"), (7, None, None), (8, "u", ""), (9, "a\r\nWARC-Type: evil", "z"), (9, "second", "z"), (None, "n", "<p>x</p>"), (11, "long", "long " * 200_000), (12, "n", "only")]


def frame(spark):
    return spark.createDataFrame([(*r, "d", "p", 1) for r in ROWS], SCHEMA)


def test_round_trip(spark):
    rows = warc.archive(frame(spark)).collect()
    assert len(rows) == len(ROWS)
    by_payload = {}
    for i, _, html in ROWS:
        by_payload.setdefault(html or "", []).append(i)
    responses = {}
    for r in rows:
        if r.record_type == "response":
            responses[r.payload_digest] = r.page_id
            data = bytes(r.payload)
            assert base64.b32encode(hashlib.sha1(data).digest()).decode() == r.payload_digest and len(data) == r.payload_bytes
    for html, ids in by_payload.items():
        data = html.encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        top = max((i for i in ids if i is not None), default=None)
        own = [r for r in rows if r.payload_digest == digest]
        assert len(own) == len(ids) and responses[digest] == top
        assert sum(r.record_type == "response" for r in own) == 1
        assert all(r.payload_bytes == len(data) for r in own)
        assert all(r.refers_to == (None if r.record_type == "response" else top) for r in own)
    assert {r.url for r in rows if r.page_id == 5} == {"http://ü/é"}
    assert {r.url for r in rows if r.page_id == 9} == {"a%0D%0AWARC-Type: evil", "second"}


def test_payloads_are_stored_once(spark, tmp_path):
    warc.write(frame(spark), f"file://{tmp_path}/a")
    stored = spark.read.parquet(f"file://{tmp_path}/a/payloads")
    assert stored.count() == len({html or "" for _, _, html in ROWS})
    assert stored.filter(F.sha2("payload", 256) != F.col("digest")).count() == 0


def test_damage_is_found(spark, tmp_path):
    warc.write(frame(spark), f"file://{tmp_path}/a")
    bad = spark.read.parquet(f"file://{tmp_path}/a/payloads").withColumn("payload", F.when(F.octet_length("payload") == 8, F.lit(b"<p>y</p>")).otherwise(F.col("payload")))
    bad.write.parquet(f"file://{tmp_path}/b/payloads")
    spark.read.parquet(f"file://{tmp_path}/a/headers").write.parquet(f"file://{tmp_path}/b/headers")
    with pytest.raises(Exception, match="does not match its digest"):
        warc.records(spark, f"file://{tmp_path}/b").collect()


@pytest.mark.parametrize("compression", [None, "gzip"])
def test_files(spark, tmp_path, compression):
    warc.write(frame(spark), f"file://{tmp_path}/a")
    rows = warc.records(spark, f"file://{tmp_path}/a")
    warc.export(rows, f"file://{tmp_path}/files", file_bytes=300_000, compression=compression)
    files = [p for p in (tmp_path / "files").iterdir() if p.name.startswith("part-")]
    assert len(files) > 1 and all(p.name.endswith(".gz") == bool(compression) for p in files)
    again = warc.read_files(spark, f"file://{tmp_path}/files")
    assert sorted(bytes(r.record) for r in rows.collect()) == sorted(bytes(r.record) for r in again.collect())
    assert sorted(str(r) for r in warc.parsed(again).drop("payload").collect()) == sorted(str(r) for r in warc.parsed(rows).drop("payload").collect())


def test_files_of_others(spark, tmp_path):
    """Gzipped record by record, blocks that end or begin with line ends or hold what looks like a record, and files larger than a split."""
    blocks = [b"", b"\r\n", b"x\r\n", b"\r\n\r\n", b"a\r\n\r\n\r\nb", b"\r", b"\xff\x00\xfe" * 9, b"WARC/1.0\r\nContent-Length: 5\r\n\r\nzzzzz", b"q" * 300_000]
    records = [b"WARC/1.0\r\nWARC-Type: resource\r\ncontent-length: %d\r\n\r\n" % len(b) + b for b in blocks]
    end = b"\r\n\r\n"
    (tmp_path / "one.warc.gz").write_bytes(b"".join(gzip.compress(r + end) for r in records))
    (tmp_path / "two.warc").write_bytes(b"".join(r + end for r in records[::-1]))
    (tmp_path / "three.warc").write_bytes(end.join(records))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = Counter(bytes(r.record) for r in warc.read_files(spark, f"file://{tmp_path}").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == Counter(records * 3)


def test_records_in_any_pieces():
    records = [b"WARC/1.1\r\nContent-Length: %d\r\n\r\n" % len(b) + b for b in (b"", b"ab\r\n", b"\r\n\r\ncd")]
    data = b"".join(r + b"\r\n\r\n" for r in records)
    for size in (1, 2, 3, 7, 1000):
        assert list(warc.split_records(data[i : i + size] for i in range(0, len(data), size))) == records
    for bad in (data[:-9], b"no record\r\n\r\n", b"WARC/1.1\r\nX: y\r\n\r\n"):
        with pytest.raises(ValueError, match="record"):
            list(warc.split_records(iter([bad])))


def test_one_payload_in_most_pages(spark, monkeypatch):
    from heliograph.llm import cluster

    monkeypatch.setattr(cluster, "LEAST_HOT", 4)
    monkeypatch.setattr(cluster, "HOT", 10)
    rows = [(i, f"u{i}", "same" if i % 3 else f"own {i}") for i in range(90)] + [(None, "u", "same")] * 5
    got = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    same = [r for r in got if r.payload_bytes == 4]
    assert len(got) == 95 and len(same) == 65 and [r.page_id for r in same if r.record_type == "response"] == [89]
    assert all(r.refers_to == 89 for r in same if r.record_type == "revisit")


@pytest.mark.parametrize("size", [16_000, 17_000, 1_000_000])
def test_long_urls(spark, size):
    """A response and revisits of it whose urls alone are longer than any usual header."""
    urls = {1: "data:,ü" + "x" * size, 2: "http://a/?q=" + "é" * size, 3: "http://short"}
    rows = warc.archive(spark.createDataFrame([(i, u, "<p>ü</p>") for i, u in urls.items()] + [(4, "data:," + "y" * size, "")], "page_id long, url string, html string")).collect()
    data = "<p>ü</p>".encode()
    digest, empty = (base64.b32encode(hashlib.sha1(x).digest()).decode() for x in (data, b""))
    got = {r.page_id: (r.record_type, r.payload_digest, r.payload_bytes, r.refers_to, r.url, r.payload and bytes(r.payload)) for r in rows}
    assert got == {
        1: ("revisit", digest, len(data), 3, urls[1], None),
        2: ("revisit", digest, len(data), 3, urls[2], None),
        3: ("response", digest, len(data), None, urls[3], data),
        4: ("response", empty, 0, None, "data:," + "y" * size, b""),
    }


def test_empty(spark):
    assert warc.archive(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("mark", ["Å", "\x85", "\u2028", "\x0b", "\x0c", "%0A", "\r", "\n", "\r\n"])
def test_a_url_forges_no_field(spark, mark):
    """Whatever a url holds, the fields are the record's own, also where a single column is asked for."""
    names = ["WARC-Type", "WARC-Payload-Length", "WARC-Payload-Digest", "WARC-Record-ID", "WARC-Refers-To", "Content-Length", "WARC-Target-URI"]
    rows = [(k, f"http://x/{mark}{name}: 7{mark}", f"page {k}") for k, name in enumerate(names)] + [(10, f"{mark}WARC-Type: response", "page 0")]
    df = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"))
    asked = {r.page_id: r for r in df.collect()}
    assert {k: r.payload_bytes for k, r in asked.items()} == {k: 6 for k, _, _ in rows}
    assert {k: r.refers_to for k, r in asked.items() if r.record_type == "revisit"} == {0: 10}
    assert {k: r.url for k, r in asked.items()} == {k: url.replace("\r", "%0D").replace("\n", "%0A") for k, url, _ in rows}
    assert Counter(tuple(r) for r in df.select("page_id", "payload_bytes").collect()) == Counter((k, 6) for k, _, _ in rows)


def test_a_record_that_lies_is_found_whatever_is_asked(spark):
    """The check holds for a projection without the digest."""
    good = warc.records(spark, _written(spark)).head()["record"]
    lie = spark.createDataFrame([(bytes(good).replace(b"WARC-Payload-Length: ", b"WARC-Payload-Length: 1"),)], "record binary")
    with pytest.raises(Exception, match="does not match its digest or length"):
        warc.parsed(lie).select("page_id").collect()


def _written(spark):
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/lie"
    warc.write(spark.createDataFrame([(1, "u", "some text")], "page_id long, url string, html string"), folder)
    return folder


def test_many_rows_alike(spark, monkeypatch):
    """One page over and over, and pages without an id that share a payload: one response each, the rest revisits."""
    monkeypatch.setattr(warc, "SPAN", 7)
    rows = [(1, "u", "same")] * 100 + [(None, f"u{k % 30}", "empty") for k in range(90)]
    got = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == {(1, "response", None): 1, (1, "revisit", 1): 99, (None, "response", None): 1, (None, "revisit", None): 89}
    assert Counter(r.url for r in got) == Counter(r[1] for r in rows)
