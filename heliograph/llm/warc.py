"""WARC archive, content-addressed.

An archive is two tables in the cluster's shared storage: ``payloads`` holds
every distinct payload once, under its SHA-256; ``headers`` holds the exact
header bytes of every record and the digest of its payload.  Original records
are put together again by a join on the digest; on the way each payload is held
against its digest, and its record's own digest and length, and a mismatch
fails the job.  Of records with equal payloads the one with the largest page_id
is a response, the others are revisits that refer to it (WARC 1.1, profile
identical-payload-digest) and have no block.

Only SQL functions are used.  ``export`` writes WARC files of about a given size,
plain or gzipped, through Spark's text writer, whose line separator is the end of a WARC record.
``read_files`` streams such files, and others of any size, gzipped in one member or one a record,
and cuts them by Content-Length; a record at a time is in memory.

Defined cases: a null html is an empty payload; a null url gives an empty
WARC-Target-URI; a url may have any length; CR and LF in it are percent-encoded; a null page_id orders
before others and is kept; rows alike in page_id and payload are one response
and revisits of it; no rows give empty tables; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import delete, shared_folder, spread_join, stored, swept

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: longest array that one row is exploded into at once
SPAN = 100_000
#: about the size of an exported file
FILE_BYTES = 256 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in bare upper-case base32: 160 bits are 32 digits of 5 bits."""
    hexed = F.sha1(data)
    digits = []
    for k in range(4):  # 40 bits at a time
        part = F.conv(F.substring(hexed, 10 * k + 1, 10), 16, 10).cast("long")
        digits += [F.substring(F.lit(BASE32), F.shiftright(part, s).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for s in range(35, -1, -5)]
    return F.concat(*digits)


def _records(pages: DataFrame) -> DataFrame:
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    url = F.replace(F.replace(F.coalesce(F.col("url"), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"))
    return rows.select("*", F.sha2("payload", 256).alias("digest"), base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("n_bytes"))


def header(kind: Column) -> Column:
    """The exact bytes before a record's block, as text; kind is response or revisit."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(CRLF * 2))
    block = F.octet_length(http) + F.when(kind == "response", F.col("n_bytes")).otherwise(F.lit(0))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(":"), F.col("nth"), F.lit(">")),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("n_bytes").cast("string")),
        F.when(kind == "revisit", F.concat(F.lit(f"WARC-Profile: {REVISIT}{CRLF}WARC-Refers-To: <urn:page:"), F.coalesce(F.col("refers_to").cast("string"), F.lit("null")), F.lit(":0>"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), block.cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), http)


def write(pages: DataFrame, folder: str) -> None:
    """Write the two tables of an archive of pages below folder.

    The headers are decided from digests alone (no payload is shuffled); the
    payloads then take one shuffle, in which each digest keeps one copy.
    """
    records = _records(pages)
    spark = pages.sparkSession
    thin = stored(records.drop("payload"), "warc-digests")
    # of equal payloads the largest page_id responds: an aggregation with map-side combine, then a join on the digest
    answers = stored(thin.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")), "warc-answers")
    own = spread_join(thin, answers.select("digest", "refers_to"), "digest", answers.select("digest", "n"), F.xxhash64("page_id", "url"))
    # of the rows of the responding page, the first of those with the least url responds; rows alike are one row with their number till then
    answering = own.filter(F.col("page_id").eqNullSafe(F.col("refers_to")))
    alike = answering.groupBy(*own.columns).agg(F.count(F.lit(1)).alias("copies"))
    first = answering.groupBy("digest").agg(F.min("url").alias("first"))
    counted = spread_join(alike, first, "digest", alike.groupBy("digest").agg(F.count(F.lit(1)).alias("n")), F.xxhash64("url"))
    counted = counted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / F.lit(SPAN)))))
    counted = counted.withColumn("copy", F.explode(F.sequence(F.col("block") * SPAN, F.least(F.col("block") * SPAN + SPAN, F.col("copies")) - 1)))
    responds = (F.col("url") == F.col("first")) & (F.col("copy") == 0)
    # what tells records of one page and payload apart; the response has 0
    nth = F.when(responds, F.lit("0")).otherwise(F.concat(F.substring(F.sha2(F.col("url").cast("binary"), 256), 1, 16), F.lit("-"), F.col("copy").cast("string")))
    candidates = counted.select(*own.columns, nth.alias("nth"))
    others = own.filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).withColumn("nth", F.lit("0"))
    marked = candidates.unionByName(others)
    kind = F.when(F.col("page_id").eqNullSafe(F.col("refers_to")) & (F.col("nth") == "0"), "response").otherwise("revisit")
    with swept(spark):
        marked.select("page_id", "digest", header(kind).alias("header")).write.parquet(f"{folder}/headers")
        records.select("digest", "payload").dropDuplicates(["digest"]).write.parquet(f"{folder}/payloads")
    delete(spark, thin._stored_at)
    delete(spark, answers._stored_at)


def records(spark: SparkSession, folder: str) -> DataFrame:
    """digest and the exact bytes (header, block) of every record of an archive."""
    headers = spark.read.schema("page_id long, digest string, header string").parquet(f"{folder}/headers")
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{folder}/payloads")
    is_response = F.col("header").startswith(f"WARC/1.1{CRLF}WARC-Type: response{CRLF}")
    proven = payloads.select("digest", "payload", F.sha2("payload", 256).alias("proof"))
    checked = F.when(F.col("proof") == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("digest"))).cast("binary"))
    with_block = headers.filter(is_response).join(proven, "digest", "left").select("digest", F.concat(F.col("header").cast("binary"), F.coalesce(checked, F.raise_error(F.lit("payload missing")).cast("binary"))).alias("record"))
    return with_block.unionByName(headers.filter(~is_response).select("digest", F.col("header").cast("binary").alias("record")))


def parsed(rows: DataFrame, record: str = "record") -> DataFrame:
    """The fields of record bytes; a response's payload is held against its own digest and length."""
    whole = F.col(record)
    # the WARC header and the HTTP header end at the first and second empty line, wherever these are: a url may have any
    # length; a cast keeps the bytes and substring_index looks for bytes, so no payload is decoded; both headers are ASCII apart from the URI
    head = lambda n: F.substring_index(whole.cast("string"), CRLF * 2, n).cast("binary")
    warc = F.decode(head(1), "ISO-8859-1")
    # a field is a line that begins with its name, and lines end with CR LF alone: other line ends of Unicode are part of a value
    field = lambda name: F.ltrim(F.substring(F.coalesce(F.get(F.filter(F.col("_fields"), lambda x: F.lower(F.substring(x, 1, len(name) + 1)) == f"{name.lower()}:"), F.lit(0)), F.lit("")), len(name) + 2, 1 << 30))
    rows = rows.select(F.split(warc, CRLF).alias("_fields"), F.octet_length(head(2)).alias("_head"), F.length(warc).alias("_first"), whole.alias("_record"))
    rows = rows.select("*", field("WARC-Type").alias("record_type"), field("WARC-Payload-Digest").alias("_sha1"), field("WARC-Payload-Length").cast("long").alias("payload_bytes"), field("Content-Length").cast("long").alias("_block"))
    rows = rows.withColumn("payload", F.when(F.col("record_type") == "response", F.expr("substring(_record, _head + 5)")))
    own = F.concat(F.lit("sha1:"), base32_sha1(F.col("payload")))
    good = F.col("payload").isNull() | ((own == F.col("_sha1")) & (F.octet_length("payload") == F.col("payload_bytes")) & (F.octet_length("_record") - F.col("_first") - 4 == F.col("_block")))
    page, refers = (F.regexp_extract(field(name), "^<urn:page:([^:>]*):", 1) for name in ("WARC-Record-ID", "WARC-Refers-To"))
    # a filter, so that the check holds whatever columns are asked for
    rows = rows.filter(F.coalesce(good, F.lit(False)) | F.raise_error(F.lit("record does not match its digest or length")).cast("boolean"))
    return rows.select(
        F.when(page != "null", page).cast("long").alias("page_id"),
        "payload_bytes",
        F.substring(F.col("_sha1"), 6, 32).alias("payload_digest"),
        "record_type",
        F.when((F.col("record_type") == "revisit") & (refers != "null"), refers).cast("long").alias("refers_to"),
        F.decode(F.encode(field("WARC-Target-URI"), "ISO-8859-1"), "UTF-8").alias("url"),
        "payload",
    )


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages into a fresh archive and read every record back from it."""
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, folder)
    return parsed(records(spark, folder))


def export(rows: DataFrame, folder: str, file_bytes: int = FILE_BYTES, compression: str | None = None) -> None:
    """WARC files of about file_bytes each of record bytes: each record, then the two line ends that close it.  compression: None or gzip."""
    total = rows.agg(F.coalesce(F.sum(F.octet_length("record").cast("long")), F.lit(0))).head()[0]
    files = max(1, -(-total // file_bytes))
    text = rows.repartition(files, F.xxhash64("record")).select(F.col("record").cast("string").alias("value"))
    text.write.option("lineSep", CRLF * 2).option("compression", compression or "none").text(folder)


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The records of a WARC file that comes in pieces, by Content-Length; ValueError if it ends inside one."""
    held, need = bytearray(), None
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                while held[:2] == b"\r\n":
                    del held[:2]
                stop = held.find(b"\r\n\r\n")
                if stop < 0:
                    break
                size = [x.split(b":", 1)[1] for x in bytes(held[:stop]).split(b"\r\n") if x.lower().startswith(b"content-length:")]
                if not held.startswith(b"WARC/") or not size:
                    raise ValueError("not a WARC record")
                need = stop + 4 + int(size[0])
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held.strip(b"\r\n"):
        raise ValueError("the file ends inside a record")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """The record bytes in WARC files, plain or gzipped.

    Spark's text source streams and unpacks a file in pieces that end with an empty line.  A session of its
    own sees to it that each file is one task: what a file holds is only known from its start.
    """
    apart = spark.newSession()
    for name, value in (("maxPartitionBytes", 1 << 62), ("openCostInBytes", 1 << 45), ("minPartitionNum", 1 << 30)):
        apart.conf.set(f"spark.sql.files.{name}", value)
    lines = apart.read.option("lineSep", CRLF * 2).text(folder).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("path"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((path, value.as_py()) for b in batches for value, path in zip(b.column(0), b.column(1).to_pylist(), strict=True))
        for _, own in groupby(rows, key=lambda x: x[0]):
            for record in split_records(piece + b"\r\n\r\n" for _, piece in own):
                yield pa.RecordBatch.from_arrays([pa.array([record], pa.binary())], names=["record"])

    return lines.mapInArrow(cut, "record binary")
