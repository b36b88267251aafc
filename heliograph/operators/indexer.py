"""A library on disk, and the scan that brings it up to date."""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import socket
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import images as I
from ..functions.text import composed, search_name
from ..schema import APPEARANCE_VERSION, APPEARANCES, CURRENT_MODELS, FOLDERS, ITEMS, THUMBNAILS, Catalog
from ..sources import files as S
from . import dml, indexing, labels, stats
from .layout import tagged
from .segments import Segments, changes
from .versions import Versions

TABLES = {"appearances": APPEARANCES, "thumbnails": THUMBNAILS, "folders": FOLDERS}
#: how a state names its segments, before their place
SEGMENT = "segment-"
FILES_A_BATCH = 5_000
#: images that a model is given at once (fixed value)
EMBED_BATCH = 16
DESCRIPTOR = 512


class Library:
    """The tables below a folder, which change together; one writer at a time.

    Items and their full-text index lie in ``segments``, so an edit writes the rows that it touches; the
    other tables are written whole.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.versions = Versions(spark, self.root)
        missing = {name: spark.createDataFrame([], schema) for name, schema in TABLES.items() if name not in self.versions.current()[1]}
        if missing:
            self.versions.publish(**missing)

    def _segments(self, state: dict[str, str]) -> Segments:
        return Segments(self.spark, tuple(f"{self.root}/{state[name]}" for name in sorted(state) if name.startswith(SEGMENT)))

    def segments(self) -> Segments:
        return self._segments(self.versions.current()[1])

    def table(self, name: str) -> DataFrame:
        return self.segments().items() if name == "items" else self.versions.table(name, TABLES[name])

    def catalog(self) -> Catalog:
        """All tables of one state."""
        state = self.versions.current()[1]
        t = {name: self.spark.read.schema(schema).parquet(f"{self.root}/{state[name]}") for name, schema in TABLES.items()}
        own = self._segments(state)
        return Catalog(own.items(), t["appearances"], t["thumbnails"], t["folders"], own.index() if own.folders else None)

    def stage(self, name: str, df: DataFrame) -> tuple[str, DataFrame]:
        return self.versions.stage(name, df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name]]))

    def stage_items(self, items: DataFrame, touched: DataFrame | None = None) -> Segments:
        """The segments with one more for the items that differ from the present ones (touched: id and texts of those, where they are known)."""
        own = self.segments()
        if touched is None:
            touched = changes(own.items(), items).persist()
            if touched.isEmpty():
                touched.unpersist()
                return own
        out = own.append(f"{self.root}/segments", items, touched)
        touched.unpersist()
        return out

    def publish(self, **tables: DataFrame) -> None:
        """Make new versions of some tables current, all at once; with the items goes their index."""
        items = tables.pop("items", None)
        self.commit({name: self.stage(name, df) for name, df in tables.items()}, None if items is None else self.stage_items(items))

    def commit(self, staged: dict[str, tuple[str, DataFrame]], segments: Segments | None = None) -> None:
        """Make staged tables and segments current, all at once."""
        folders: dict[str, str | None] = {name: folder for name, (folder, _) in staged.items()}
        if segments is not None:
            made = segments.compacted(f"{self.root}/segments")
            folders |= {name: None for name in self.versions.current()[1] if name.startswith(SEGMENT)}
            folders |= {f"{SEGMENT}{k:06d}": f.removeprefix(f"{self.root}/") for k, f in enumerate(made.folders)}
            for folder in set(segments.folders) - set(made.folders) - set(self.segments().folders):  # merged before any state named it
                self.versions.delete(folder.removeprefix(f"{self.root}/"))
        self.versions.commit(folders)

    @contextmanager
    def writer(self) -> Iterator[None]:
        """Held by one writer; another gets an error, as the lock file can be made once only.  The lock of a process of this machine that is gone is void."""
        own = json.dumps({"host": socket.gethostname(), "pid": os.getpid()})
        if not self.versions.create("LOCK", own):
            if self._held() or not self.versions.create("LOCK", own):
                raise RuntimeError(f"{self.root} is being written by another process")
        try:
            yield
        finally:
            self.versions.delete("LOCK")

    def _held(self) -> bool:
        try:
            holder = json.loads(self.versions.read("LOCK"))
            if holder["host"] != socket.gethostname():
                return True
            os.kill(holder["pid"], 0)
        except ProcessLookupError:
            self.versions.delete("LOCK")
            return False
        except Exception:  # a lock that can't be read, or a process that may not be asked, counts as held
            return True
        return True

    def remove_folder(self, folder: str) -> None:
        """Forget a folder and all that came from it; its files stay."""
        with self.writer():
            c = self.catalog()
            names = ("items", "appearances", "thumbnails", "folders")
            self.publish(**dict(zip(names, dml.remove_folder(c.items, c.appearances, c.thumbnails, c.folders, S.canonical(self.spark, folder)), strict=True)))

    def _edit(self, item: int, texts: bool, change: Callable[[DataFrame], DataFrame]) -> None:
        with self.writer():
            row = self.table("items").filter(F.col("id") == item)
            new = change(row).persist()
            if not new.isEmpty():
                self.commit({}, self.stage_items(new, new.select("id", F.lit(texts).alias("texts"))))
            new.unpersist()

    def set_notes(self, item: int, notes: str) -> None:
        self._edit(item, True, lambda row: dml.set_notes(row, F.col("id") == item, F.lit(notes)))

    def set_favorite(self, item: int, favorite: bool) -> None:
        self._edit(item, False, lambda row: dml.set_favorite(row, F.col("id") == item, F.lit(favorite)))


LOOKED = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("path", "folder", "name")],
        *[T.StructField(n, T.LongType()) for n in ("modified", "bytes")],
        T.StructField("embed", T.BooleanType()),
        *[T.StructField(n, T.IntegerType()) for n in ("width", "height")],
        T.StructField("hash", T.StringType()),
        T.StructField("descriptor", T.ArrayType(T.FloatType())),
        T.StructField("thumbnail", T.BinaryType()),
        T.StructField("error", T.StringType()),
        T.StructField("model", T.StringType()),
    ]
)
VECTORS = T.StructType([T.StructField("hash", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def _looked_at(images: DataFrame) -> DataFrame:
    """path, width, height, hash (of the model input), descriptor, thumbnail, error; an image at a time is decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for k in range(b.num_rows):
                r = {name: b.column(name)[k].as_py() for name in ("path", "width", "height", "channels", "data", "turn", "error")}
                try:
                    if r["error"]:
                        raise ValueError(r["error"])
                    a = I.pixels(r["data"], r["height"], r["width"], r["channels"], r["turn"])
                    digest = I.model_input(a).tobytes()
                    out.append((r["path"], r["width"], r["height"], hashlib.blake2b(digest, digest_size=32).hexdigest(), I.descriptor(a), I.thumbnail(a), None))
                except Exception as e:  # one bad image is one row's error
                    out.append((r["path"], None, None, None, None, None, str(e) or type(e).__name__))
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.float32()), pa.binary(), pa.string()]
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["path", "width", "height", "hash", "descriptor", "thumbnail", "error"])

    return images.mapInArrow(run, "path string, width int, height int, hash string, descriptor array<float>, thumbnail binary, error string")


class Model:
    """What embeds model inputs (3 x 224 x 224 floats).

    one: a vector of one input.  many: the vectors of up to EMBED_BATCH stacked inputs, used where given.
    fallback: as one; takes over the inputs of a batch that fails.
    """

    def __init__(self, one: Callable[[np.ndarray], Sequence[float]], many: Callable[[np.ndarray], Sequence[Sequence[float]]] | None = None, fallback: Callable[[np.ndarray], Sequence[float]] | None = None) -> None:
        self.one, self.many, self.fallback = one, many, fallback

    def vectors(self, inputs: list[np.ndarray]) -> list[np.ndarray]:
        try:
            out = self.many(np.stack(inputs)) if self.many else [self.one(x) for x in inputs]
            if len(out) != len(inputs):
                raise ValueError("not a vector for each input")
        except Exception:
            if not self.many and not self.fallback:
                raise
            out = [(self.fallback or self.one)(x) for x in inputs]
        return [np.asarray(v, np.float32) for v in out]


class Indexer:
    """Scans folders into a library.

    embed turns a model input into a vector (a function of one input, or a Model); without it
    items have no vectors.  Files go in batches: each is decoded and embedded (equal
    images once), and what was found is kept below ``pending``.  At the end all batches are
    merged into the library's tables, which are written once and change at once; a scan that was
    stopped merges what it has, and batches that a crash has left are merged by the next scan.
    """

    def __init__(self, library: Library, embed: Callable[[np.ndarray], Sequence[float]] | Model | None = None, model: str = CURRENT_MODELS[0], bank: list[tuple[str, list[float]]] | None = None) -> None:
        self.library, self.model, self.bank = library, model, bank
        self.embed = Model(embed) if embed is not None and not isinstance(embed, Model) else embed
        self.cancelled = False
        self._tag = f"scan-{uuid.uuid4().hex}"

    def cancel(self) -> None:
        """Stop a scan, also in the middle of a batch, from any thread: its running jobs end, and finished batches stay."""
        self.cancelled = True
        self.library.spark.sparkContext.cancelJobsWithTag(self._tag)

    def scan(self, folders: list[str] | None = None, force: bool = False, appearance_only: bool = False, files_a_batch: int = FILES_A_BATCH) -> dict:
        """Bring the library up to date; returns counts, errors (the first 30) and times."""
        with self.library.writer():
            return self._scan(folders, force, appearance_only, files_a_batch)

    def _scan(self, folders: list[str] | None, force: bool, appearance_only: bool, files_a_batch: int) -> dict:
        began, spark, lib = time.monotonic(), self.library.spark, self.library
        out = {"changed": 0, "skipped": 0, "failed": 0, "inference": 0, "reused": 0, "batches": 0, "errors": [], "cancelled": False}
        self._merge()
        if folders:
            known = spark.createDataFrame([(S.canonical(spark, f),) for f in folders], FOLDERS)
            lib.publish(folders=dml.insert_or_ignore(lib.table("folders"), known, "path"))
        names = folders or [r["path"] for r in lib.table("folders").orderBy("path").collect()]
        found, reachable, problems = S.scan(spark, names)
        out["errors"] += problems
        files = dml.first_root_wins(found).select("path", "folder", "name", "modified", "bytes").persist()
        dimensions = self._dimensions()
        classified = indexing.classify(files, _entries(lib.catalog(), dimensions), force, appearance_only).persist()
        out["skipped"] = classified.filter(F.col("status").isin("unchanged", "skipped")).count()
        jobs = indexing.jobs(classified).select("path", "folder", "name", "modified", "bytes", "embed").orderBy("path")
        waiting = jobs.toLocalIterator()
        while batch := list(itertools.islice(waiting, files_a_batch)):
            if self.cancelled:
                out["cancelled"] = True
                break
            try:
                with tagged(spark, self._tag):
                    self._batch(spark.createDataFrame(batch, jobs.schema), [r["path"] for r in batch], out)
            except Exception:
                if not self.cancelled:
                    raise
                out["cancelled"] = True
                break
        if self.cancelled or appearance_only or not reachable:
            self._merge()
        else:
            self._merge(found.select("folder", "path").distinct(), spark.createDataFrame([(f,) for f in reachable], "folder string"))
        files.unpersist()
        classified.unpersist()
        out["errors"] = out["errors"][: indexing.MOST_ERRORS]
        out["elapsed_ms"] = round((time.monotonic() - began) * 1000, 1)
        return out

    def _dimensions(self) -> int:
        return len(self.embed.vectors([np.zeros((3, I.SIDE, I.SIDE), np.float32)])[0]) if self.embed else 0

    def _batch(self, jobs: DataFrame, paths: list[str], out: dict) -> None:
        """Decode and embed some files; the results wait below ``pending``."""
        spark, lib = jobs.sparkSession, self.library
        at = f"{lib.root}/pending/{out['batches']:09d}"
        raw = S.images(spark, paths)
        # files that changed while they were read are left to the next scan
        now = spark.read.format("binaryFile").load(paths).select("path", F.unix_millis("modificationTime").alias("_m"), F.col("length").alias("_b"))
        same = ((F.col("_m") == F.col("modified")) & (F.col("_b") == F.col("bytes"))).eqNullSafe(F.lit(True))
        checked = _looked_at(raw).join(jobs, "path").join(now, "path", "left").withColumn("error", F.when(F.col("error").isNull() & ~same, F.lit("changed while it was read")).otherwise(F.col("error")))
        # what is counted is counted on the way to the disk
        seen, made = Observation(), Observation()
        found = checked.withColumn("model", F.lit(self.model if self.embed else None).cast("string")).select(*[f.name for f in LOOKED])
        found.observe(seen, F.count(F.when(F.col("error").isNull(), 1)).alias("good"), F.count("error").alias("bad"), F.count(F.when(F.col("error").isNull() & F.col("embed"), 1)).alias("new")).write.parquet(f"{at}/looked")
        looked = spark.read.schema(LOOKED).parquet(f"{at}/looked")
        good, bad = indexing.split_errors(looked)
        new = good.filter("embed")
        vectors = self._vectors(raw, new) if self.embed else spark.createDataFrame([], VECTORS)
        vectors.observe(made, F.count(F.lit(1)).alias("n")).write.parquet(f"{at}/vectors")  # with this the batch is complete
        counts = seen.get
        if counts["bad"]:
            out["errors"] += [f"{r['path']}: {r['error']}" for r in indexing.error_log(bad, "path").collect()]
        out["failed"] += counts["bad"]
        out["changed"] += counts["good"]
        if self.embed:
            out["inference"] += made.get["n"]
            out["reused"] += counts["new"] - made.get["n"]
        out["batches"] += 1

    def _merge(self, seen: DataFrame | None = None, reachable: DataFrame | None = None) -> None:
        """Bring waiting batches into the tables, and with seen forget items of reachable folders that were not seen; all tables change at once."""
        spark, lib = self.library.spark, self.library
        waiting = [f"{lib.root}/pending/{name}" for name in lib.versions.names("pending") if lib.versions.exists(f"pending/{name}/vectors/_SUCCESS")]
        c = lib.catalog()
        items, thumbnails, appearances = c.items, c.thumbnails, c.appearances
        if waiting:
            good, _ = indexing.split_errors(spark.read.schema(LOOKED).parquet(*[f"{at}/looked" for at in waiting]))
            vectors = spark.read.schema(VECTORS).parquet(*[f"{at}/vectors" for at in waiting]).dropDuplicates(["hash"])
            rows = self._rows(good.filter("embed").join(vectors, "hash", "left"))
            items = dml.upsert(items, rows.select(*[f.name for f in ITEMS]))
            thumbnails = dml.insert_or_ignore(thumbnails, rows.select(F.col("thumb").alias("key"), F.col("thumbnail").alias("data")), "key")
        gone = False
        if seen is not None:
            left = dml.prune_unseen(items, seen, reachable)
            gone = c.items.join(reachable, "folder", "left_semi").join(seen, ["folder", "path"], "left_anti").limit(1).count() > 0
            items = left
        if waiting or gone:
            staged, segments = {}, lib.stage_items(items)
            items = segments.items()
            if waiting:
                offered = good.select("path", "modified", "bytes", F.lit(APPEARANCE_VERSION).alias("version"), "descriptor")
                appearances = dml.guarded_replace(appearances, items, offered)
            if seen is not None:
                thumbnails = dml.prune_thumbnails(thumbnails, items)
            staged["appearances"] = lib.stage("appearances", dml.cascade(appearances, items))
            staged["thumbnails"] = lib.stage("thumbnails", thumbnails)
            lib.commit(staged, segments)
        lib.versions.delete("pending")

    def _rows(self, new: DataFrame) -> DataFrame:
        """Items of the decoded files."""
        new = new.withColumns({"id": F.abs(F.xxhash64("path")) % (1 << 62), "thumb": F.concat(F.lit("thumb:"), F.sha2("thumbnail", 256))})
        if self.bank and self.embed:
            new = new.join(labels.zero_shot(new.filter("embedding IS NOT NULL").select("path", "embedding"), self.bank, key="path").withColumnRenamed("labels", "tags"), "path", "left").fillna("", ["tags"])
        else:
            new = new.withColumn("tags", F.lit(""))
        return new.withColumns({"search_name": search_name(composed("name")), "favorite": F.lit(False), "ocr": F.lit(""), "notes": F.lit("")})

    def _vectors(self, raw: DataFrame, rows: DataFrame) -> DataFrame:
        """hash and embedding: equal images are embedded once, EMBED_BATCH at a time."""
        model = self.embed
        one = rows.groupBy("hash").agg(F.min("path").alias("_path"))
        chosen = raw.join(one, F.col("path") == F.col("_path")).select("hash", "width", "height", "channels", "data", "turn")

        def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray]]:
            for b in batches:
                for k in range(b.num_rows):
                    r = {name: b.column(name)[k].as_py() for name in b.schema.names}
                    yield r["hash"], I.model_input(I.pixels(r["data"], r["height"], r["width"], r["channels"], r["turn"]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rest = inputs(batches)
            while some := list(itertools.islice(rest, EMBED_BATCH)):
                vectors = model.vectors([x for _, x in some])
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in some]), pa.array(vectors, pa.list_(pa.float32()))], names=["hash", "embedding"])

        return chosen.mapInArrow(run, "hash string, embedding array<float>")


def _entries(catalog: Catalog, dimensions: int) -> DataFrame:
    """Scan entries; without an embedder no vector is due."""
    a = catalog.appearances.select("photo_id", "modified", "bytes", "version", F.when(F.size("descriptor") == DESCRIPTOR, F.array_repeat(F.lit(0.0).cast("float"), dimensions)).alias("descriptor"))
    rows = stats.scan_entries(Catalog(catalog.items, a), dimensions)
    return rows if dimensions else rows.withColumn("embedding_current", F.lit(True))

