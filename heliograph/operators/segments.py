"""Items and their full-text index in segments that never change.

An edit writes one segment: the new rows of the items that it touches, the
postings of those whose texts changed, and the ids that it replaces in all
segments before.  What an older segment says of a replaced id is void; readers
see to that by a join with the replaced ids, which are few beside the rows, and only on
rows that their own filters have left.  Segments are merged, newest first, once several of like size
have come together, so there are about as many as the logarithm of the number of edits,
and a row is written again as often.
"""

from __future__ import annotations

import uuid
from functools import cached_property, reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens
from ..schema import ITEMS, TEXT_COLUMNS
from .layout import dealt
from .lexical import Index

#: a segment joins the merge of those after it if it is at most so many times as large as they are together; so many are merged at least
RATIO, WIDTH = 2, 4
#: postings of one task that writes them: as few as the first while there are cores without work, never more than about the second
LEAST_POSTINGS, MOST_POSTINGS = 1 << 18, 1 << 21

_SEQ = T.StructField("seq", T.IntegerType())
POSTINGS = T.StructType([T.StructField("id", T.LongType()), T.StructField("col", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("term", T.StringType()), T.StructField("length", T.LongType()), _SEQ])
LENGTHS = T.StructType([T.StructField("id", T.LongType()), T.StructField("length", T.LongType()), _SEQ])
REPLACED = T.StructType([T.StructField("id", T.LongType()), T.StructField("texts", T.BooleanType()), _SEQ])
#: what a segment adds to the number of items and of their tokens, and the ids that it touches
TOTALS = T.StructType([T.StructField("items", T.LongType()), T.StructField("tokens", T.LongType()), T.StructField("touched", T.LongType()), _SEQ])
TABLES = {"items": T.StructType([*ITEMS.fields, _SEQ]), "postings": POSTINGS, "lengths": LENGTHS, "replaced": REPLACED, "totals": TOTALS}


def due(sizes: list[int]) -> int | None:
    """The place from which segments (sizes, oldest first) are to be merged into one, if any are."""
    start, total = len(sizes) - 1, sizes[-1] if sizes else 0
    while start > 0 and sizes[start - 1] <= RATIO * total:
        start -= 1
        total += sizes[start]
    return start if len(sizes) - start >= WIDTH else None


def _tokens(items: DataFrame) -> DataFrame:
    """id, the token array of each text column, and their number (length); a generator of one row, so that no use of a token array makes it again."""
    rows = dealt(items, "id", held=True).select("id", F.inline(F.array(F.struct(*[tokens(c).alias(c) for c, _ in TEXT_COLUMNS]))))
    return rows.withColumn("length", reduce(lambda a, b: a + b, [F.size(c) for c, _ in TEXT_COLUMNS]).cast("long"))


def _postings(rows: DataFrame) -> DataFrame:
    """id, col, pos, term of every token, with the length of its item."""
    arrays = [F.struct(F.lit(c).alias("col"), F.col(c).alias("words")) for c, _ in TEXT_COLUMNS]
    rows = rows.select("id", "length", F.explode(F.array(*arrays)).alias("x"))
    return rows.select("id", F.col("x.col").alias("col"), F.posexplode("x.words").alias("pos", "term"), "length")


def parts(spark: SparkSession, postings: int) -> int:
    """The number of tasks that write so many postings."""
    return max(min(spark.sparkContext.defaultParallelism, -(-postings // LEAST_POSTINGS)), -(-postings // MOST_POSTINGS), 1)


class Segments:
    """The segments in some folders, oldest first; a segment's number is its place in the order of edits."""

    def __init__(self, spark: SparkSession, folders: tuple[str, ...] = ()) -> None:
        self.spark, self.folders = spark, tuple(folders)

    def _read(self, name: str, folders: tuple[str, ...] | None = None) -> DataFrame:
        folders = self.folders if folders is None else folders
        return self.spark.read.schema(TABLES[name]).parquet(*[f"{f}/{name}" for f in folders]) if folders else self.spark.createDataFrame([], TABLES[name])

    def replaced(self, texts: bool = False) -> DataFrame | None:
        """id and the last segment that replaces it (texts: its texts); None where nothing is."""
        if len(self.folders) < 2:
            return None
        rows = self._read("replaced", self.folders[1:])
        return (rows.filter("texts") if texts else rows).groupBy("id").agg(F.max("seq").alias("last"))

    def live(self, rows: DataFrame, texts: bool = False) -> DataFrame:
        """Rows (id, seq) that no later segment has replaced."""
        last = self.replaced(texts)
        return rows if last is None else rows.join(last, "id", "left").filter(F.col("last").isNull() | (F.col("seq") >= F.col("last"))).drop("last")

    def items(self) -> DataFrame:
        return self.live(self._read("items")).drop("seq")

    def index(self) -> Index:
        totals = (sum(r["items"] for r in self.counts), sum(r["tokens"] for r in self.counts))
        return Index(self._read("postings"), self.live(self._read("lengths"), texts=True).drop("seq"), totals, self.replaced(texts=True))

    @cached_property
    def counts(self) -> list[Row]:
        """The totals of each segment, oldest first: a row a segment."""
        return self._read("totals").orderBy("seq").collect()

    def sizes(self) -> list[int]:
        """Ids touched by each segment."""
        return [r["touched"] for r in self.counts]

    def number(self) -> int:
        return max((r["seq"] for r in self.counts), default=0)

    def _write(self, folder: str, seq: int, n_postings: int = 0, **tables: DataFrame) -> None:
        for name, df in tables.items():
            rows = df.withColumn("seq", F.lit(seq)).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name]])
            if name == "postings":  # in the order of terms, so that the statistics of row groups tell a reader which terms are where; a frequent term is several parts
                rows = rows.repartitionByRange(parts(self.spark, n_postings), "term", "id").sortWithinPartitions("term", "id", "col", "pos")
            elif name == "items":
                rows = rows.repartitionByRange("id").sortWithinPartitions("id")
            rows.write.parquet(f"{folder}/{name}")

    def append(self, root: str, items: DataFrame, replaced: DataFrame, keep_items: bool = True) -> Segments:
        """The segments with one more below root: items are all new rows, of which those whose id is in replaced (id, texts) count."""
        folder, seq = f"{root}/{uuid.uuid4().hex}", self.number() + 1
        self._write(folder, seq, replaced=replaced)
        touched = self.spark.read.schema(REPLACED).parquet(f"{folder}/replaced")
        changed = items.join(touched.select("id"), "id", "left_semi") if self.folders else items
        texts = changed.join(touched.filter("texts").select("id"), "id", "left_semi") if self.folders else items
        words = _tokens(texts).persist()  # read for the ranges, the postings and the lengths
        n_postings = words.agg(F.coalesce(F.sum("length"), F.lit(0))).head()[0]
        self._write(folder, seq, n_postings, **({"items": changed} if keep_items else {}), postings=_postings(words), lengths=words.select("id", "length"))
        words.unpersist()
        new = self.spark.read.schema(LENGTHS).parquet(f"{folder}/lengths").select(F.lit(1).alias("sign"), "length")
        old = self.live(self._read("lengths"), texts=True).join(touched.filter("texts").select("id"), "id", "left_semi").select(F.lit(-1).alias("sign"), "length")
        ids = touched.count() if self.folders else new.count()
        count = lambda x: F.coalesce(F.sum(x), F.lit(0))
        totals = new.unionByName(old).agg(count(F.col("sign")).alias("items"), count(F.col("sign") * F.col("length")).alias("tokens"), F.lit(ids).alias("touched"))
        self._write(folder, seq, totals=totals)
        return Segments(self.spark, (*self.folders, folder))

    def merged(self, start: int, root: str, keep_items: bool = True) -> Segments:
        """The segments with those from a place on made into one."""
        own, folder = Segments(self.spark, self.folders[start:]), f"{root}/{uuid.uuid4().hex}"
        seq = own.number()
        replaced = own._read("replaced").groupBy("id").agg(F.max("texts").alias("texts"))
        totals = own._read("totals").agg(F.sum("items").alias("items"), F.sum("tokens").alias("tokens"))
        ids = own.live(own._read("lengths"), texts=True).select("id").union(replaced.select("id")).distinct().count() if start else totals.head()["items"]
        tables = {"items": own.live(own._read("items"))} if keep_items else {}
        tables |= {"postings": own.live(own._read("postings"), texts=True), "lengths": own.live(own._read("lengths"), texts=True)}
        # nothing lies before the first segment that could be replaced
        n_postings = own._read("postings").count()  # from the footers of its files
        self._write(folder, seq, n_postings, replaced=replaced if start else replaced.limit(0), totals=totals.withColumn("touched", F.lit(ids)), **tables)
        return Segments(self.spark, (*self.folders[:start], folder))

    def compacted(self, root: str, keep_items: bool = True) -> Segments:
        start = due(self.sizes())
        return self if start is None else self.merged(start, root, keep_items)


def built(spark: SparkSession, root: str, items: DataFrame, keep_items: bool = False) -> Segments:
    """One segment of all items below root."""
    return Segments(spark).append(root, items, spark.createDataFrame([], REPLACED).select("id", "texts"), keep_items)


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """id and texts (whether they differ) of the items that are new, changed or gone."""
    named = lambda columns: F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))])
    every, texts = [f.name for f in ITEMS], [c for c, _ in TEXT_COLUMNS]
    side = lambda df, p: df.select("id", named(every).alias(f"{p}_all"), named(texts).alias(f"{p}_texts"))
    both = side(old, "a").join(side(new, "b"), "id", "full")
    unlike = lambda x: ~F.col(f"a_{x}").eqNullSafe(F.col(f"b_{x}"))
    return both.filter(unlike("all")).select("id", unlike("texts").alias("texts"))


def rows_in(folders: tuple[str, ...], spark: SparkSession) -> int:
    """Rows of all tables in some segments."""
    return reduce(lambda a, b: a + b, [spark.read.schema(TABLES[name]).parquet(*[f"{f}/{name}" for f in folders]).count() for name in ("items", "postings", "lengths", "replaced")])
