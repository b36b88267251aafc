"""Counts, order statistics and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import APPEARANCE_VERSION, CURRENT_MODELS, Catalog


def outdated(model: str = "model") -> Column:
    return F.col(model).isNull() | ~F.col(model).isin(*CURRENT_MODELS)


def _fresh() -> Column:
    """Whether a joined descriptor fits the item; null where there is none."""
    return (F.col("a_version") == APPEARANCE_VERSION) & F.col("a_has") & (F.col("a_modified") == F.col("modified")) & (F.col("a_bytes") == F.col("bytes"))


def _with_appearance(catalog: Catalog, dimensions: int) -> DataFrame:
    a = catalog.appearances.select(F.col("photo_id").alias("id"), F.col("version").alias("a_version"), F.col("modified").alias("a_modified"), F.col("bytes").alias("a_bytes"), (F.size("descriptor") == dimensions).alias("a_has"))
    return catalog.items.join(a, "id", "left")


def stats(catalog: Catalog, dimensions: int) -> DataFrame:
    """One row: images, bytes, outdated vectors, current descriptors, and descriptors to make."""
    number = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))  # noqa: E731  sum leaves nulls out
    rows = _with_appearance(catalog, dimensions)
    out = rows.agg(F.count(F.lit(1)).alias("images"), F.coalesce(F.sum("bytes"), F.lit(0).cast("long")).alias("bytes"), number(outdated()).alias("outdated"), number(_fresh()).alias("appearances"))
    return out.withColumn("missing_appearances", F.col("images") - F.col("appearances"))


def scan_entries(catalog: Catalog, dimensions: int) -> DataFrame:
    """What a scan needs of each item: id, path, fingerprint, and whether vector and descriptor are current."""
    vector = F.col("model").isin(*CURRENT_MODELS) & (F.size("embedding") == dimensions)
    rows = _with_appearance(catalog, dimensions)
    return rows.select("id", "path", "modified", "bytes", F.coalesce(vector, F.lit(False)).alias("embedding_current"), F.coalesce(_fresh(), F.lit(False)).alias("appearance_current"))


#: a group is hot with over 1 / HOT of all rows, and over LEAST_HOT; so there are under HOT hot groups, however large the input
HOT, LEAST_HOT = 4096, 1_000_000
#: quantiles that a pass estimates, and their accuracy: a place lies between the estimates one step to its left and two to its right
STEPS, ACCURACY = 1000, 20_000
#: so many values, or values that differ, are ordered in one task
FEW = 100_000


def ranked_values(rows: DataFrame, value: str, by: tuple[str, ...], picks: dict[str, Column]) -> DataFrame:
    """Order statistics by position: for each name the value at a 0-based place, a column over the group size ``n``.

    A hot group's values are never brought together: each pass over them estimates quantiles by sketches that are merged,
    and narrows the range that surely holds the place to some thousandth; exact counts of what lies below and within
    say where the place is in the range, until that is small enough to be ordered.
    """
    rows = rows.filter(F.col(value).isNotNull()).select(*by, value)
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    total, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).head()
    limit = max(total // HOT, LEAST_HOT)
    if most <= limit:
        return _ordered(rows, value, by, picks)
    hot = sizes.filter(F.col("n") > limit).select(F.monotonically_increasing_id().alias("_g"), *by, "n", *[place.cast("long").alias(f"_at_{name}") for name, place in picks.items()])
    found = hot.collect()  # under HOT rows
    kind = rows.schema[value].dataType
    keys = [rows.schema[c] for c in by]
    groups = rows.sparkSession.createDataFrame([(k, *[r[c] for c in by], r["n"]) for k, r in enumerate(found)], T.StructType([T.StructField("_g", T.LongType()), *keys, T.StructField("n", T.LongType())]))
    chosen = _selected(rows, value, by, [(k, name, tuple(r[c] for c in by), r[f"_at_{name}"]) for k, r in enumerate(found) for name in picks], keys, kind)
    wide = chosen.groupBy("_g").agg(*[F.min(F.when(F.col("_p") == name, F.col(value))).alias(name) for name in picks])
    same = _all_equal(by)
    names = [*by, "n", *picks]
    cold = rows.alias("l").join(F.broadcast(groups.select(*by)).alias("r"), same, "left_anti") if by else rows.limit(0)
    return groups.join(wide, "_g").select(names).unionByName(_ordered(cold, value, by, picks).select(names))


def _all_equal(by: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for c in by:
        out = out & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return out


def _ordered(rows: DataFrame, value: str, by: tuple[str, ...], picks: dict[str, Column]) -> DataFrame:
    """The same for groups that a task can order.  Values are counted first, so a group is as large as its distinct values."""
    counted = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_m"))
    order = Window.partitionBy(*by).orderBy(value)
    placed = counted.withColumn("_end", F.sum("_m").over(order)).withColumn("n", F.sum("_m").over(Window.partitionBy(*by)))
    chosen = [F.min(F.when(F.col("_end") > place, F.col(value))).alias(name) for name, place in picks.items()]
    return placed.groupBy(*by).agg(F.first("n").alias("n"), *chosen)


def _selected(rows: DataFrame, value: str, by: tuple[str, ...], wanted: list[tuple], keys: list[T.StructField], kind: T.DataType) -> DataFrame:
    """_g, _p and the value, for wanted (_g, _p, key, place); the driver holds a range for each, of which there are few."""
    schema = T.StructType([T.StructField("_g", T.LongType()), T.StructField("_p", T.StringType()), *keys, *[T.StructField(c, kind) for c in ("_lo", "_hi")]])
    grid = [k / STEPS for k in range(STEPS + 1)]

    def within(ranges: dict[tuple, tuple]) -> DataFrame:
        """The rows of each range and below it, _in where they are inside."""
        frame = rows.sparkSession.createDataFrame([(g, p, *key, *ranges[g, p]) for g, p, key, _ in wanted if (g, p) in ranges], schema)
        joined = rows.alias("l").join(F.broadcast(frame).alias("r"), _all_equal(by) & (F.col("_hi").isNull() | (F.col(f"l.{value}") <= F.col("_hi"))))
        return joined.select("_g", "_p", F.col(f"l.{value}").alias(value), (F.col("_lo").isNull() | (F.col(f"l.{value}") >= F.col("_lo"))).alias("_in"))

    places = {(g, p): place for g, p, _, place in wanted}
    ranges, done, below = {k: (None, None) for k in places}, {}, {}
    while ranges:
        inside = F.when(F.col("_in"), F.col(value))
        seen = within(ranges).groupBy("_g", "_p").agg(F.count(F.when(~F.col("_in"), 1)).alias("below"), F.count(inside).alias("n"), F.percentile_approx(inside, grid, ACCURACY).alias("q"), F.approx_count_distinct(inside).alias("d")).collect()
        narrower = {}
        for r in seen:
            k, (lo, hi) = (r["_g"], r["_p"]), ranges[r["_g"], r["_p"]]
            step = int((places[k] - r["below"]) / r["n"] * STEPS) if r["n"] else 0
            new = (r["q"][step - 1] if step >= 1 else lo, r["q"][step + 2] if step + 2 <= STEPS else hi)
            if r["n"] <= FEW or r["d"] <= FEW // 2 or new == (lo, hi):
                done[k], below[k] = (lo, hi), r["below"]
            else:
                narrower[k] = new
        ranges = narrower
    counted = within(done).filter("_in").groupBy("_g", "_p", value).agg(F.count(F.lit(1)).alias("_m"))
    rest = rows.sparkSession.createDataFrame([(g, p, place - below[g, p]) for (g, p), place in places.items()], "_g long, _p string, _rest long")
    ended = counted.withColumn("_end", F.sum("_m").over(Window.partitionBy("_g", "_p").orderBy(value))).join(F.broadcast(rest), ["_g", "_p"])
    return ended.filter(F.col("_end") > F.col("_rest")).groupBy("_g", "_p").agg(F.min(value).alias(value))


def p50() -> Column:
    """sorted[n / 2], not interpolated."""
    return F.floor(F.col("n") / 2)


def p95() -> Column:
    """sorted[floor(0.95 * n)]."""
    return F.floor(F.col("n") * 0.95)


def p95_of_last() -> Column:
    """sorted[(n - 1) * 95 / 100]."""
    return F.floor((F.col("n") - 1) * 95 / 100)


def medians(rows: DataFrame, by: tuple[str, ...], value: str) -> DataFrame:
    """The mean of the middle two, by group."""
    return rows.groupBy(*by).agg(F.median(value).alias("median"))


def stage_timings(rows: DataFrame, stage: str, microseconds: str) -> DataFrame:
    """Milliseconds by stage."""
    return rows.groupBy(stage).agg(F.sum(F.col(microseconds) / 1000).alias("ms"), F.count(F.lit(1)).alias("n"))


#: a node of a digest's tree covers 2 ** BITS nodes below it, so LEVELS levels cover all keys
BITS, LEVELS = 16, 4


def result_digest(rows: DataFrame, key: str, values: list[str], groups: Column) -> DataFrame:
    """n and a SHA-256 over the rows in the order of an integer key, by group, as a tree.

    A row's own digest is that of its values, each preceded by its length.  A leaf is the digest over a range of
    2 ** BITS keys: the rows' digests in order, equal rows as one with their number.  The nodes above cover as many
    nodes each, up to one for a group; ranges without rows are left out.  So no task holds more than a node's children,
    and the tree depends on keys and values alone.
    """
    text = [F.coalesce(F.col(v).cast("string"), F.lit("")) for v in values]
    own = F.sha2(F.concat(*[x for t in text for x in (F.octet_length(t).cast("string"), F.lit(":"), t)]).cast("binary"), 256)
    each = rows.select(groups.alias("part"), F.col(key).cast("long").alias("k"), own.alias("h")).groupBy("part", "k", "h").agg(F.count(F.lit(1)).alias("n"))
    level = each.withColumn("h", F.concat("h", F.lit(":"), F.col("n").cast("string")))
    for depth in range(LEVELS + 1):
        above = F.shiftright("k", BITS) if depth < LEVELS else F.lit(0).cast("long")  # keys below zero come to -1
        entries = F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"])
        level = level.groupBy("part", above.alias("up")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(entries, "").cast("binary"), 256).alias("h")).withColumnRenamed("up", "k")
    return level.select("part", "n", F.col("h").alias("digest"))


def same_set(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two single-column frames hold the same values, and as many rows."""
    column = a.columns[0]
    both = a.select(F.col(column).alias("v"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(b.select(F.col(b.columns[0]).alias("v"), F.lit(0).alias("l"), F.lit(1).alias("r")))
    by_value = both.groupBy("v").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    only = lambda x, y: F.coalesce(F.sum(((F.col(x) > 0) & (F.col(y) == 0)).cast("long")), F.lit(0).cast("long"))
    return by_value.agg(only("l", "r").alias("only_left"), only("r", "l").alias("only_right"), (F.coalesce(F.sum("l"), F.lit(0)) == F.coalesce(F.sum("r"), F.lit(0))).alias("same_rows")).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0) & F.col("same_rows"))
