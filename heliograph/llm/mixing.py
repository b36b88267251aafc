"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time (a piecewise linear
intensity).  Its integral is the source's cumulative token demand; inverting it
at a document's cumulative tokens gives the document's training position, and
documents are range-sorted by position.

Targets share the sum of all sizes by weight; no target is above MOST_PASSES
times its source's size, and what is cut there is shared again by weight among
the others (found in one pass over the sources, ordered by limit / weight).  A
source whose target is q whole passes and a fraction takes every document q
times and, in a fixed pseudo-random order, once more up to the fraction, so its
taken words miss the target by half a document at most.

Orders inside a source are prefix sums in two levels (hash bucket, then
document), so a source with a third of all rows is spread over many tasks.

Defined cases: a null or empty text has size 0 and takes nothing; a null source
is a source of its own, last in order; ties in the order are broken by id and
size, and rows alike in both are interchangeable; no rows give no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import row_key, shuffle_parts, spread_join, stored, unused
from .quality_rules import WORD

MOST_PASSES = 3
#: longest array that one row is exploded into at once
SPAN = 100_000
#: sources that one task may order
FEW_SOURCES = 100_000
WEIGHTS = (1, 2, 3)
#: a schedule per weight, as (time, intensity) knots of integral 1: light sources fade, heavy ones grow
SCHEDULES = (((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
SEED = "mix"


def word_count(text: Column) -> Column:
    """Number of words of a text (null: 0): one mark a word, counted."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), WORD + "+", "\x01")
    return (F.length(marks) - F.length(F.translate(marks, "\x01", ""))).cast("long")


def time_of(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time at which a schedule has asked for the given share of its demand."""
    areas = [(t1 - t0) * (f0 + f1) / 2 for (t0, f0), (t1, f1) in zip(knots, knots[1:], strict=False)]
    whole, done, out = sum(areas), 0.0, None
    for k, ((t0, f0), (t1, f1)) in enumerate(zip(knots, knots[1:], strict=False)):
        due = share * F.lit(whole) - F.lit(done)
        slope = (f1 - f0) / (t1 - t0)
        step = due / F.lit(f0) if slope == 0 else (F.sqrt(F.greatest(F.lit(f0 * f0) + F.lit(2 * slope) * due, F.lit(0.0))) - F.lit(f0)) / F.lit(slope)
        here = F.lit(t0) + step
        done += areas[k]
        out = F.when(share * F.lit(whole) <= done, here) if out is None else out.when(share * F.lit(whole) <= done, here)
    return out.otherwise(F.lit(knots[-1][0]))


def running(rows: DataFrame, order: list[Column], sums: dict[str, str], few: bool = False) -> DataFrame:
    """rows with the sums of some columns over all rows before each, under the given names, and over all rows (``all_`` and the name).

    Rows are dealt into ranges of the order; what the ranges before hold is one row a range, and the rest a sum inside a range.
    few: there are so few rows that one task may hold them; the sums are the same.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if few:
        before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(name) for name, c in sums.items()], *[F.sum(c).over(everything).alias(f"all_{name}") for name, c in sums.items()])
    dealt = stored(rows.repartitionByRange(shuffle_parts(rows.sparkSession), *order).withColumn("_range", F.spark_partition_id()), "ranges")
    held = dealt.groupBy("_range").agg(*[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    # one row a range
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(F.col("_range").alias("_r"), *[F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}") for name in sums], *[F.sum(f"_{name}").over(everything).alias(f"all_{name}") for name in sums])
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"_in_{name}") for name, c in sums.items()])
    out = out.join(F.broadcast(offsets), F.col("_range") == F.col("_r"))
    return out.select(*rows.columns, *[(F.col(f"_{name}") + F.col(f"_in_{name}")).alias(name) for name in sums], *[f"all_{name}" for name in sums])


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES, few: bool = False) -> DataFrame:
    """source, source_size -> source, source_size, class, weight, target.

    There may be as many sources as hosts: they are in one task only where few says that they have been counted and fit.
    """
    by_name = F.col("source").asc_nulls_last()
    ranked = running(sources.withColumn("one", F.lit(1).cast("long")), [by_name], {"rank": "one"}, few)
    ranked = ranked.select("source", "source_size", F.pmod(F.col("rank"), F.lit(len(weights))).cast("int").alias("class"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("class") + 1).cast("long")
    ranked = ranked.withColumn("weight", weight).withColumn("limit", F.col("source_size") * most).withColumn("ratio", F.col("limit") / F.col("weight"))
    filled = running(ranked, [F.col("ratio"), by_name], {"limit_before": "limit", "weight_before": "weight", "size_before": "source_size"}, few)
    # a source is at its limit if what is left for it and those after it, shared by weight, would fill it: that holds for the first sources in order, up to one
    exact = lambda x, digits: x.cast(f"decimal({digits},0)")
    words, weight_left = F.col("all_size_before"), F.col("all_weight_before") - F.col("weight_before")
    filled = filled.withColumn("capped", exact(F.col("limit"), 20) * exact(weight_left, 17) < exact(words - F.col("limit_before"), 20) * exact(F.col("weight"), 17))
    zero = F.lit(0).cast("long")
    rest = filled.agg(F.sum(F.when(F.col("capped"), F.col("limit")).otherwise(zero)).alias("given"), F.sum(F.when(F.col("capped"), zero).otherwise(F.col("weight"))).alias("open_weight"))
    share = (words - F.col("given")) * F.col("weight") / F.col("open_weight")
    target = F.when(F.col("capped"), F.col("limit").cast("double")).otherwise(share)
    # one row of numbers
    return filled.join(F.broadcast(rest), F.lit(True)).select("source", "source_size", "class", "weight", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, schedules=SCHEDULES, most: int = MOST_PASSES, seed: str = SEED, keys: dict[str, Column] | None = None) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, position (of its first pass) and positions (of all).

    ``keys`` names further columns to carry, by expression.
    """
    keys = keys or {}
    # rows without an id are told apart by their text
    shuffled = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), F.coalesce(F.col("text"), F.lit(""))))).cast("binary"))
    rows = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), shuffled.alias("order"), *[c.alias(k) for k, c in keys.items()]), "mix-sizes")
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    n, n_sources = by_source.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).head()
    digits = 3 + max(0, (max(n, 1) // 200_000_000).bit_length() + 3) // 4
    rows = rows.withColumn("bucket", F.substring("order", 1, digits))
    blocks = rows.groupBy("source", "bucket").agg(F.sum("size").alias("held"))
    blocks = blocks.select("source", "bucket", (F.sum("held").over(Window.partitionBy("source").orderBy("bucket")) - F.col("held")).alias("offset"))
    plan = targets(by_source.drop("n"), weights, most, n_sources <= FEW_SOURCES)
    starts = blocks.withColumnRenamed("source", "_s").join(plan, F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
    # rows alike are one row with their number until each has its place, so no bucket depends on how often one repeats
    alike = rows.groupBy("source", "bucket", "order", "doc_id", "size", *keys).agg(F.count(F.lit(1)).alias("copies"))
    words = F.col("size") * F.col("copies")
    placed = alike.withColumn("before", F.sum(words).over(Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "size", *keys)) - words)
    placed = placed.withColumnsRenamed({"source": "_s", "bucket": "_b"}).join(starts, F.col("_s").eqNullSafe(F.col("source")) & (F.col("_b") == F.col("bucket")))
    placed = placed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / F.lit(SPAN)))))
    placed = placed.withColumn("nth", F.explode(F.sequence(F.col("block") * SPAN, F.least(F.col("block") * SPAN + SPAN, F.col("copies")) - 1)))
    before = F.col("offset") + F.col("before") + F.col("nth") * F.col("size")
    whole = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("long")
    part = F.col("target") - whole * F.col("source_size")
    passes = F.when(F.col("size") == 0, F.lit(0).cast("long")).otherwise(whole + (before + F.col("size") / F.lit(2.0) < part).cast("long"))
    timed = placed.withColumn("passes", passes).withColumn("before", before)

    def place(k: Column) -> Column:
        share = F.least((k * F.col("source_size") + F.col("before") + F.col("size") / F.lit(2.0)) / F.col("target"), F.lit(1.0))
        out = None
        for i, knots in enumerate(schedules):
            at = F.round(time_of(share, knots), 9)
            out = F.when(F.col("class") == i, at) if out is None else out.when(F.col("class") == i, at)
        return out

    return timed.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("passes") * F.col("size")).alias("taken"),
        F.when(F.col("passes") > 0, place(F.lit(0))).alias("position"),
        F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1), place)).otherwise(F.array().cast("array<double>")).alias("positions"),
        *keys,
    )


def sorted_by_position(rows: DataFrame, column: str = "position") -> DataFrame:
    """Range-sorted: partitions hold consecutive stretches of training."""
    return rows.repartitionByRange(F.col(column).asc_nulls_last(), F.col("doc_id")).sortWithinPartitions(F.col(column).asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs in training order, each as often as the mix takes it."""
    names = docs.columns
    tag, position = unused(docs, "_tag", "_position")
    key = row_key(F.col("doc_id"), F.col("text"), F.col("source"))
    plan = stored(mix(docs, keys={tag: key}).filter("taken > 0").select(tag, F.explode("positions").alias(position)), "mix-plan")
    # rows alike in id, text and source share their passes: one of them stands for all
    once = docs.withColumn(tag, key).dropDuplicates([tag])
    passes = plan.groupBy(tag).agg(F.count(F.lit(1)).alias("n"))
    rows = spread_join(plan, once, tag, passes, F.col(position))
    return sorted_by_position(rows, position).select(*names)
