"""Places in an order, worked out by many tasks: ranges are numbered each for itself, and add what stands before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.schema import TIMELINE

#: Places of a whole-number order in one range.
RANGE = 1 << 16
#: Ranges of a timeline.
SLICES = 256


def numbered(rows: DataFrame, by: tuple[str, ...], order: str, name: str, each: int = RANGE) -> DataFrame:
    """rows with their place (from 1) by a whole-number column inside each group, however large a group is.

    Group columns are not null; order has no ties inside a group.
    """
    rows = rows.withColumn("__range", F.floor(F.col(order) / each))
    own = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(order))
    sizes = rows.groupBy(*by, "__range").agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    sizes = sizes.withColumn("__before", F.coalesce(upto, F.lit(0))).drop("__n")
    return rows.withColumn(name, own).join(sizes, [*by, "__range"]).withColumn(name, F.col(name) + F.col("__before")).drop("__range", "__before")


def sliced(entries: DataFrame) -> DataFrame:
    """entries with __slice, their stretch of the timeline: about as many entries in each, those of one instant in one.

    The cuts are worked out here, once: they are approximate, and another time, as in another branch of a plan, they could be others.
    """
    at = F.unix_micros("timestamp")
    cuts = entries.agg(F.percentile_approx(at, [k / SLICES for k in range(1, SLICES)], 20 * SLICES).alias("cuts")).first()["cuts"]
    cuts = F.lit(sorted(set(cuts or [])) or None).cast("array<bigint>")  # none of an empty table
    return entries.withColumn("__slice", F.size(F.filter(F.coalesce(cuts, F.array().cast("array<bigint>")), lambda c: c < at)))


def _earlier(value: str, fold) -> Column:
    """What fold makes of a value of the slices before a row's own."""
    return fold(F.transform(F.filter("__carried", lambda c: c["__slice"] < F.col("__slice")), lambda c: c[value]))


def timeline_places(entries: DataFrame, name: str = "place") -> DataFrame:
    """entries with their place (from 1) on the merged timeline."""
    rows = sliced(entries)
    carried = rows.groupBy("__slice").agg(F.count("*").alias("n")).agg(F.collect_list(F.struct("__slice", "n")).alias("__carried"))  # an item a slice
    own = F.row_number().over(Window.partitionBy("__slice").orderBy(*TIMELINE))
    before = _earlier("n", lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b))
    return rows.withColumn(name, own).join(F.broadcast(carried)).withColumn(name, F.col(name) + before).drop("__slice", "__carried")


def timeline_before(entries: DataFrame) -> DataFrame:
    """entries with previous and first: the time of the entry before each on the merged timeline (NULL for the first), and of the first one."""
    rows = sliced(entries)
    spans = rows.groupBy("__slice").agg(F.max("timestamp").alias("last"), F.min("timestamp").alias("low"))
    carried = spans.agg(F.collect_list(F.struct("__slice", "last")).alias("__carried"), F.min("low").alias("first"))
    own = F.lag("timestamp").over(Window.partitionBy("__slice").orderBy(*TIMELINE))
    rows = rows.withColumn("previous", own).join(F.broadcast(carried))
    return rows.withColumn("previous", F.coalesce("previous", _earlier("last", F.array_max))).drop("__slice", "__carried")
