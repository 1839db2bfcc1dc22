"""Summary statistics of entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.payload import json_keys
from tracewright.functions.text import span_text
from tracewright.profile import KnownNames
from tracewright.schema import COMMAND, EVENT, REQUEST


def distributions(entries: DataFrame) -> DataFrame:
    """dimension, value, count, percent of all entries, bar: components, levels, and events, commands, requests by name, in one pass."""
    dims = F.array(
        F.struct(F.lit("component").alias("dimension"), F.col("component").alias("value")),
        F.struct(F.lit("level").alias("dimension"), F.col("level").alias("value")),
        F.struct(F.when(F.col("kind").isin(EVENT, COMMAND, REQUEST), F.lower("kind")).alias("dimension"), F.col("name").alias("value")),
    )
    counts = entries.select(F.explode(dims).alias("d")).where("d.dimension is not null").groupBy("d.dimension", "d.value").agg(F.count("*").alias("count"))
    total = Window.partitionBy()  # over the few counted rows
    all_rows = F.sum(F.when(F.col("dimension") == "level", F.col("count"))).over(total)
    return counts.withColumn("percent", F.col("count") * 100.0 / all_rows).withColumn("bar", percent_bar(F.col("percent")))


def payload_sizes(entries: DataFrame) -> DataFrame:
    """UTF-8 bytes of payloads by kind and name: count, avg_bytes, min_bytes, max_bytes."""
    rows = entries.where(F.col("payload_json").isNotNull() & F.col("name").isNotNull()).select("kind", "name", F.octet_length("payload_json").cast("long").alias("n"))
    return rows.groupBy("kind", "name").agg(F.count("*").alias("count"), F.avg("n").alias("avg_bytes"), F.min("n").alias("min_bytes"), F.max("n").alias("max_bytes"))


def payload_keys(entries: DataFrame, top: int = 10) -> DataFrame:
    """Key paths of payloads by kind and name, the top ones: kind, name, path, count, total (entries of that name), place, more (paths of that name beyond the top)."""
    named = entries.where("name is not null")
    totals = named.groupBy("kind", "name").agg(F.count("*").alias("total"))
    counts = named.where("payload_json is not null").select("kind", "name", F.explode(json_keys("payload_json")).alias("path")).groupBy("kind", "name", "path").agg(F.count("*").alias("count"))
    place = F.row_number().over(Window.partitionBy("kind", "name").orderBy(F.desc("count"), "path"))
    more = F.greatest(F.count("*").over(Window.partitionBy("kind", "name")) - top, F.lit(0))
    return counts.withColumn("place", place).withColumn("more", more).where(F.col("place") <= top).join(totals, ["kind", "name"]).select("kind", "name", "path", "count", "total", "place", "more")


def time_range(entries: DataFrame) -> DataFrame:
    return entries.agg(F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"), F.count("*").alias("entries"))


def span(entries: DataFrame) -> DataFrame:
    """One row: the time from the first entry to the last in words; NULL without entries."""
    return time_range(entries).select(span_text(F.floor((F.unix_micros("last_timestamp") - F.unix_micros("first_timestamp")) / 1_000_000).cast("long")).alias("span"))


def _bucket_seconds(span: Column) -> Column:
    return F.when(span < 60, 5).when(span < 3600, 60).when(span < 86_400, 600).otherwise(3600)


def bar(count: Column, most: Column, width: int, least: int = 0) -> Column:
    """A bar as long as count's share of most; an empty one only if count is 0 and least too."""
    return F.repeat(F.lit("█"), F.greatest(F.floor(count * width / most), F.when(count > 0, 1).otherwise(least)).cast("int"))


def percent_bar(percent: Column) -> Column:
    return F.repeat(F.lit("█"), F.least(F.floor(percent + 0.5), F.lit(50)).cast("int"))


def _bounds(entries: DataFrame) -> DataFrame:
    """One row: first, last, step in seconds, n steps."""
    span = F.unix_micros("last") - F.unix_micros("first")
    seconds = F.floor(span / 1_000_000)
    bounds = entries.agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last")).where("first is not null")
    bounds = bounds.withColumn("step", _bucket_seconds(seconds)).withColumn("n", F.greatest(F.lit(1), F.floor(seconds / F.col("step"))).cast("long"))
    return F.broadcast(bounds)  # one row


def _bucket() -> Column:
    return F.least(F.floor((F.unix_micros("timestamp") - F.unix_micros("first")) / (F.col("step").cast("long") * 1_000_000)), F.col("n") - 1)


def _start() -> Column:
    return F.timestamp_micros(F.unix_micros("first") + F.col("bucket") * F.col("step").cast("long") * 1_000_000)


def timeline(entries: DataFrame) -> DataFrame:
    """bucket, start, count, bar: entries by steps of 5 s, 1 min, 10 min or 1 h from the first one on, empty steps included; the last one takes the rest."""
    bounds = _bounds(entries)
    counts = entries.select("timestamp").join(bounds).groupBy(_bucket().alias("bucket")).agg(F.count("*").alias("count"))
    steps = bounds.select("first", "step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("bucket"))
    rows = steps.join(counts, "bucket", "left").select("bucket", _start().alias("start"), F.coalesce("count", F.lit(0)).alias("count"))
    most = rows.agg(F.max("count").alias("most"))
    return rows.join(F.broadcast(most)).withColumn("bar", bar(F.col("count"), F.col("most"), 40, 1)).drop("most")  # one row


def component_timeline(entries: DataFrame, top: int = 5) -> DataFrame:
    """component, total, bucket, start, count, bar of the components with the most entries: about five buckets of timeline() each, those without entries left out."""
    bounds = _bounds(entries)
    counts = entries.select("component", "timestamp").join(bounds).groupBy("component", _bucket().alias("bucket"), "first", "step", "n").agg(F.count("*").alias("count"))
    sums = counts.groupBy("component").agg(F.sum("count").alias("total"), F.max("count").alias("most")).orderBy(F.desc("total"), "component").limit(top)
    step = F.greatest(F.floor(F.col("n") / F.least(F.col("n"), F.lit(5))), F.lit(1))
    rows = counts.where(F.col("bucket") % step == 0).join(F.broadcast(sums), "component")
    return rows.select("component", "total", "bucket", _start().alias("start"), "count", bar(F.col("count"), F.col("most"), 20).alias("bar"))


def samples(entries: DataFrame, n: int = 3) -> DataFrame:
    """The first n entries of each component."""
    w = Window.partitionBy("component").orderBy("timestamp", "file_idx", "source_line_number")
    return entries.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def unknown_names(entries: DataFrame, known: KnownNames) -> DataFrame:
    """what, value: components, commands and requests that the profile doesn't know; a list that is empty asks nothing."""
    parts = []
    for what, column, kind, names in (("component", "component", None, known.known_components), ("command", "name", COMMAND, known.known_commands), ("request", "name", REQUEST, known.known_requests)):
        if names:
            rows = entries if kind is None else entries.where(F.col("kind") == kind)
            parts.append(rows.where(~F.lower(column).isin([n.lower() for n in names])).select(F.lit(what).alias("what"), F.col(column).alias("value")).distinct())
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out if out is not None else entries.limit(0).select(F.lit("").alias("what"), F.col("component").alias("value"))
