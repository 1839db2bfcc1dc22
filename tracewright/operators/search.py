"""Search, counts of matches, and field extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.payload import value_at
from tracewright.functions.text import log_key
from tracewright.operators.filters import LogFilter

NO_PAYLOAD = "<none>"


def matches(entries: DataFrame, wanted: LogFilter) -> DataFrame:
    return wanted.apply(entries)


def with_context(entries: DataFrame, wanted: LogFilter, context: int = 0) -> DataFrame:
    """Matches and the entries up to context places around them in file order, with is_match and new_chunk.

    entries must have seq without gaps. Places around matches are generated, with
    whether the place before each is shown too, and joined: no window runs over
    the file, or over what is shown of it.
    """
    hits = wanted.apply(entries).select("file_idx", "seq")
    offsets = F.explode(F.sequence(F.lit(-context), F.lit(context + 1))).alias("offset")
    marks = hits.select("file_idx", "seq", offsets).groupBy("file_idx", (F.col("seq") + F.col("offset")).alias("seq")).agg(
        F.max(F.col("offset") <= context).alias("near"), F.max(F.col("offset") > -context).alias("goes_on"), F.max(F.col("offset") == 0).alias("is_match")
    )
    firsts = F.broadcast(hits.groupBy("file_idx").agg(F.min("seq").alias("first")))  # a row a file
    shown = entries.join(marks.where("near"), ["file_idx", "seq"]).join(firsts, "file_idx")
    return shown.withColumn("new_chunk", ~F.col("goes_on") & (F.col("seq") > F.col("first"))).drop("near", "goes_on", "first")


_GROUPS = {
    "matches": lambda: F.lit("matches"),
    "component": lambda: F.col("component"),
    "level": lambda: F.col("level"),
    "type": log_key,
    "payload": lambda: F.coalesce("payload_json", F.lit(NO_PAYLOAD)),
}


def count_by(entries: DataFrame, wanted: LogFilter, by: str) -> DataFrame:
    """Matches by matches, component, level, type or payload: key, count; the most first, then by key."""
    return wanted.apply(entries).groupBy(_GROUPS[by]().alias("key")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "key")


def field_value(path: str) -> Column:
    """A field's value as JSON text: the structured field of that name, else the payload's value at that path."""
    own = F.try_element_at("structured_fields", F.lit(path))
    quoted = F.regexp_extract(F.to_json(F.struct(own.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return F.coalesce(F.when(own.isNotNull(), quoted), value_at(path, F.col("payload_json")))


def extract(entries: DataFrame, wanted: LogFilter, path: str) -> DataFrame:
    """Values of a field among matches: value, count; the most first, then by value."""
    return wanted.apply(entries).select(field_value(path).alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value")


def extract_summary(entries: DataFrame, wanted: LogFilter, path: str) -> DataFrame:
    """One row: matches, extracted, missing_payload (neither field nor payload), missing_field."""
    rows = wanted.apply(entries).select(field_value(path).alias("value"), F.col("payload_json").isNotNull().alias("has"))
    return rows.agg(
        F.count("*").alias("matches"), F.count("value").alias("extracted"),
        F.count_if(F.col("value").isNull() & ~F.col("has")).alias("missing_payload"), F.count_if(F.col("value").isNull() & F.col("has")).alias("missing_field"),
    )
