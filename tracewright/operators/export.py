"""Compact, redacted export of entries for language models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.payload import compact_json, redact_json
from tracewright.functions.text import component_label, iso_millis, truncated, type_label


def redacted(entries: DataFrame) -> DataFrame:
    """Entries with redacted payloads."""
    return entries.withColumn("payload_json", redact_json("payload_json"))


def limited(entries: DataFrame, limit: int = 100) -> DataFrame:
    """The first entries in file order, 0: all."""
    return entries.orderBy("file_idx", "seq").limit(limit) if limit else entries


def export(entries: DataFrame, limit: int = 100, sanitize: bool = True) -> DataFrame:
    """idx (from 1), ts, comp, lvl, typ, msg, data."""
    rows = limited(entries, limit)
    data = redact_json("payload_json") if sanitize else F.col("payload_json")
    idx = F.row_number().over(Window.orderBy("file_idx", "seq")) if limit else F.col("seq") + 1
    return rows.select(
        idx.cast("long").alias("idx"), iso_millis(F.col("timestamp")).alias("ts"), component_label().alias("comp"), F.col("level").alias("lvl"),
        type_label(short=True).alias("typ"), truncated(F.col("message"), 200).alias("msg"), compact_json(data).alias("data"),
    )


def metadata(entries: DataFrame, limit: int = 100) -> DataFrame:
    """One row over the limited entries: entries, components, levels, first and last time in file order."""
    at = F.struct("file_idx", "seq")
    return limited(entries, limit).agg(
        F.count("*").alias("entries"), F.array_join(F.array_sort(F.collect_set("component")), ",").alias("components"), F.array_join(F.array_sort(F.collect_set("level")), ",").alias("levels"),
        iso_millis(F.min_by("timestamp", at)).alias("start"), iso_millis(F.max_by("timestamp", at)).alias("end"),
    )


def type_counts(entries: DataFrame, limit: int = 100) -> DataFrame:
    return limited(entries, limit).groupBy(type_label().alias("type")).agg(F.count("*").alias("count"))
