"""The timeline of one id or session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import log_key, millis_between
from tracewright.operators.filters import LogFilter, trace_selector
from tracewright.operators.numbering import timeline_before


def trace(entries: DataFrame, identifier: str | None = None, session: str | None = None, wanted: LogFilter | None = None) -> DataFrame:
    """Selected entries with the milliseconds since the one before and since the first.

    The timeline is ordered in slices, so a selector may let most entries through.
    """
    rows = (wanted or LogFilter()).apply(entries).where(trace_selector(identifier, session))
    since = lambda start: F.coalesce(millis_between(F.col(start), F.col("timestamp")), F.lit(0))
    rows = timeline_before(rows).withColumn("delta_ms", since("previous")).withColumn("elapsed_ms", since("first"))
    return rows.drop("previous", "first").withColumn("log_key", log_key())


def trace_summary(traced: DataFrame) -> DataFrame:
    return traced.agg(F.count("*").alias("count"), F.coalesce(F.max("elapsed_ms"), F.lit(0)).alias("total_duration_ms"))
