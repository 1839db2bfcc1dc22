"""Error clusters: errors of one severity and message pattern, with the sessions they hit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import message_pattern, millis_between, severity
from tracewright.operators import perf
from tracewright.operators.filters import error_levels
from tracewright.profile import PerfRules
from tracewright.schema import order_key


def session_states(entries: DataFrame, paired: DataFrame) -> DataFrame:
    """component_id, last_seen, orphaned (a start in it was never ended) of every session."""
    open_ones = perf.orphans(paired).where("component_id is not null").select("component_id").distinct().withColumn("open", F.lit(True))
    seen = entries.where("component_id <> ''").groupBy("component_id").agg(F.max("timestamp").alias("last_seen"))
    return seen.join(open_ones, "component_id", "left").select("component_id", "last_seen", F.coalesce("open", F.lit(False)).alias("orphaned"))


def impacts(entries: DataFrame, warn: bool = False, rules: PerfRules | None = None, commands: bool = False) -> DataFrame:
    """Errors by severity, pattern and session: the first of two aggregations, and the only one that reads messages."""
    errors = entries.where(error_levels(warn)).select(severity(F.col("level")).alias("severity"), message_pattern(F.col("message")).alias("pattern"), "component", "component_id", "timestamp", "message", order_key().alias("at"))
    by_session = errors.groupBy("severity", "pattern", "component_id").agg(
        F.count("*").alias("error_count"), F.collect_set("component").alias("components"), F.min("timestamp").alias("first_error"), F.max("timestamp").alias("last_error"), F.min(F.struct("at", "message")).alias("sample")
    )
    states = session_states(entries, perf.steps(entries, rules, commands=commands))
    blocked = F.when(F.col("last_seen").isNotNull(), F.greatest(F.lit(0), millis_between(F.col("first_error"), F.col("last_seen"))))
    return by_session.join(states, "component_id", "left").withColumn("blocking_ms", blocked).withColumn("outcome", F.when(F.col("component_id") != "", F.when(F.col("orphaned"), "orphaned").otherwise("completed")))


def clusters(by_session: DataFrame) -> DataFrame:
    """One row a severity and message pattern."""
    named = F.col("component_id") != ""
    return by_session.groupBy("severity", "pattern").agg(
        F.sum("error_count").alias("count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("components")))).alias("components"),  # few sets are different
        F.min("first_error").alias("first_timestamp"),
        F.max("last_error").alias("last_timestamp"),
        F.min("sample")["message"].alias("sample_message"),
        F.count_if(named).alias("affected_sessions_count"),
        F.max(F.when(named, F.col("blocking_ms"))).alias("blocking_ms"),
    )


def session_order() -> list:
    """How the affected sessions of a cluster are listed: the most errors first, orphaned ones before others, then by path."""
    return [F.desc("error_count"), F.asc("outcome_rank"), F.asc("session_path")]


def affected(by_session: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """A row for each session that a cluster hits, of the clusters (severity, pattern) in shown, a few rows, if given."""
    rows = by_session.where("component_id <> ''")
    if shown is not None:
        rows = rows.join(F.broadcast(shown.select("severity", "pattern")), ["severity", "pattern"], "left_semi")
    rank = F.when(F.col("outcome") == "orphaned", 0).otherwise(1).alias("outcome_rank")
    return rows.select("severity", "pattern", F.col("component_id").alias("session_path"), "error_count", "outcome", F.col("first_error").alias("first_error_timestamp"), F.col("last_error").alias("last_error_timestamp"), "blocking_ms", rank)


def sort_clusters(table: DataFrame, by: str = "count", top: int = 0) -> DataFrame:
    """By count, time or impact; top 0 keeps all."""
    count, sessions, last, pattern = F.desc("count"), F.desc("affected_sessions_count"), F.desc("last_timestamp"), F.asc("pattern")
    orders = {"count": [count, sessions, last, pattern], "time": [last, count, pattern], "impact": [sessions, F.desc(F.coalesce("blocking_ms", F.lit(0))), count, last, pattern]}
    out = table.orderBy(*orders[by], "severity")
    return out.limit(top) if top else out


def summary(by_session: DataFrame) -> DataFrame:
    """One row: totals, patterns, sessions, and the longest blocking with its pattern and session."""
    named = F.col("component_id") != ""
    longest = F.max(F.when(named & F.col("blocking_ms").isNotNull(), F.struct("blocking_ms", "severity", "pattern", "component_id")))
    return by_session.agg(
        F.coalesce(F.sum("error_count"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("severity") == "ERROR", F.col("error_count"))), F.lit(0)).alias("errors"),
        F.coalesce(F.sum(F.when(F.col("severity") == "WARN", F.col("error_count"))), F.lit(0)).alias("warnings"),
        F.count_distinct("severity", "pattern").alias("patterns"),
        F.count_distinct(F.when(named, F.col("component_id"))).alias("sessions"),
        longest.alias("longest"),
    ).select("total", "errors", "warnings", "patterns", "sessions", F.col("longest.blocking_ms").alias("longest_blocking_ms"), F.col("longest.severity").alias("longest_severity"), F.col("longest.pattern").alias("longest_pattern"), F.col("longest.component_id").alias("longest_session"))
