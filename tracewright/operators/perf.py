"""Operation timing: start and end entries of one key are paired, the last start wins.

No join: among the starts and ends of a key in time order, an operation is an
end right after a start, and an orphan is a start that nothing follows. So one
shuffle on (kind, key) serves both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.text import contains_any, millis_between, request_id_in
from tracewright.profile import PerfRules
from tracewright.schema import COMMAND, EVENT, REQUEST, TIMELINE, barrier

PERCENTILES = (50, 95, 99)


def event_key(rules: PerfRules, payload: Column | None = None) -> Column:
    """The first configured payload key whose value is a string. payload: the parsed payload, if there is one already."""
    payload = F.try_parse_json("payload_json") if payload is None else payload
    found = []
    for k in rules.event_correlation_keys:
        path = "$['" + k.replace("'", "\\'") + "']"
        value = F.try_variant_get(payload, path, "variant")
        found.append(F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(payload, path, "string")))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def tracks_commands(entries: DataFrame, rules: PerfRules) -> bool:
    """Whether any command's message has a completion marker; without one commands aren't paired."""
    if not any(rules.command_completion_markers):
        return False
    return not entries.where((F.col("kind") == COMMAND) & contains_any(F.col("message"), rules.command_completion_markers)).isEmpty()


def steps(entries: DataFrame, rules: PerfRules | None = None, op_type: str | None = None, commands: bool = False) -> DataFrame:
    """Starts and ends with their key, and what stands before and after each under that key."""
    rules = rules or PerfRules()
    kind, way = F.col("kind"), F.col("direction")
    starting = contains_any(F.col("message"), rules.command_start_markers)
    ending = contains_any(F.col("message"), rules.command_completion_markers)
    begins = ((kind == REQUEST) & (way == "Send")) | ((kind == EVENT) & (way == "Receive"))
    ends = ((kind == REQUEST) & (way == "Receive")) | ((kind == EVENT) & (way == "Emit"))
    key = F.when(kind == REQUEST, F.coalesce("request_id", request_id_in(F.col("message")))).when(kind == EVENT, event_key(rules, F.col("payload")))
    if commands:
        begins, ends = begins | ((kind == COMMAND) & starting), ends | ((kind == COMMAND) & ending & ~starting)
        key = key.when(kind == COMMAND, F.concat_ws(":", F.col("name"), F.col("component_id")))
    rows = entries.where(begins | ends)
    if op_type:
        rows = rows.where(kind == op_type)
    status = F.when(kind == REQUEST, F.try_variant_get("payload", "$.statusCode", "long"))
    used = ("kind", "direction", "name", "request_id", *TIMELINE, "component", "component_id", "endpoint", "message")
    rows = barrier(rows.select(*used, F.try_parse_json("payload_json").alias("payload")))  # parsed once
    rows = barrier(rows.select(
        F.col("kind").alias("op_type"), "name", key.alias("correlation_id"), F.coalesce(begins, F.lit(False)).alias("starts"),
        *TIMELINE, "component", "component_id", "endpoint", status.alias("status"), "message",
    )).where("correlation_id is not null")
    w = Window.partitionBy("op_type", "correlation_id").orderBy(*TIMELINE)
    return (
        rows.withColumn("before", F.lag(F.struct("starts", F.col("timestamp").alias("at"), "component")).over(w))
        .withColumn("last", F.lead(F.lit(1)).over(w).isNull())
    )


def operations(paired: DataFrame) -> DataFrame:
    """Completed operations; name, endpoint, status and end component are the end's."""
    done = paired.where(~F.col("starts") & F.col("before.starts"))
    return done.select(
        "op_type", "name", "correlation_id", F.col("before.at").alias("start_time"), F.col("timestamp").alias("end_time"),
        millis_between(F.col("before.at"), F.col("timestamp")).alias("duration_ms"),
        F.col("before.component").alias("start_component"), F.col("component").alias("end_component"), "endpoint", "status",
    )


def orphans(paired: DataFrame) -> DataFrame:
    """Starts that nothing ended and no later start replaced."""
    return paired.where(F.col("starts") & F.col("last")).select("op_type", "name", "correlation_id", F.col("timestamp").alias("start_time"), "component", F.nullif("component_id", F.lit("")).alias("component_id"), F.col("message").alias("context"))


def stats(ops: DataFrame) -> DataFrame:
    """Count, mean, least, most and percentiles of durations by operation.

    Percentile p is the value at place floor(n * p / 100), counted from 0, of
    the sorted durations. Durations are first counted by value, so a hot
    operation is summed up before any ordering, and then ranked by running
    counts.
    """
    values = ops.groupBy("op_type", "name", "duration_ms").agg(F.count("*").alias("n"))
    group = Window.partitionBy("op_type", "name")
    upto = F.sum("n").over(group.orderBy("duration_ms").rowsBetween(Window.unboundedPreceding, 0))
    ranked = values.withColumn("upto", upto).withColumn("total", F.sum("n").over(group))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("total") * p / 100), F.col("duration_ms"))).alias(f"p{p}_duration_ms")
    return ranked.groupBy("op_type", "name").agg(
        F.sum("n").alias("count"), (F.sum(F.col("duration_ms") * F.col("n")) / F.sum("n")).alias("avg_duration_ms"),
        F.min("duration_ms").alias("min_duration_ms"), F.max("duration_ms").alias("max_duration_ms"), *map(at, PERCENTILES),
    )


def slow(ops: DataFrame, threshold_ms: int = 1000) -> DataFrame:
    return ops.where(F.col("duration_ms") >= threshold_ms)


def slowest(ops: DataFrame, n: int = 20) -> DataFrame:
    return ops.orderBy(F.desc("duration_ms"), "end_time", "op_type", "correlation_id").limit(n)


STAT_ORDERS = {"duration": [F.desc, "avg_duration_ms"], "count": [F.desc, "count"], "name": [F.asc, "name"]}


def sorted_stats(table: DataFrame, by: str = "duration", n: int | None = None) -> DataFrame:
    direction, column = STAT_ORDERS[by]
    out = table.orderBy(direction(column), "op_type", "name")
    return out.limit(n) if n else out
