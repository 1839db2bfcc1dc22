"""Session lifecycles: component paths as a tree of sessions that commands create and complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.payload import value_at
from tracewright.functions.text import strip_instance
from tracewright.profile import SessionLevel
from tracewright.schema import COMMAND, barrier, order_key


def level_of(segment: Column, levels: tuple[SessionLevel, ...]) -> Column:
    """Index of the level with the longest prefix that the segment begins with, the first of equals; NULL if none."""
    out = F.lit(None).cast("int")
    for i, level in sorted(enumerate(levels), key=lambda x: (len(x[1].segment_prefix), -x[0])):
        out = F.when(F.startswith(segment, F.lit(level.segment_prefix)), F.lit(i)).otherwise(out)
    return out


def _segments(entries: DataFrame, levels: tuple[SessionLevel, ...]) -> DataFrame:
    """A row for each path segment of each entry: level, the matched segment before it, whether a deeper one matches, whether the path has it for the first time."""
    path = F.filter(F.split("component_id", "/"), lambda s: s != "")
    rows = entries.where("component_id <> ''").select(order_key().alias("at"), "timestamp", "kind", "name", "payload_json", path.alias("path"))
    matched = F.transform("path", lambda s: F.struct(s.alias("segment"), level_of(s, levels).alias("level")))
    rows = rows.withColumn("path", matched)
    rows = rows.select("*", F.posexplode("path").alias("position", "s"))
    above = F.filter(F.slice("path", F.lit(1), F.col("position")), lambda s: s["level"].isNotNull())
    return rows.select(
        "at", "timestamp", "kind", "name", "payload_json", "s.segment", "s.level", (F.array_position(F.transform("path", lambda s: s["segment"]), F.col("s.segment")) == F.col("position") + 1).alias("fresh"),
        F.when(F.size(above) > 0, F.element_at(above, -1)).alias("above"),
        (F.size(F.filter(F.slice("path", F.col("position") + 2, F.size("path")), lambda s: s["level"].isNotNull())) == 0).alias("deepest"),
    )


def sessions(entries: DataFrame, levels: tuple[SessionLevel, ...]) -> DataFrame:
    """One row a session: level, session_id, first_seen, last_seen, entry_count, parent, created_via, completed_via, summary (path to JSON text).

    The parent and the creating and completing commands are those of the last
    entry that names one. A command creates the deepest session on its path
    only, and completes any.
    """
    if not levels:
        return entries.limit(0).select(F.lit("").alias("level"), F.col("component_id").alias("session_id"))
    rows = _segments(entries, levels).where("level is not null")
    each = lambda f: F.element_at(F.array(*map(f, levels)), F.col("level") + 1)
    creates = (F.col("kind") == COMMAND) & F.col("deepest") & (F.col("name") == each(lambda x: F.lit(x.create_command)))
    completes = (F.col("kind") == COMMAND) & F.array_contains(each(lambda x: F.array(*[F.lit(c) for c in x.complete_commands]).cast("array<string>")), F.col("name"))
    last = lambda value, when: F.max_by(value, F.when(when, F.col("at")))
    paths = sorted({p for x in levels for p in x.summary_fields})
    out = rows.groupBy(F.col("level").alias("at_level"), F.col("segment").alias("session_id")).agg(
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.count_if("fresh").alias("entry_count"),
        last(F.col("above.segment"), F.col("above").isNotNull()).alias("parent"),
        last(F.col("name"), creates).alias("created_via"), last(F.col("name"), completes).alias("completed_via"), last(F.col("payload_json"), creates).alias("payload"),
    )
    if paths:  # of the one entry that counts
        out = barrier(out.select("*", *[value_at(p, F.col("payload")).alias(f"f{i}") for i, p in enumerate(paths)]))
    pairs = [F.struct(F.lit(p).alias("key"), F.col(f"f{i}").alias("value")) for i, p in enumerate(paths)]
    wanted = F.element_at(F.array(*[F.array(*[F.lit(p) for p in x.summary_fields]).cast("array<string>") for x in levels]), F.col("at_level") + 1)
    summary = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull() & F.array_contains(wanted, p["key"]))) if pairs else F.create_map().cast("map<string,string>")
    name = F.element_at(F.array(*[F.lit(x.name) for x in levels]), F.col("at_level") + 1)
    return out.select(name.alias("level"), "session_id", "first_seen", "last_seen", "entry_count", "parent", "created_via", "completed_via", summary.alias("summary"))


def session_tree(entries: DataFrame, levels: tuple[SessionLevel, ...]) -> DataFrame:
    """parent, child: which sessions stand right below which, each once."""
    rows = _segments(entries, levels).where("level is not null and above is not null")
    return rows.select(F.col("above.segment").alias("parent"), F.col("segment").alias("child")).distinct()


def session_operations(entries: DataFrame, levels: tuple[SessionLevel, ...]) -> DataFrame:
    """session_id, operation, count: unmatched segments below a session, without their instance suffix."""
    rows = _segments(entries, levels).where("level is null and above is not null")
    return rows.groupBy(F.col("above.segment").alias("session_id"), strip_instance(F.col("segment")).alias("operation")).agg(F.count("*").alias("count"))


def completion(table: DataFrame) -> DataFrame:
    """level, sessions, completed, incomplete."""
    return table.groupBy("level").agg(F.count("*").alias("sessions"), F.count("completed_via").alias("completed"), (F.count("*") - F.count("completed_via")).alias("incomplete"))


def common_fields(table: DataFrame) -> DataFrame:
    """level, field, value: summary fields that all sessions of a level have, with one and the same value."""
    counts = table.groupBy("level").agg(F.count("*").alias("sessions"))
    values = table.select("level", F.explode("summary").alias("field", "value")).groupBy("level", "field").agg(F.count("*").alias("n"), F.min("value").alias("value"), F.max("value").alias("high"))
    return values.join(counts, "level").where("n = sessions and value = high").select("level", "field", "value")
