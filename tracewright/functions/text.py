"""Scalar functions over entries, all of them Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.schema import COMMAND, EVENT, GENERIC, REQUEST

# What a message pattern leaves out, in the order in which it goes.
_ID_WORDS = r"(?i)\b(id|request_id|session_id|render_id|job_id|test_id|check_id)\b\s*[:=]?\s*"
MESSAGE_PATTERNS = (
    (r"https?://[^\s\"')]+", "..."),
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "..."),
    (r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b", "..."),
    (r"\b\d{2}:\d{2}:\d{2}(?:\.\d+)?\b", "..."),
    (r"\[[^\]\s]*--[^\]\s]+\]", "[...]"),
    (_ID_WORDS + '"[^"]+"', '$1 "..."'),
    (_ID_WORDS + "'[^']+'", "$1 '...'"),
    (_ID_WORDS + "[A-Za-z0-9_.:-]{6,}", "$1 ..."),
    (r"(?i)\b[0-9a-f]{12,}\b", "..."),
    (r"\b\d{6,}\b", "..."),
    (r"\s+", " "),
)


def message_pattern(message: Column) -> Column:
    """The message without what differs from one occurrence to the next."""
    step = lambda col, rule: F.regexp_replace(col, F.lit(rule[0]), F.lit(rule[1]))
    return F.trim(reduce(step, MESSAGE_PATTERNS, F.replace(message, F.lit("\n"), F.lit(" "))))


def normalize_level(level: Column) -> Column:
    return F.upper(F.trim(level))


def infer_level(text: Column) -> Column:
    """The level word that the text begins with, else INFO."""
    word = F.regexp_extract(text, r"^(?i)(trace|debug|info|warn|warning|error|fatal)\b", 1)
    return F.when(word != "", F.upper(word)).otherwise("INFO")


def severity(level: Column) -> Column:
    return F.when(F.startswith(F.upper(level), F.lit("WARN")), "WARN").otherwise("ERROR")


def level_rank(level: Column) -> Column:
    return F.when(level == "ERROR", 5).when(level.isin("WARN", "WARNING"), 4).when(level == "INFO", 3).when(level == "DEBUG", 2).when(level == "TRACE", 1).otherwise(0)


def log_key() -> Column:
    """Kind, direction and name of an entry; a generic one has its message instead."""
    named = F.concat(F.col("kind"), F.lit(" | "), F.when(F.col("kind") != COMMAND, F.concat(F.col("direction"), F.lit(" "))).otherwise(""), F.lit("`"), F.col("name"), F.lit("`:"))
    return F.when(F.col("kind") == GENERIC, F.concat(F.lit("Generic | "), F.col("message"), F.lit(":"))).otherwise(named)


def compare_key() -> Column:
    return F.concat_ws("|", F.col("component"), F.col("level"), log_key())


def flow() -> Column:
    """Outgoing or Incoming; NULL for generic entries."""
    return F.when(F.col("kind") == COMMAND, "Outgoing").when(F.col("direction").isin("Emit", "Send"), "Outgoing").when(F.col("direction") == "Receive", "Incoming")


def contains_any(text: Column, markers) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in markers if m], F.lit(False))


def contains_ci(text: Column, needle: str) -> Column:
    return F.contains(F.lower(text), F.lit(needle.lower()))


def strip_instance(segment: Column) -> Column:
    return F.regexp_replace(segment, r"-[^-]*$", "")


def segment_prefix(segment: Column) -> Column:
    return F.regexp_extract(segment, r"^([^-]+-)", 1)


def module_component(module: Column, depth: int = 2, strip: str = "") -> Column:
    """The last depth segments of a module path, the first one without a prefix."""
    parts = F.filter(F.split(module, "::"), lambda s: s != "")
    if strip:
        cut = lambda s: F.when(F.startswith(s, F.lit(strip)) & (F.length(s) > len(strip)), F.substr(s, F.lit(len(strip) + 1))).otherwise(s)
        parts = F.transform(parts, lambda s, i: F.when(i == 0, cut(s)).otherwise(s))
    n = max(depth, 1)
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - (n - 1), F.lit(1)), F.lit(n)), "::")


def request_id_in(message: Column) -> Column:
    """The request id that a request's wording holds, NULL if none."""
    return F.nullif(F.regexp_extract(message, r'Request "[^"]*" \[([^\] ]*--[^\] ]*)\]', 1), F.lit(""))


def millis_between(start: Column, end: Column) -> Column:
    """Whole milliseconds, cut towards zero."""
    return ((F.unix_micros(end) - F.unix_micros(start)) / 1000).cast("long")


def duration_text(ms: Column) -> Column:
    """~Ns below a minute, ~Nmin below two hours, then ~Hh with the minutes left; each step rounds the one before."""
    seconds = F.greatest(F.floor((ms + 500) / 1000), F.lit(1)).cast("long")
    minutes = F.floor((seconds + 30) / 60).cast("long")
    hours, rest = F.floor(minutes / 60).cast("long"), minutes % 60
    return (
        F.when(ms <= 0, "~0s")
        .when(seconds < 60, F.format_string("~%ds", seconds))
        .when(minutes < 120, F.format_string("~%dmin", minutes))
        .when(rest == 0, F.format_string("~%dh", hours))
        .otherwise(F.format_string("~%dh %dm", hours, rest))
    )


def span_text(seconds: Column) -> Column:
    """A span of whole seconds in its two largest units."""
    unit = lambda size, within=None: F.floor((seconds if within is None else seconds % within) / size).cast("long")
    return (
        F.when(seconds < 60, F.format_string("%d seconds", seconds))
        .when(seconds < 3600, F.format_string("%d minutes, %d seconds", unit(60), seconds % 60))
        .when(seconds < 86_400, F.format_string("%d hours, %d minutes", unit(3600), unit(60, 3600)))
        .otherwise(F.format_string("%d days, %d hours", unit(86_400), unit(3600, 86_400)))
    )


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


def component_label() -> Column:
    return F.when(F.col("component_id") == "", F.col("component")).otherwise(F.concat(F.col("component"), F.lit(" ("), F.col("component_id"), F.lit(")")))


def type_label(short: bool = False) -> Column:
    first = F.substring("kind", 1, 1) if short else F.col("kind")
    return F.when(F.col("kind").isin(EVENT, REQUEST), F.concat_ws(":", first, F.col("direction"), F.col("name"))).when(F.col("kind") == COMMAND, F.concat_ws(":", first, F.col("name"))).otherwise(first)
