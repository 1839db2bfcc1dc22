"""Registered queries that start from log files, command lines and profiles, each with its SQL. The files are written from the events table first."""

from __future__ import annotations

import contextlib
import io
import json
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tracewright import cli
from tracewright.functions.payload import json_differences
from tracewright.functions.text import contains_any, span_text
from tracewright.operators import perf, search, sessions
from tracewright.operators.filters import LogFilter
from tracewright.plans.queries import LOG, STATS, STEPS, _time, query
from tracewright.profile import PerfRules, SessionLevel, builtin, builtin_names, parse_profile, to_toml
from tracewright.session import shared_folder
from tracewright.sources.logs import detect_file, parse_text, read_log, read_logs, with_sequence
from tracewright.sources.tables import events_log

_ISO_MS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"

#: The log with times in whole milliseconds, as files have them, and messages as the parser leaves them.
FILE_LOG = LOG.replace("FROM events\n", "FROM (SELECT * REPLACE (date_trunc('millisecond', ts) AS ts) FROM events) events\n")
_SAID = """CASE kind WHEN 'Request' THEN message || ' with body [JSON removed]' WHEN 'Event' THEN CASE direction WHEN 'Emit' THEN 'Emit' ELSE 'Received' END || ' event of type "Page.view"  with payload [JSON removed]' ELSE message || ' [JSON removed]' END"""


def _classic(log: DataFrame) -> DataFrame:
    """Lines of the pipe-delimited layout; every payload stands on a line of its own."""
    words = (
        F.when(F.col("kind") == "Request", F.concat(F.col("message"), F.lit(" with body \n"), F.col("payload_json")))
        .when(F.col("kind") == "Event", F.concat(F.when(F.col("direction") == "Emit", "Emit").otherwise("Received"), F.lit(' event of type "Page.view" with payload \n'), F.col("payload_json")))
        .otherwise(F.concat("message", F.lit(" \n"), "payload_json"))
    )
    return F.concat("component", F.lit(" ("), "component_id", F.lit(") | "), F.date_format("timestamp", _ISO_MS), F.lit(" ["), F.rpad("level", 5, " "), F.lit("] "), words)


def _tracing(_) -> DataFrame:
    field = lambda k: F.element_at("structured_fields", k)
    return F.concat(F.date_format("timestamp", _ISO_MS), F.lit(" "), F.lower("level"), F.lit(" app::core::"), F.col("component"), F.lit(": did "), field("action"), F.lit(' note="a \\"b\\"" user='), field("user"))


def _syslog(_) -> DataFrame:
    return F.concat(F.date_format("timestamp", "MMM d HH:mm:ss"), F.lit(" host "), F.col("component"), F.lit("["), F.element_at("structured_fields", "user"), F.lit("]: "), F.lower("level"), F.lit(" something"))


def _json(_) -> DataFrame:
    return F.to_json(F.struct(F.date_format("timestamp", _ISO_MS).alias("ts"), F.lower("level").alias("lvl"), F.col("component").alias("service"), "component_id", F.col("message").alias("msg"), F.element_at("structured_fields", "user").alias("user")))


LAYOUTS = {"classic": _classic, "rust-tracing": _tracing, "syslog": _syslog, "json-lines": _json}


def written(spark: SparkSession, sf_dir: str, layout: str = "classic", parts: int = 1, where: str = "true") -> str:
    """The path of log files with all events that where lets through, in order, in some files."""
    log = events_log(spark, sf_dir).where(where)
    path = f"{shared_folder(spark)}/tracewright-logs/{uuid.uuid4().hex}"
    files = log.repartition(1) if parts == 1 else log.repartitionByRange(parts, "seq")  # one file must be one task's
    files.sortWithinPartitions("seq").select(LAYOUTS[layout](log).alias("value")).write.text(path)
    return path


# --- scans ------------------------------------------------------------------------

@query(f"WITH {FILE_LOG} SELECT component, component_id, {_time('ts', 'timestamp')}, level, kind, name, direction, request_id, {_SAID} AS message, payload_json FROM log")
def scan_classic_file(spark, sf_dir):
    out = read_log(spark, written(spark, sf_dir, parts=3), builtin("eyes"))
    return out.select("component", "component_id", "timestamp", "level", "kind", "name", "direction", "request_id", F.replace("message", F.lit("\n"), F.lit("")).alias("message"), "payload_json")


@query(f"""WITH {FILE_LOG} SELECT 'core::' || component AS component, {_time('ts', 'timestamp')}, level, 'did ' || event_type AS message, CAST(user_id AS VARCHAR) AS "user", 'a "b"' AS note, 'app::core::' || component AS module_path FROM log""")
def scan_tracing_file(spark, sf_dir):
    out = read_log(spark, written(spark, sf_dir, "rust-tracing", 3))
    get = lambda k: F.element_at("structured_fields", k)
    return out.select("component", "timestamp", "level", "message", get("user").alias("user"), get("note").alias("note"), "module_path")


@query(f"WITH {FILE_LOG} SELECT component, CAST(user_id AS VARCHAR) AS component_id, level, lower(level) || ' something' AS message, 'host' AS host, strftime(ts, '%m-%d %H:%M:%S') AS day FROM log")
def scan_syslog_file(spark, sf_dir):
    out = read_log(spark, written(spark, sf_dir, "syslog", 3), year=2024)
    return out.select("component", "component_id", "level", "message", F.element_at("structured_fields", "host").alias("host"), F.date_format("timestamp", "MM-dd HH:mm:ss").alias("day"))


@query(f"""WITH {FILE_LOG} SELECT seq + 1 AS source_line_number, component, component_id, {_time('ts', 'timestamp')}, level, message, CAST(user_id AS VARCHAR) AS "user" FROM log""")
def scan_json_file(spark, sf_dir):
    out = read_log(spark, written(spark, sf_dir, "json-lines"))
    return out.select("source_line_number", "component", "component_id", "timestamp", "level", "message", F.element_at("structured_fields", "user").alias("user"))


@query(f"WITH {FILE_LOG} SELECT component, component_id, {_time('ts', 'timestamp')}, level, 'Generic' AS kind, payload_json FROM log")
def scan_default_profile(spark, sf_dir):
    """No profile: the format is found out, and everything is a generic entry."""
    return read_log(spark, written(spark, sf_dir, parts=2)).select("component", "component_id", "timestamp", "level", "kind", "payload_json")


@query(f"WITH {FILE_LOG} SELECT CASE WHEN level = 'ERROR' THEN 1 ELSE 0 END AS file_idx, row_number() OVER (PARTITION BY level = 'ERROR' ORDER BY seq) - 1 AS seq, 2 * row_number() OVER (PARTITION BY level = 'ERROR' ORDER BY seq) - 1 AS source_line_number, component FROM log")
def scan_two_files(spark, sf_dir):
    paths = [written(spark, sf_dir, where=f"level {op} 'ERROR'") for op in ("<>", "=")]
    return with_sequence(read_logs(spark, paths, builtin("eyes"))).select("file_idx", "seq", "source_line_number", "component")


@query("SELECT * FROM (VALUES ('classic', 'classic'), ('rust-tracing', 'rust-tracing'), ('syslog', 'syslog'), ('json-lines', 'json-lines')) t(layout, detected)")
def detect_formats(spark, sf_dir):
    found = [(layout, detect_file(spark, written(spark, sf_dir, layout))) for layout in LAYOUTS]
    return spark.createDataFrame(found, "layout string, detected string")


_SINGLE = (
    ('w (a-1/b-2) | 2024-03-01T10:00:00.250Z [WARN ] Command "open" is called with settings {x: 1, \'y\': [true, undefined]}', "eyes"),
    ('w | 2024-03-01T10:00:00.250Z [INFO ] Request "r" [0--q] will be sent to the address "[PUT]http://h/p" with body {"k": {"n": 1.50}}', "eyes"),
    ('w | 2024-03-01T10:00:00.250Z [INFO ] Emit event of type {"name":"T.u"} with payload [1, {"b": 2, "a": 1}]', "eyes"),
    ("2024-03-01T10:00:00Z host-a proc[7]: error disk full", "base"),
    ("2024-03-01T10:00:00Z INFO app::x::y: opened id=5 tag='q r' list=[1, (2)]", "base"),
    ('{"time": "2024-03-01T10:00:00Z", "severity": "fatal", "logger": "m::n::o", "event": "E", "fields": {"z": 1}, "extra": [1, 2]}', "base"),
    ("no entry at all", "base"),
)


@query("""SELECT * FROM (VALUES
    (0, 'w', 'a-1/b-2', 'WARN', 'Command', 'open', NULL, NULL, NULL, '{"x":1,"y":[true,null]}', 'Command "open" is called with settings [JSON removed]', NULL),
    (1, 'w', '', 'INFO', 'Request', 'r', 'Send', '0--q', 'PUT', '{"k":{"n":1.5}}', 'Request "r" [0--q] will be sent to the address "[PUT]http://h/p" with body [JSON removed]', NULL),
    (2, 'w', '', 'INFO', 'Event', 'T.u', 'Emit', NULL, NULL, '[1,{"a":1,"b":2}]', 'Emit event of type {"name":"T.u"}  with payload [JSON removed]', NULL),
    (3, 'proc', '7', 'ERROR', 'Generic', NULL, NULL, NULL, NULL, NULL, 'error disk full', 'host=host-a;pid=7'),
    (4, 'x::y', '', 'INFO', 'Generic', NULL, NULL, NULL, NULL, NULL, 'opened', 'id=5;list=[1, (2)];tag=q r'),
    (5, 'n::o', '', 'FATAL', 'Generic', NULL, NULL, NULL, NULL, '{"z":1}', 'E', 'extra=[1,2]')
) t(line, component, component_id, level, kind, name, direction, request_id, endpoint, payload_json, message, fields)""")
def single_entries(spark, sf_dir):
    out = None
    for i, (text, profile) in enumerate(_SINGLE):
        fields = F.array_join(F.transform(F.array_sort(F.map_entries("structured_fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
        one = parse_text(spark, text, builtin(profile)).select(F.lit(i).alias("line"), "component", "component_id", "level", "kind", "name", "direction", "request_id", "endpoint", "payload_json", "message", F.nullif(fields, F.lit("")).alias("fields"))
        out = one if out is None else out.union(one)
    return out


# --- profiles, filters, functions ----------------------------------------------------

@query("""SELECT * FROM (VALUES ('base', 'base', 0, 0, true), ('custom-start', 'custom-start', 2, 2, true), ('event-pipeline', 'event-pipeline', 2, 4, true), ('eyes', 'eyes', 3, 0, true), ('service-api', 'service-api', 2, 3, true)) t(preset, profile_name, levels, commands, round_trip)"""
)
def profiles(spark, sf_dir):
    """Bundled profiles, written as TOML and read again."""
    rows = []
    for name in builtin_names():
        p = builtin(f"config/{name.upper()}.toml")
        rows.append((name, p.profile_name, len(p.levels), len(p.profile.known_commands), parse_profile(to_toml(p, "a\nheader")) == p))
    return spark.createDataFrame(rows, "preset string, profile_name string, levels int, commands int, round_trip boolean")


@query(f"WITH {LOG} SELECT seq, component, level FROM keyed WHERE component IN ('svc-1', 'svc-2') AND level <> 'ERROR' AND flow = 'Incoming' AND event_type = 'view' AND message NOT LIKE '%zzz%'")
def filter_builder(spark, sf_dir):
    wanted = LogFilter().component("svc-1").component("SVC-2").level("error", exclude=True).direction("incoming").field("action", "view").text("zzz", exclude=True)
    return wanted.apply(events_log(spark, sf_dir)).select("seq", "component", "level")


@query("SELECT * FROM (VALUES ('unknown level verbose'), ('unknown level chatty')) t(warning)")
def filter_warnings(spark, sf_dir):
    return spark.createDataFrame([(w,) for w in LogFilter.parse("l:verbose l:info !l:chatty l:warn").warnings()], "warning string")


@query(f"""
    WITH {LOG}, s AS (SELECT seq, seq * 977 AS n FROM log)
    SELECT seq, CASE WHEN n < 60 THEN n || ' seconds' WHEN n < 3600 THEN n // 60 || ' minutes, ' || n % 60 || ' seconds' WHEN n < 86400 THEN n // 3600 || ' hours, ' || n % 3600 // 60 || ' minutes'
        ELSE n // 86400 || ' days, ' || n % 86400 // 3600 || ' hours' END AS span FROM s""")
def span_texts(spark, sf_dir):
    return events_log(spark, sf_dir).select("seq", span_text(F.col("seq") * 977).alias("span"))


# --- timing, with commands and with ids taken from messages ----------------------------

_OPS = f"op_type, name, correlation_id, {_time('start_time')}, {_time('end_time')}, duration_ms"


@query(f"WITH {LOG}, {STEPS} SELECT {_OPS} FROM ops WHERE op_type = 'Request'")
def perf_ids_from_messages(spark, sf_dir):
    bare = events_log(spark, sf_dir).withColumn("request_id", F.lit(None).cast("string"))
    return perf.operations(perf.steps(bare, op_type="Request")).select("op_type", "name", "correlation_id", "start_time", "end_time", "duration_ms")


def _with_commands(spark, sf_dir):
    """Clicks start command `sync`, purchases complete it, errors are commands without either marker."""
    e, action = events_log(spark, sf_dir), F.element_at("structured_fields", "action")
    words = F.when(action == "click", "Operation begin").when(action == "purchase", "Operation finished").when(action == "error", "Operation idle")
    return e.withColumn("message", F.coalesce(words, "message")).withColumn("kind", F.when(words.isNotNull(), "Command").otherwise(F.col("kind"))).withColumn("name", F.when(words.isNotNull(), "sync").otherwise(F.col("name")))


@query(f"""
    WITH {LOG}, s AS (SELECT *, event_type = 'click' AS starts FROM log WHERE event_type IN ('click', 'purchase')),
    w AS (SELECT *, lag(starts) OVER w AS b_starts, lag(ts) OVER w AS b_ts FROM s WINDOW w AS (PARTITION BY component_id ORDER BY ts, seq))
    SELECT 'sync:' || component_id AS correlation_id, {_time('b_ts', 'start_time')}, {_time('ts', 'end_time')}, CAST((epoch_us(ts) - epoch_us(b_ts)) // 1000 AS BIGINT) AS duration_ms FROM w WHERE NOT starts AND b_starts""")
def perf_commands(spark, sf_dir):
    rules = PerfRules(("begin",), ("finished",), ("key",))
    log = _with_commands(spark, sf_dir)
    ops = perf.operations(perf.steps(log, rules, "Command", perf.tracks_commands(log, rules)))
    return ops.select("correlation_id", "start_time", "end_time", "duration_ms")


@query(f"WITH {LOG} SELECT false AS tracked, count(*) FILTER (event_type IN ('click', 'purchase', 'error')) AS commands FROM log")
def perf_commands_gate(spark, sf_dir):
    """A log whose commands never say that they are done: commands aren't paired."""
    log = _with_commands(spark, sf_dir)
    tracked = perf.tracks_commands(log.where(~contains_any(F.col("message"), ("finished",))), PerfRules(("begin",), ("finished",), ("key",)))
    return log.agg(F.lit(tracked).alias("tracked"), F.count_if(F.col("kind") == "Command").alias("commands"))


for _sort, _order in (("duration", "avg_duration_ms DESC"), ("count", "count DESC"), ("name", "name")):

    def _stats_sorted(spark, sf_dir, by=_sort):
        return perf.sorted_stats(perf.stats(perf.operations(perf.steps(events_log(spark, sf_dir)))), by, 1)

    _stats_sorted.__name__ = f"perf_stats_by_{_sort}"
    query(f"WITH {LOG}, {STEPS}, {STATS} SELECT * FROM stats ORDER BY {_order}, op_type, name LIMIT 1")(_stats_sorted)


@query(f"WITH {LOG} SELECT coalesce(payload_json, '<none>') AS key, count(*) AS count FROM log GROUP BY 1 ORDER BY count DESC, key LIMIT 7")
def count_order(spark, sf_dir):
    return search.count_by(events_log(spark, sf_dir), LogFilter(), "payload").limit(7)


@query(f"WITH {LOG}, u AS (SELECT *, CASE WHEN event_type <> 'error' THEN payload_json END AS p FROM log) SELECT count(*) AS matches, count(json_extract(p, '$.key')) AS extracted, count(*) FILTER (p IS NULL) AS missing_payload, count(p) - count(json_extract(p, '$.key')) AS missing_field FROM u")
def extract_without_payloads(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return search.extract_summary(log.withColumn("payload_json", F.when(F.element_at("structured_fields", "action") != "error", F.col("payload_json"))), LogFilter(), "key")


@query(f"WITH {LOG}, c AS (SELECT 'manager' AS level, 'k' AS field, '7' AS value FROM log WHERE event_type = 'click' LIMIT 1) SELECT * FROM c")
def session_common_fields(spark, sf_dir):
    """All managers are created with one and the same payload."""
    e = events_log(spark, sf_dir).where("kind = 'Request'").withColumns({"component_id": F.substring_index("component_id", "/", 1), "kind": F.lit("Command"), "payload_json": F.lit('{"k":7}')})
    return sessions.common_fields(sessions.sessions(e, (SessionLevel("manager", "manager-", "checkout", ("checkout",), ("k",)),)))


# --- structural differences: keys added and removed, arrays, types -----------------------

@query(f"""
    WITH {LOG}, v AS (SELECT seq, user_id % 3 AS a, event_type AS t FROM log)
    SELECT seq, 'a' AS path, CAST(a AS VARCHAR) AS value1, CAST(a + 1 AS VARCHAR) AS value2, 'modified' AS change FROM v
    UNION ALL SELECT seq, 'gone', '"' || t || '"', 'null', 'removed' FROM v UNION ALL SELECT seq, 'new', 'null', '"' || t || '"', 'added' FROM v
    UNION ALL SELECT seq, 'deep.x', '1', '"1"', 'modified' FROM v UNION ALL SELECT seq, 'pair[0].w', '0', '1', 'modified' FROM v
    UNION ALL SELECT seq, 'list[' || i || ']', CAST([3, 1, 2][i + 1] AS VARCHAR), CAST(i + 1 AS VARCHAR), 'modified' FROM v, range(3) r(i) UNION ALL SELECT seq, 'list[3]', 'null', '4', 'added' FROM v""")
def payload_differences(spark, sf_dir):
    e = events_log(spark, sf_dir).select("seq", (F.element_at("structured_fields", "user").cast("long") % 3).alias("a"), F.element_at("structured_fields", "action").alias("t"))
    one = F.format_string('{"a":%d,"deep":{"x":1,"y":[1,{"b":2}]},"gone":"%s","list":[3,1,2],"objects":[{"id":1,"v":"x"},{"id":2,"v":"y"}],"pair":[{"id":1,"w":0}]}', "a", "t")
    two = F.format_string('{"a":%d,"deep":{"x":"1","y":[1,{"b":2}]},"list":[1,2,3,4],"new":"%s","objects":[{"v":"y","id":2},{"v":"x","id":1}],"pair":[{"id":1,"w":1}]}', F.col("a") + 1, "t")
    return e.select("seq", F.inline(json_differences(one, two)))


# --- command lines -----------------------------------------------------------------------

def _say(spark: SparkSession, out, *argv: str) -> None:
    with contextlib.redirect_stdout(out):
        code = cli.main([*argv, "-q"], spark)
    if code:
        raise RuntimeError(f"{argv[0]} failed")


def _said(spark: SparkSession, *argv: str) -> str:
    out = io.StringIO()
    _say(spark, out, *argv)
    return out.getvalue()


def _told(spark, *argv: str) -> dict:
    return json.loads(_said(spark, *argv, "--preset", "eyes", "-j"))


@query(f"WITH {FILE_LOG}, {STEPS}, {STATS} SELECT op_type, name, count, min_duration_ms, max_duration_ms, p50_duration_ms, p95_duration_ms, (SELECT count(*) FROM orphans) AS orphans, (SELECT count(*) FROM log) AS total_entries FROM stats")
def cli_perf(spark, sf_dir):
    data = _told(spark, "perf", written(spark, sf_dir))
    rows = [(s["op_type"], s["name"], s["count"], s["min_duration_ms"], s["max_duration_ms"], s["p50_duration_ms"], s["p95_duration_ms"], len(data["orphans"]), data["total_entries"]) for s in data["stats"]]
    return spark.createDataFrame(rows, "op_type string, name string, count long, min_duration_ms long, max_duration_ms long, p50_duration_ms long, p95_duration_ms long, orphans long, total_entries long")


@query(f"""
    WITH {FILE_LOG}, {STEPS}, e AS (SELECT component, user_id % 7 AS g FROM log WHERE level = 'ERROR'), c AS (SELECT g, count(*) AS n FROM e GROUP BY 1)
    SELECT 'failed to load item ... of group ' || g || ' [JSON removed]' AS pattern, n AS count, (SELECT count(DISTINCT component_id) FROM log WHERE level = 'ERROR' AND user_id % 7 = g) AS sessions FROM c""")
def cli_errors(spark, sf_dir):
    data = _told(spark, "errors", written(spark, sf_dir), "--top-n", "0", "--sessions")["errors"]
    rows = [(c["pattern"].replace("\n", ""), c["count"], len(c["affected_sessions"])) for c in data["clusters"]]
    return spark.createDataFrame(rows, "pattern string, count long, sessions long")


@query(f"""WITH {FILE_LOG}, h AS (SELECT seq FROM log WHERE message LIKE '%10007%' AND level = 'ERROR'), n AS (SELECT DISTINCT unnest(range(seq - 1, seq + 2)) AS seq FROM h)
    SELECT 2 * seq + 1 AS line, component, level, seq IN (SELECT seq FROM h) AS is_match, payload_json AS payload FROM log JOIN n USING (seq)""")
def cli_search(spark, sf_dir):
    data = _told(spark, "search", written(spark, sf_dir), "-f", "t:10007 l:error", "--context", "1", "--payloads")["search"]
    rows = [(e["source_line_number"], e["component"], e["level"], e["is_match"], json.dumps(e["payload"], separators=(",", ":"), sort_keys=True)) for e in data["entries"]]
    return spark.createDataFrame(rows, "line long, component string, level string, is_match boolean, payload string")


@query(f"WITH {FILE_LOG} SELECT level AS key, count(*) AS count, (SELECT count(*) FROM log WHERE component = 'svc-2') AS matches FROM log WHERE component = 'svc-2' GROUP BY 1")
def cli_search_counts(spark, sf_dir):
    data = _told(spark, "search", written(spark, sf_dir), "-f", "c:svc-2", "--count-by", "level")["search"]
    return spark.createDataFrame([(g["key"], g["count"], data["matches"]) for g in data["groups"]], "key string, count long, matches long")


@query(f"WITH {FILE_LOG} SELECT json_extract(payload_json, '$.k')::BIGINT AS value, count(*) AS count FROM log WHERE level <> 'ERROR' GROUP BY 1")
def cli_extract(spark, sf_dir):
    data = _told(spark, "extract", written(spark, sf_dir), "--field", "k", "-f", "!l:error")["extract"]
    return spark.createDataFrame([(g["value"], g["count"]) for g in data["groups"]], "value long, count long")


@query(f"""
    WITH {FILE_LOG} SELECT 2 * seq + 1 AS line, CAST(coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER w)) // 1000, 0) AS BIGINT) AS delta_ms, CAST((epoch_us(ts) - epoch_us(first_value(ts) OVER w)) // 1000 AS BIGINT) AS elapsed_ms
    FROM log WHERE contains(component_id, 'eyes-1') WINDOW w AS (ORDER BY ts, seq)""")
def cli_trace(spark, sf_dir):
    return _passed(spark, Entries, "trace", written(spark, sf_dir), "--session", "eyes-1")


@query(f"""WITH {FILE_LOG}, d AS (SELECT 'component' AS dimension, component AS value FROM log UNION ALL SELECT 'level', level FROM log UNION ALL SELECT lower(kind), name FROM log WHERE kind <> 'Generic')
    SELECT dimension, value, count(*) AS count, (SELECT count(*) FROM log) AS entries, (SELECT count(DISTINCT component) FROM log) AS sampled FROM d GROUP BY 1, 2""")
def cli_info(spark, sf_dir):
    data = _told(spark, "info", written(spark, sf_dir), "-s", "-t", "-p", "--json-schema")
    sampled = len({s["component"].split(" ")[0] for s in data["samples"]})
    return spark.createDataFrame([(d["dimension"], d["value"], d["count"], data["entries"], sampled) for d in data["distributions"]], "dimension string, value string, count long, entries long, sampled long")


@query(f"""WITH {FILE_LOG} SELECT seq + 1 AS idx, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS ts, component || ' (' || component_id || ')' AS comp, level AS lvl, (SELECT count(*) FROM log) AS total FROM log ORDER BY seq LIMIT 30""")
def cli_process(spark, sf_dir):
    data = _told(spark, "process", written(spark, sf_dir), "--limit", "30")
    return spark.createDataFrame([(x["idx"], x["ts"], x["comp"], x["lvl"], data["metadata"]["total_entries"]) for x in data["logs"]], "idx long, ts string, comp string, lvl string, total long")


_SIDES = f"""{FILE_LOG}, k AS (SELECT *, component || '|' || level || '|' || CASE kind WHEN 'Generic' THEN 'Generic | ' || {_SAID} || ':' ELSE kind || ' | ' || direction || ' `' || name || '`:' END AS key FROM log),
    a AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM k WHERE seq % 2 = 0), b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM k WHERE seq % 2 = 1),
    j AS (SELECT a.seq AS s1, b.seq AS s2, coalesce(a.key, b.key) AS key, CAST(coalesce(a.n, b.n) AS INTEGER) AS occurrence, json_extract(a.payload_json, '$.k')::VARCHAR AS k1, json_extract(b.payload_json, '$.k')::VARCHAR AS k2,
        json_extract(a.payload_json, '$.key')::VARCHAR AS y1, json_extract(b.payload_json, '$.key')::VARCHAR AS y2 FROM a FULL JOIN b ON a.key = b.key AND a.n = b.n),
    d AS (SELECT *, CASE WHEN k1 <> k2 THEN 1 ELSE 0 END + CASE WHEN y1 <> y2 THEN 1 ELSE 0 END AS diff_count FROM j WHERE s1 IS NOT NULL AND s2 IS NOT NULL)"""


class Passing(io.TextIOBase):
    """Rows of a table, found in a report while it goes by and written to the shared folder."""

    SIZE, ROWS = 1 << 20, 1 << 17
    KINDS: dict[str, pa.DataType]

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.pieces, self.size, self.most = [], 0, self.SIZE
        self.some = False
        self.rows: tuple[list, ...] = tuple([] for _ in self.KINDS)

    def write(self, text: str) -> int:
        self.pieces.append(text)
        self.size += len(text)
        if self.size > self.most:
            self.read()
        return len(text)

    def read(self) -> None:
        text = "".join(self.pieces)
        end = self.found(text)
        self.pieces, self.size = [text[end:]], len(text) - end
        self.most = max(self.SIZE, 2 * self.size)  # what is longer is not looked at again with every piece

    def found(self, text: str) -> int:
        """Adds the rows in a text; how far it is read."""
        raise NotImplementedError

    def add(self, *row) -> None:
        for column, x in zip(self.rows, row, strict=True):
            column.append(x)
        if len(self.rows[0]) >= self.ROWS:
            self.put()

    def put(self) -> None:
        """Writes the rows. They go to a task as one packed value, as the driver would hold rows several times over."""
        schema = pa.schema(self.KINDS)
        data = pa.BufferOutputStream()
        with pa.ipc.new_stream(data, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(pa.table({k: pa.array(x, t) for (k, t), x in zip(self.KINDS.items(), self.rows, strict=True)}), 10_000)

        def rows(batches):
            for batch in batches:
                for (one,) in zip(batch.column(0).to_pylist(), strict=True):
                    yield from pa.ipc.open_stream(one)

        packed = self.spark.createDataFrame([(data.getvalue().to_pybytes(),)], "packed binary").coalesce(1)
        packed.mapInArrow(rows, from_arrow_schema(schema)).write.mode("append").parquet(self.folder)
        self.rows, self.some = tuple([] for _ in self.KINDS), True

    def table(self) -> DataFrame:
        self.read()
        if self.rows[0] or not self.some:
            self.put()
        return self.spark.read.schema(from_arrow_schema(pa.schema(self.KINDS))).parquet(self.folder)


class Instances(Passing):
    """The instances of an indented comparison."""

    KINDS = {"key": pa.string(), "occurrence": pa.int32(), "diff_count": pa.int32()}
    #: A key's text, an instance's place and its number of differences, in the readable and the short layout. Strings have no raw line feeds, and no values stand so far to the left.
    SEEN = re.compile(r'\n {8}(?:"(?:raw_key|r)": (".*")|  "(?:log1_index|l1)": (\d+)|  "(?:diff_count|dc)": (\d+))')

    key, place = "", 0

    def found(self, text: str) -> int:
        end = max(text.rfind("\n"), 0)
        for m in self.SEEN.finditer(text, 0, end):
            if m.lastindex == 1:
                self.key = json.loads(m[1]).replace("\n", "")
            elif m.lastindex == 2:
                self.place = int(m[2])
            else:
                self.add(self.key, self.place, int(m[3]))
        return end


class OneLine(Passing):
    """The instances of a comparison on one line, in the standard layout: read one by one, as they are values of any depth."""

    KINDS = Instances.KINDS
    #: What stands before a comparison's key, and between it and its instances. In strings, quotes have backslashes.
    KEY, LIST = '{"key": ', ', "instances": ['

    key, inside = "", False
    one = staticmethod(json.JSONDecoder().raw_decode)

    def found(self, text: str) -> int:
        at = 0
        with contextlib.suppress(json.JSONDecodeError):  # the rest of a value is yet to come
            while True:
                if not self.inside:
                    begin = text.find(self.KEY, at)
                    if begin < 0:
                        return max(at, len(text) - len(self.KEY) + 1)
                    at = begin
                    key, end = self.one(text, begin + len(self.KEY))
                    if not text.startswith(self.LIST, end):
                        break
                    self.key, self.inside, at = key["raw_key"].replace("\n", ""), True, end + len(self.LIST)
                elif text.startswith("]", at):
                    self.inside, at = False, at + 1
                else:
                    x, at = self.one(text, at + 2 * text.startswith(", ", at))
                    self.add(self.key, x["log1_index"], x["diff_count"])
        return at

    def table(self) -> DataFrame:
        out = super().table()
        if self.inside or "".join(self.pieces).startswith(self.KEY):
            raise ValueError("the comparison ends midway")
        return out


class Entries(Passing):
    """The entries of an indented trace."""

    KINDS = {"line": pa.int64(), "delta_ms": pa.int64(), "elapsed_ms": pa.int64()}
    #: An entry's own numbers: strings have no raw line feeds, and its fields stand further to the right.
    SEEN = re.compile(r'\n {8}"(source_line_number|delta_ms|elapsed_ms)": (\d+)')

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder)
        self.own: dict[str, int] = {}

    def found(self, text: str) -> int:
        end = max(text.rfind("\n"), 0)
        for m in self.SEEN.finditer(text, 0, end):
            self.own[m[1]] = int(m[2])
            if len(self.own) == 3:
                self.add(self.own["source_line_number"], self.own["delta_ms"], self.own["elapsed_ms"])
                self.own = {}
        return end


class FirstLine(io.TextIOBase):
    """The first line of what goes by."""

    def __init__(self):
        self.line, self.over = "", False

    def write(self, text: str) -> int:
        if not self.over:
            line, end, _ = text.partition("\n")
            self.line, self.over = self.line + line, bool(end)
        return len(text)


def _passed(spark: SparkSession, kind: type[Passing], *argv: str) -> DataFrame:
    """The rows that kind finds in a command's JSON."""
    out = kind(spark, f"{shared_folder(spark)}/tracewright-logs/{uuid.uuid4().hex}")
    _say(spark, out, *argv, "--preset", "eyes", "-j")
    return out.table()


def _compared(spark, sf_dir, command: str, layout: str):
    paths = [written(spark, sf_dir, where=f"seq % 2 = {i}") for i in (0, 1)]
    return _passed(spark, OneLine if command == "llm-diff" else Instances, command, *paths, "--layout", layout)


for _command, _layout in (("compare", "readable"), ("diff", "short"), ("llm-diff", "standard")):

    def _compare(spark, sf_dir, command=_command, layout=_layout):
        return _compared(spark, sf_dir, command, layout)

    _compare.__name__ = f"cli_{_command.replace('-', '_')}"
    # llm-diff compares redacted payloads, in which values of `key` are all alike
    _count = "CASE WHEN k1 <> k2 THEN 1 ELSE 0 END" if _command == "llm-diff" else "diff_count"
    query(f"WITH {_SIDES} SELECT key, occurrence, {_count} AS diff_count FROM d" + (f" WHERE {_count} > 0" if _command != "compare" else ""))(_compare)


@query(f"WITH {_SIDES} SELECT (SELECT count(DISTINCT key) FROM d) AS shared, (SELECT CAST(sum(diff_count) AS BIGINT) FROM d) AS differences")
def cli_compare_text(spark, sf_dir):
    paths = [written(spark, sf_dir, where=f"seq % 2 = {i}") for i in (0, 1)]
    out = FirstLine()
    _say(spark, out, "compare", *paths, "--preset", "eyes", "-v")
    numbers = [int(w.rstrip(",")) for w in out.line.split() if w.rstrip(",").isdigit()]
    return spark.createDataFrame([(numbers[2], numbers[3])], "shared long, differences long")


@query("SELECT * FROM (VALUES ('generated', 'classic', 'svc-0,svc-1,svc-2,svc-3', 'checkout', 'eyes-,manager-')) t(profile_name, format, components, requests, prefixes)")
def cli_generate_config(spark, sf_dir):
    p = parse_profile(_said(spark, "generate-config", written(spark, sf_dir), "--preset", "eyes"))
    row = (p.profile_name, p.parser.format, ",".join(sorted(p.profile.known_components)), ",".join(p.profile.known_requests), ",".join(x.segment_prefix for x in p.levels))
    return spark.createDataFrame([row], "profile_name string, format string, components string, requests string, prefixes string")


@query(f"WITH {FILE_LOG}, {STEPS}, {STATS} SELECT op_type || ' ' || name || ' ' || count AS said FROM stats UNION ALL SELECT (SELECT count(*) FROM ops) || ' operations, ' || (SELECT count(*) FROM orphans) || ' orphans' UNION ALL SELECT least((SELECT count(*) FROM orphans), 10) || ' shown'")
def cli_perf_text(spark, sf_dir):
    """The tables of the text report: statistics whole, open operations ten at most."""
    first, stats, _, orphans = _said(spark, "perf", written(spark, sf_dir), "--preset", "eyes").rstrip("\n").split("\n\n")
    rows = [first, *(" ".join(x.split()[:3]) for x in stats.splitlines()[1:]), f"{len(orphans.splitlines()) - 1} shown"]
    return spark.createDataFrame([(r,) for r in rows], "said string")


@query(f"WITH {FILE_LOG} SELECT 2 * seq + 1 AS line, level FROM log WHERE component = 'svc-3' AND level = 'WARN'")
def cli_output_file(spark, sf_dir):
    """A search whose text goes to a file."""
    import os
    import tempfile

    with tempfile.TemporaryDirectory() as folder:  # the command line's own machine
        path = os.path.join(folder, "out.txt")
        _said(spark, "search", written(spark, sf_dir), "--preset", "eyes", "-f", "c:svc-3 l:warn", "-o", path)
        with open(path, encoding="utf-8") as f:
            lines = [x.split() for x in f.read().splitlines()[:-1]]
    return spark.createDataFrame([(int(x[1]), x[3].strip("[]")) for x in lines], "line long, level string")


@query("SELECT * FROM (VALUES ('unreadable filter', 1), ('unknown preset', 1), ('malformed line', 1)) t(what, code)")
def cli_failures(spark, sf_dir):
    """Errors are said on the error stream and end with 1."""
    bad = f"{shared_folder(spark)}/tracewright-logs/{uuid.uuid4().hex}"
    spark.createDataFrame([('{"ts": 1}',), ("{broken",)], "value string").coalesce(1).write.text(bad)
    cases = {"unreadable filter": ["search", bad, "-f", "nocolon"], "unknown preset": ["info", bad, "--preset", "nope"], "malformed line": ["info", bad]}
    rows = []
    for what, argv in cases.items():
        with contextlib.redirect_stderr(io.StringIO()) as said:
            code = cli.main([*argv, "-q"], spark)
        rows.append((what, code if said.getvalue().startswith("error: ") else -1))
    return spark.createDataFrame(rows, "what string, code int")
