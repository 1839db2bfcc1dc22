"""Registered queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions.payload import compact_json, redact_json
from tracewright.functions.text import compare_key, component_label, duration_text, flow, iso_millis, level_rank, log_key, message_pattern, module_component, severity, truncated, type_label
from tracewright.operators import compare, errors, export, infer, info, perf, search, sessions, trace
from tracewright.operators.filters import LogFilter
from tracewright.operators.numbering import timeline_places
from tracewright.profile import KnownNames, SessionLevel

from tracewright.schema import barrier
from tracewright.sources.logs import frame, parse_entries
from tracewright.sources.tables import events_log, split_halves

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}

#: The events_log adapter in SQL.
LOG = """
log AS (
    SELECT event_id AS seq, ts, user_id, event_type,
        'svc-' || (user_id % 4) AS component, 'manager-' || (user_id % 10) || '/eyes-' || user_id AS component_id,
        CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END AS level,
        CASE event_type WHEN 'click' THEN 'Request "checkout" [0--' || user_id || '] will be sent'
            WHEN 'purchase' THEN 'Request "checkout" [0--' || user_id || '] finished successfully'
            WHEN 'view' THEN 'Received event of type Page.view' WHEN 'signup' THEN 'Emit event of type Page.view'
            ELSE 'failed to load item ' || (event_id + 1000000) || ' of group ' || (user_id % 7) END AS message,
        CASE WHEN event_type IN ('click', 'purchase') THEN 'Request' WHEN event_type IN ('view', 'signup') THEN 'Event' ELSE 'Generic' END AS kind,
        CASE WHEN event_type IN ('click', 'purchase') THEN 'checkout' WHEN event_type IN ('view', 'signup') THEN 'Page.view' END AS name,
        CASE event_type WHEN 'click' THEN 'Send' WHEN 'purchase' THEN 'Receive' WHEN 'view' THEN 'Receive' WHEN 'signup' THEN 'Emit' END AS direction,
        CASE WHEN event_type IN ('click', 'purchase') THEN '0--' || user_id END AS request_id,
        CASE WHEN event_type IN ('view', 'signup') THEN replace(rtrim(props, '}'), ': ', ':') || ',"key":"' || user_id || '"}' ELSE replace(props, ': ', ':') END AS payload_json
    FROM events
), keyed AS (
    SELECT *, CASE kind WHEN 'Generic' THEN 'Generic | ' || message || ':' ELSE kind || ' | ' || direction || ' `' || name || '`:' END AS log_key,
        CASE WHEN direction IN ('Emit', 'Send') THEN 'Outgoing' WHEN direction = 'Receive' THEN 'Incoming' END AS flow
    FROM log
)"""
STEPS = """
steps AS (
    SELECT *, CAST(user_id AS VARCHAR) AS k, event_type IN ('click', 'view') AS starts FROM log WHERE kind IN ('Request', 'Event')
), walked AS (
    SELECT *, lag(starts) OVER w AS b_starts, lag(ts) OVER w AS b_ts, lag(component) OVER w AS b_component, lead(1) OVER w IS NULL AS last
    FROM steps WINDOW w AS (PARTITION BY kind, k ORDER BY ts, seq)
), ops AS (
    SELECT kind AS op_type, name, CASE kind WHEN 'Request' THEN '0--' || k ELSE k END AS correlation_id, b_ts AS start_time, ts AS end_time,
        CAST((epoch_us(ts) - epoch_us(b_ts)) // 1000 AS BIGINT) AS duration_ms, b_component AS start_component, component AS end_component, seq
    FROM walked WHERE NOT starts AND b_starts
), orphans AS (
    SELECT kind AS op_type, name, CASE kind WHEN 'Request' THEN '0--' || k ELSE k END AS correlation_id, ts AS start_time, component, component_id, message AS context
    FROM walked WHERE starts AND last
)"""
STATS = """
stats AS (
    SELECT op_type, name, count(*) AS count, avg(duration_ms) AS avg_duration_ms, min(duration_ms) AS min_duration_ms, max(duration_ms) AS max_duration_ms,
        list_sort(list(duration_ms))[count(*) * 50 // 100 + 1] AS p50_duration_ms, list_sort(list(duration_ms))[count(*) * 95 // 100 + 1] AS p95_duration_ms,
        list_sort(list(duration_ms))[count(*) * 99 // 100 + 1] AS p99_duration_ms
    FROM ops GROUP BY op_type, name
)"""


def _ntz(df: DataFrame) -> DataFrame:
    """Times as plain text, the same on either side."""
    return df.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


def _time(column: str, alias: str | None = None) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f') AS {alias or column}"


def query(sql: str = ""):
    """Register a query under its function's name, with its SQL if it has one."""
    def add(f):
        _QUERIES[f.__name__] = lambda spark, sf_dir: _ntz(f(spark, sf_dir))
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return add


# --- operation timing -----------------------------------------------------------

_OPS = f"op_type, name, correlation_id, {_time('start_time')}, {_time('end_time')}, duration_ms, start_component, end_component"


def _paired(spark, sf_dir):
    return perf.steps(events_log(spark, sf_dir))


@query(f"WITH {LOG}, {STEPS} SELECT {_OPS}, NULL::VARCHAR AS endpoint, NULL::BIGINT AS status FROM ops")
def perf_operations(spark, sf_dir):
    return perf.operations(_paired(spark, sf_dir))


@query(f"WITH {LOG}, {STEPS}, {STATS} SELECT * FROM stats")
def perf_stats(spark, sf_dir):
    return perf.stats(perf.operations(_paired(spark, sf_dir)))


@query(f"WITH {LOG}, {STEPS} SELECT op_type, name, correlation_id, {_time('start_time')}, component, component_id, context FROM orphans")
def perf_orphans(spark, sf_dir):
    return perf.orphans(_paired(spark, sf_dir))


@query(f"WITH {LOG}, {STEPS} SELECT {_OPS} FROM ops WHERE duration_ms >= 60000000")
def perf_slow(spark, sf_dir):
    return perf.slow(perf.operations(_paired(spark, sf_dir)), 60_000_000).drop("endpoint", "status")


@query(f"WITH {LOG}, {STEPS} SELECT {_OPS} FROM (SELECT * FROM ops ORDER BY duration_ms DESC, end_time, op_type, correlation_id LIMIT 20)")
def perf_topn(spark, sf_dir):
    return perf.slowest(perf.operations(_paired(spark, sf_dir)), 20).drop("endpoint", "status")


@query(f"WITH {LOG}, {STEPS}, {STATS} SELECT * FROM stats WHERE op_type = 'Request'")
def perf_by_type(spark, sf_dir):
    return perf.sorted_stats(perf.stats(perf.operations(perf.steps(events_log(spark, sf_dir), op_type="Request"))), "count")


# --- filters ----------------------------------------------------------------------

def _filter(name: str, text: str, where: str) -> None:
    def run(spark, sf_dir):
        return LogFilter.parse(text).apply(events_log(spark, sf_dir)).select("seq", "component", "level", "message")

    run.__name__ = name
    query(f"WITH {LOG} SELECT seq, component, level, message FROM keyed WHERE {where}")(run)


_filter("filter_component", "c:SVC-1 c:svc-3", "component IN ('svc-1', 'svc-3')")
_filter("filter_level", "l:warn l:error", "level IN ('WARN', 'ERROR')")
_filter("filter_text_exclude", "!t:Checkout !level:error", "message NOT LIKE '%checkout%' AND level <> 'ERROR'")
_filter("filter_direction", "d:incoming", "flow = 'Incoming'")
_filter("filter_direction_exclude", "!d:incoming", "flow IS NULL OR flow <> 'Incoming'")
_filter("filter_field", "action:CLICK user:7 !component:svc-2", "(event_type = 'click' OR CAST(user_id AS VARCHAR) LIKE '%7%') AND component <> 'svc-2'")
_filter("filter_mixed", "c:svc-0 !l:info dir:outgoing", "component = 'svc-0' AND level <> 'INFO' AND flow = 'Outgoing'")


# --- search and extraction ----------------------------------------------------------

_RARE = "t:1000 l:error"  # errors on items with those digits


@query(f"""
    WITH {LOG}, hits AS (SELECT seq FROM log WHERE message LIKE '%1000%' AND level = 'ERROR'), near AS (SELECT DISTINCT unnest(range(seq - 2, seq + 3)) AS seq FROM hits),
    shown AS (SELECT l.seq, l.message, l.seq IN (SELECT seq FROM hits) AS is_match FROM log l JOIN near USING (seq))
    SELECT *, coalesce(seq - lag(seq) OVER (ORDER BY seq) > 1, false) AS new_chunk FROM shown
""")
def search_context(spark, sf_dir):
    return search.with_context(events_log(spark, sf_dir), LogFilter.parse(_RARE), 2).select("seq", "message", "is_match", "new_chunk")


def _count(by: str, key: str) -> None:
    def run(spark, sf_dir):
        return search.count_by(events_log(spark, sf_dir), LogFilter.parse("!l:error"), by)

    run.__name__ = f"count_by_{by}"
    query(f"WITH {LOG} SELECT {key} AS key, count(*) AS count FROM keyed WHERE level <> 'ERROR' GROUP BY 1")(run)


for _by, _key in (("matches", "'matches'"), ("component", "component"), ("level", "level"), ("type", "log_key"), ("payload", "coalesce(payload_json, '<none>')")):
    _count(_by, _key)


@query(f"WITH {LOG} SELECT json_extract(payload_json, '$.k')::VARCHAR AS value, count(*) AS count FROM log WHERE component = 'svc-1' GROUP BY 1")
def extract_field(spark, sf_dir):
    return search.extract(events_log(spark, sf_dir), LogFilter.parse("c:svc-1"), "k")


@query(f"""WITH {LOG} SELECT '"' || event_type || '"' AS value, count(*) AS count FROM log GROUP BY 1""")
def extract_structured(spark, sf_dir):
    return search.extract(events_log(spark, sf_dir), LogFilter.parse(""), "action")


@query(f"WITH {LOG} SELECT count(*) AS matches, count(json_extract(payload_json, '$.key')) AS extracted, 0::BIGINT AS missing_payload, count(*) - count(json_extract(payload_json, '$.key')) AS missing_field FROM log")
def extract_summary(spark, sf_dir):
    return search.extract_summary(events_log(spark, sf_dir), LogFilter.parse(""), "key")


_TRACED = """
    SELECT seq, log_key, CAST(coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER w)) // 1000, 0) AS BIGINT) AS delta_ms, CAST((epoch_us(ts) - epoch_us(first_value(ts) OVER w)) // 1000 AS BIGINT) AS elapsed_ms
    FROM keyed WHERE {} WINDOW w AS (ORDER BY ts, seq)"""


@query(f"WITH {LOG} {_TRACED.format("contains(component_id, 'eyes-12')")}")
def trace_session(spark, sf_dir):
    return trace.trace(events_log(spark, sf_dir), session="eyes-12").select("seq", "log_key", "delta_ms", "elapsed_ms")


@query(f"WITH {LOG} {_TRACED.format("contains(message, '0--7') OR contains(request_id, '0--7')")}")
def trace_id(spark, sf_dir):
    return trace.trace(events_log(spark, sf_dir), identifier="0--7").select("seq", "log_key", "delta_ms", "elapsed_ms")


@query(f"WITH {LOG} SELECT count(*) AS count, CAST((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS BIGINT) AS total_duration_ms FROM log WHERE contains(component_id, 'eyes-12')")
def trace_summary(spark, sf_dir):
    return trace.trace_summary(trace.trace(events_log(spark, sf_dir), session="eyes-12"))


# --- error clusters -----------------------------------------------------------------

def _sql_pattern(text: str) -> str:
    # What a message pattern leaves out, in DuckDB's form.
    rules = [
        (r"https?://[^\s\"'')]+", "..."), (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "..."),
        (r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b", "..."), (r"\b\d{2}:\d{2}:\d{2}(?:\.\d+)?\b", "..."), (r"\[[^\]\s]*--[^\]\s]+\]", "[...]"),
        *[(r"(?i)\b(id|request_id|session_id|render_id|job_id|test_id|check_id)\b\s*[:=]?\s*" + a, b) for a, b in (('"[^"]+"', '\\1 "..."'), ("''[^'']+''", "\\1 ''...''"), ("[A-Za-z0-9_.:-]{6,}", "\\1 ..."))],
        (r"(?i)\b[0-9a-f]{12,}\b", "..."), (r"\b\d{6,}\b", "..."), (r"\s+", " "),
    ]
    out = f"replace({text}, chr(10), ' ')"
    for pattern, to in rules:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return f"trim({out})"


@query(f"SELECT doc_id, {_sql_pattern('text')} AS pattern FROM documents")
def normalize_text(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", message_pattern(F.col("text")).alias("pattern"))


@query(f"SELECT conv_id, turn, {_sql_pattern('text')} AS pattern FROM conversations")
def normalize_turns(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", message_pattern(F.col("text")).alias("pattern"))


CLUSTERS = f"""
errors AS (
    SELECT *, CASE level WHEN 'WARN' THEN 'WARN' ELSE 'ERROR' END AS severity, {_sql_pattern('message')} AS pattern FROM log WHERE level IN ('ERROR', 'WARN')
), seen AS (SELECT component_id, max(ts) AS last_seen FROM log GROUP BY 1), open AS (SELECT DISTINCT component_id FROM orphans),
hit AS (
    SELECT severity, pattern, e.component_id, count(*) AS error_count, min(ts) AS first_error, max(ts) AS last_error, CASE WHEN any_value(o.component_id) IS NULL THEN 'completed' ELSE 'orphaned' END AS outcome,
        CAST(greatest(0, (epoch_us(any_value(last_seen)) - epoch_us(min(ts))) // 1000) AS BIGINT) AS blocking_ms
    FROM errors e JOIN seen s ON s.component_id = e.component_id LEFT JOIN open o ON o.component_id = e.component_id GROUP BY 1, 2, 3
), clusters AS (
    SELECT h.severity, h.pattern, CAST(sum(error_count) AS BIGINT) AS count, min(first_error) AS first_timestamp, max(last_error) AS last_timestamp, count(*) AS affected_sessions_count, max(blocking_ms) AS blocking_ms,
        (SELECT string_agg(DISTINCT component, ',' ORDER BY component) FROM errors e WHERE e.severity = h.severity AND e.pattern = h.pattern) AS components,
        (SELECT arg_min(message, (ts, seq)) FROM errors e WHERE e.severity = h.severity AND e.pattern = h.pattern) AS sample_message
    FROM hit h GROUP BY 1, 2
)"""
_CLUSTER = f"severity, pattern, count, components, {_time('first_timestamp')}, {_time('last_timestamp')}, sample_message, affected_sessions_count, blocking_ms"


def _impacts(spark, sf_dir):
    return errors.impacts(events_log(spark, sf_dir), warn=True)


def _clusters(spark, sf_dir):
    return errors.clusters(_impacts(spark, sf_dir)).withColumn("components", F.array_join("components", ","))


@query(f"WITH {LOG}, {STEPS}, {CLUSTERS} SELECT {_CLUSTER} FROM clusters")
def error_clusters(spark, sf_dir):
    return _clusters(spark, sf_dir)


for _sort, _order in (
    ("count", "count DESC, affected_sessions_count DESC, last_timestamp DESC, pattern"),
    ("time", "last_timestamp DESC, count DESC, pattern"),
    ("impact", "affected_sessions_count DESC, coalesce(blocking_ms, 0) DESC, count DESC, last_timestamp DESC, pattern"),
):

    def _sorted(spark, sf_dir, by=_sort):
        return errors.sort_clusters(_clusters(spark, sf_dir), by, 5)

    _sorted.__name__ = f"error_sort_{_sort}"
    query(f"WITH {LOG}, {STEPS}, {CLUSTERS} SELECT {_CLUSTER} FROM (SELECT * FROM clusters ORDER BY {_order}, severity LIMIT 5)")(_sorted)


@query(f"WITH {LOG}, {STEPS}, {CLUSTERS} SELECT severity, pattern, component_id AS session_path, error_count, outcome, {_time('first_error', 'first_error_timestamp')}, {_time('last_error', 'last_error_timestamp')}, blocking_ms FROM hit")
def error_sessions(spark, sf_dir):
    return errors.affected(_impacts(spark, sf_dir)).drop("outcome_rank")


@query(f"""
    WITH {LOG}, {STEPS}, {CLUSTERS}, t AS (SELECT severity, pattern FROM clusters ORDER BY count DESC, affected_sessions_count DESC, last_timestamp DESC, pattern, severity LIMIT 2)
    SELECT severity, pattern, component_id AS session_path, error_count, place FROM (
        SELECT h.*, CAST(row_number() OVER (PARTITION BY severity, pattern ORDER BY error_count DESC, CASE outcome WHEN 'orphaned' THEN 0 ELSE 1 END, component_id) AS INTEGER) AS place FROM hit h JOIN t USING (severity, pattern)) WHERE place <= 7""")
def error_session_order(spark, sf_dir):
    impacts = _impacts(spark, sf_dir)
    top = errors.sort_clusters(errors.clusters(impacts), "count", 2)
    place = F.row_number().over(Window.partitionBy("severity", "pattern").orderBy(*errors.session_order()))
    return errors.affected(impacts, top).withColumn("place", place).where("place <= 7").select("severity", "pattern", "session_path", "error_count", "place")


@query(f"""
    WITH {LOG}, {STEPS}, {CLUSTERS} SELECT CAST(sum(error_count) AS BIGINT) AS total, CAST(sum(error_count) FILTER (severity = 'ERROR') AS BIGINT) AS errors, CAST(sum(error_count) FILTER (severity = 'WARN') AS BIGINT) AS warnings,
        count(DISTINCT (severity, pattern)) AS patterns, count(DISTINCT component_id) AS sessions, max(blocking_ms) AS longest_blocking_ms, arg_max(severity, (blocking_ms, severity, pattern, component_id)) AS longest_severity,
        arg_max(pattern, (blocking_ms, severity, pattern, component_id)) AS longest_pattern, arg_max(component_id, (blocking_ms, severity, pattern, component_id)) AS longest_session FROM hit""")
def error_summary(spark, sf_dir):
    return errors.summary(_impacts(spark, sf_dir))


# --- scalar functions -----------------------------------------------------------------

@query(f"""
    WITH {LOG}, d AS (SELECT *, seq * 1723 AS ms FROM keyed), s AS (SELECT *, greatest((ms + 500) // 1000, 1) AS sec FROM d), m AS (SELECT *, (sec + 30) // 60 AS mins FROM s)
    SELECT seq, log_key, component || '|' || level || '|' || log_key AS compare_key, flow, CASE level WHEN 'WARN' THEN 'WARN' ELSE 'ERROR' END AS severity,
        CAST(CASE level WHEN 'ERROR' THEN 5 WHEN 'WARN' THEN 4 ELSE 3 END AS INTEGER) AS level_rank, component || ' (' || component_id || ')' AS label,
        CASE kind WHEN 'Generic' THEN 'G' ELSE substr(kind, 1, 1) || ':' || direction || ':' || name END AS type,
        strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS time, CASE WHEN length(message) > 20 THEN substr(message, 1, 17) || '...' ELSE message END AS short,
        CASE WHEN ms <= 0 THEN '~0s' WHEN sec < 60 THEN '~' || sec || 's' WHEN mins < 120 THEN '~' || mins || 'min' WHEN mins % 60 = 0 THEN '~' || mins // 60 || 'h' ELSE '~' || mins // 60 || 'h ' || mins % 60 || 'm' END AS duration,
        'view::' || user_id AS module
    FROM m""")
def scalar_functions(spark, sf_dir):
    module = F.concat(F.lit("app_core::"), F.lit("view::"), F.element_at("structured_fields", "user"))
    return events_log(spark, sf_dir).select(
        "seq", log_key().alias("log_key"), compare_key().alias("compare_key"), flow().alias("flow"), severity(F.col("level")).alias("severity"), level_rank(F.col("level")).alias("level_rank"), component_label().alias("label"),
        type_label(short=True).alias("type"), iso_millis(F.col("timestamp")).alias("time"), truncated(F.col("message"), 20).alias("short"), duration_text(F.col("seq") * 1723).alias("duration"), module_component(module, 2, "app_").alias("module"),
    )


# --- summaries --------------------------------------------------------------------------

@query(f"""
    WITH {LOG}, d AS (SELECT 'component' AS dimension, component AS value FROM log UNION ALL SELECT 'level', level FROM log UNION ALL SELECT lower(kind), name FROM log WHERE kind <> 'Generic')
    SELECT *, repeat('█', least(CAST(floor(percent + 0.5) AS INTEGER), 50)) AS bar FROM (SELECT dimension, value, count(*) AS count, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM log) AS percent FROM d GROUP BY 1, 2)""")
def info_counts(spark, sf_dir):
    return info.distributions(events_log(spark, sf_dir))


@query(f"WITH {LOG} SELECT kind, name, count(*) AS count, avg(strlen(payload_json)) AS avg_bytes, min(strlen(payload_json)) AS min_bytes, max(strlen(payload_json)) AS max_bytes FROM log WHERE name IS NOT NULL GROUP BY 1, 2")
def payload_sizes(spark, sf_dir):
    return info.payload_sizes(events_log(spark, sf_dir))


@query(f"""
    WITH {LOG}, p AS (
        SELECT kind, name, unnest(CASE kind WHEN 'Event' THEN ['k', 'k (number)', 'key', 'key (string)'] ELSE ['k', 'k (number)'] END) AS path FROM log WHERE name IS NOT NULL
    ), c AS (SELECT kind, name, path, count(*) AS count FROM p GROUP BY 1, 2, 3)
    SELECT *, (SELECT count(*) FROM log l WHERE l.kind = c.kind AND l.name = c.name) AS total, CAST(row_number() OVER (PARTITION BY kind, name ORDER BY count DESC, path) AS INTEGER) AS place, 0::BIGINT AS more FROM c""")
def payload_keys(spark, sf_dir):
    return info.payload_keys(events_log(spark, sf_dir))


@query(f"WITH {LOG} SELECT {_time('min(ts)', 'first_timestamp')}, {_time('max(ts)', 'last_timestamp')}, count(*) AS entries FROM log")
def time_range(spark, sf_dir):
    return info.time_range(events_log(spark, sf_dir))


@query(f"""
    WITH {LOG}, b AS (SELECT min(ts) AS lo, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS span FROM log),
    s AS (SELECT *, CASE WHEN span < 60 THEN 5 WHEN span < 3600 THEN 60 WHEN span < 86400 THEN 600 ELSE 3600::BIGINT END AS step FROM b), n AS (SELECT *, greatest(1, span // step) AS n FROM s),
    c AS (SELECT least((epoch_us(ts) - epoch_us(lo)) // (step * 1000000), n - 1) AS bucket, count(*) AS count FROM log, n GROUP BY 1)
    SELECT r.bucket, {_time("lo + to_seconds(r.bucket * step)", "start")}, coalesce(count, 0) AS count, repeat('█', CAST(greatest(coalesce(count, 0) * 40 // (SELECT max(count) FROM c), 1) AS INTEGER)) AS bar
    FROM (SELECT unnest(range(n)) AS bucket, lo, step FROM n) r LEFT JOIN c ON c.bucket = r.bucket""")
def timeline(spark, sf_dir):
    return info.timeline(events_log(spark, sf_dir))


@query(f"""
    WITH {LOG}, b AS (SELECT min(ts) AS lo, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS span FROM log),
    s AS (SELECT *, CASE WHEN span < 60 THEN 5 WHEN span < 3600 THEN 60 WHEN span < 86400 THEN 600 ELSE 3600::BIGINT END AS step FROM b), n AS (SELECT *, greatest(1, span // step) AS n FROM s),
    c AS (SELECT component, least((epoch_us(ts) - epoch_us(lo)) // (step * 1000000), n - 1) AS bucket, count(*) AS count FROM log, n GROUP BY 1, 2),
    t AS (SELECT component, CAST(sum(count) AS BIGINT) AS total, max(count) AS most FROM c GROUP BY 1 ORDER BY total DESC, component LIMIT 3)
    SELECT component, total, bucket, {_time("lo + to_seconds(bucket * step)", "start")}, count, repeat('█', CAST(greatest(count * 20 // most, 1) AS INTEGER)) AS bar FROM c JOIN t USING (component), n WHERE bucket % greatest(n // least(n, 5), 1) = 0""")
def component_timeline(spark, sf_dir):
    return info.component_timeline(events_log(spark, sf_dir), 3)


@query(f"WITH {LOG} SELECT component, seq, CAST(row_number() OVER (PARTITION BY component ORDER BY ts, seq) AS INTEGER) AS place FROM log QUALIFY place <= 3")
def samples(spark, sf_dir):
    return info.samples(events_log(spark, sf_dir)).select("component", "seq", "place")


_KNOWN = KnownNames(("SVC-0", "svc-1"), (), ("login",))


@query(f"WITH {LOG} SELECT DISTINCT 'component' AS what, component AS value FROM log WHERE component NOT IN ('svc-0', 'svc-1') UNION ALL SELECT DISTINCT 'request', name FROM log WHERE kind = 'Request'")
def unknown_names(spark, sf_dir):
    return info.unknown_names(events_log(spark, sf_dir), _KNOWN)


# --- sessions -----------------------------------------------------------------------------

_LEVELS = (SessionLevel("manager", "manager-", "checkout", ("checkout",), ("k",)), SessionLevel("eyes", "eyes-", "Page.view", ("Page.view",), ("k",)))


def _commands(spark, sf_dir):
    """Clicks create a manager's eyes session, purchases complete; views stand below it as operations."""
    e = events_log(spark, sf_dir)
    action = F.element_at("structured_fields", "action")
    path = F.when(action == "view", F.concat("component_id", F.lit("/step-"), (F.col("seq") % 5).cast("string"))).when(action == "signup", F.substring_index("component_id", "/", 1)).otherwise(F.col("component_id"))
    name = F.when(action == "click", "Page.view").when(action == "purchase", "checkout").when(action == "signup", "checkout")
    return e.withColumn("component_id", path).withColumn("name", name).withColumn("kind", F.when(name.isNotNull(), "Command").otherwise("Generic"))


SEGMENTS = """
cmd AS (SELECT *, 'manager-' || (user_id % 10) AS m, CASE WHEN event_type <> 'signup' THEN 'eyes-' || user_id END AS e FROM log),
seg AS (
    SELECT 'manager' AS level, m AS session_id, NULL AS parent, ts, seq, event_type, payload_json FROM cmd
    UNION ALL SELECT 'eyes', e, m, ts, seq, event_type, payload_json FROM cmd WHERE e IS NOT NULL
)"""
_SESSIONS = f"""
    WITH {LOG}, {SEGMENTS}, s AS (
    SELECT level, session_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS entry_count, arg_max(parent, (ts, seq)) FILTER (parent IS NOT NULL) AS parent,
        CASE level WHEN 'manager' THEN max(CASE WHEN event_type = 'signup' THEN 'checkout' END) ELSE max(CASE WHEN event_type = 'click' THEN 'Page.view' END) END AS created_via,
        CASE level WHEN 'manager' THEN max(CASE WHEN event_type IN ('signup', 'purchase') THEN 'checkout' END) ELSE max(CASE WHEN event_type = 'click' THEN 'Page.view' END) END AS completed_via,
        json_extract(arg_max(payload_json, (ts, seq)) FILTER (CASE level WHEN 'manager' THEN event_type = 'signup' ELSE event_type = 'click' END), '$.k')::VARCHAR AS k
    FROM seg GROUP BY 1, 2)"""


def _sessions(spark, sf_dir):
    return sessions.sessions(_commands(spark, sf_dir), _LEVELS)


@query(f"{_SESSIONS} SELECT level, session_id, {_time('first_seen')}, {_time('last_seen')}, entry_count, parent, created_via, completed_via, k FROM s")
def session_levels(spark, sf_dir):
    return _sessions(spark, sf_dir).withColumn("k", F.try_element_at("summary", F.lit("k"))).drop("summary")


@query(f"WITH {LOG}, {SEGMENTS} SELECT DISTINCT parent, session_id AS child FROM seg WHERE parent IS NOT NULL")
def session_tree(spark, sf_dir):
    return sessions.session_tree(_commands(spark, sf_dir), _LEVELS)


@query(f"WITH {LOG}, {SEGMENTS} SELECT session_id, 'step' AS operation, count(*) AS count FROM seg WHERE level = 'eyes' AND event_type = 'view' GROUP BY 1")
def session_operations(spark, sf_dir):
    return sessions.session_operations(_commands(spark, sf_dir), _LEVELS)


@query(f"{_SESSIONS} SELECT level, count(*) AS sessions, count(completed_via) AS completed, count(*) - count(completed_via) AS incomplete FROM s GROUP BY 1")
def session_completion(spark, sf_dir):
    return sessions.completion(_sessions(spark, sf_dir))


# --- comparison ------------------------------------------------------------------------------

def _joined(spark, sf_dir):
    log = events_log(spark, sf_dir)
    half = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.floor(F.max("event_id") / 2).alias("m")).first()["m"]
    one, two = split_halves(log, half)
    return compare.paired(compare.numbered(one), compare.numbered(two))


JOINED = """
half AS (SELECT max(event_id) // 2 AS m FROM events), k AS (SELECT *, component || '|' || level || '|' || log_key AS key FROM keyed),
a AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM k, half WHERE seq < m), b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM k, half WHERE seq >= m),
j AS (
    SELECT coalesce(a.key, b.key) AS key, CAST(coalesce(a.n, b.n) AS INTEGER) AS occurrence, a.seq AS s1, b.seq AS s2, a.payload_json AS p1, b.payload_json AS p2, a.message AS m1, b.message AS m2, json_extract(a.payload_json, '$.k')::VARCHAR AS k1, json_extract(b.payload_json, '$.k')::VARCHAR AS k2,
        json_extract(a.payload_json, '$.key')::VARCHAR AS y1, json_extract(b.payload_json, '$.key')::VARCHAR AS y2
    FROM a FULL JOIN b ON a.key = b.key AND a.n = b.n
), d AS (SELECT *, CASE WHEN k1 <> k2 THEN 1 ELSE 0 END + CASE WHEN y1 <> y2 THEN 1 ELSE 0 END AS diff_count FROM j WHERE s1 IS NOT NULL AND s2 IS NOT NULL),
sets AS (SELECT key, count(s1) AS first, count(s2) AS second FROM j GROUP BY key)"""


@query(f"WITH {LOG}, {JOINED} SELECT key, occurrence, s1 + 1 AS line1, s2 + 1 AS line2, diff_count, CASE WHEN diff_count > 0 AND m1 <> m2 THEN m1 END AS text1, CASE WHEN diff_count > 0 AND m1 <> m2 THEN m2 END AS text2 FROM d")
def compare_pairs(spark, sf_dir):
    return compare.pairs(_joined(spark, sf_dir)).drop("differences", "at", "component", "level", "kind")


@query(f"""WITH {LOG}, {JOINED} SELECT key, occurrence, 'k' AS path, k1 AS value1, k2 AS value2, 'modified' AS change FROM d WHERE k1 <> k2 UNION ALL SELECT key, occurrence, 'key', y1, y2, 'modified' FROM d WHERE y1 <> y2""")
def compare_diffs(spark, sf_dir):
    return compare.pairs(_joined(spark, sf_dir), diff_only=True).select("key", "occurrence", F.inline("differences"))


@query(f"WITH {LOG}, {JOINED} SELECT 1 AS side, key FROM sets WHERE second = 0 UNION ALL SELECT 2, key FROM sets WHERE first = 0")
def compare_unique(spark, sf_dir):
    j = _joined(spark, sf_dir)
    return compare.unique_keys(j, 1).select(F.lit(1).alias("side"), "key").union(compare.unique_keys(j, 2).select(F.lit(2), "key"))


_SURPLUS = "SELECT {0} AS side, key, occurrence, s{0} + 1 AS line, key || ' [unpaired occurrence ' || occurrence || ' at line ' || (s{0} + 1) || ']' AS label FROM j JOIN sets USING (key) WHERE first > 0 AND second > 0 AND s{1} IS NULL"


@query(f"WITH {LOG}, {JOINED} {_SURPLUS.format(1, 2)} UNION ALL {_SURPLUS.format(2, 1)}")
def compare_unpaired(spark, sf_dir):
    j = _joined(spark, sf_dir)
    return compare.unpaired(j, 1).select(F.lit(1).alias("side"), "*").union(compare.unpaired(j, 2).select(F.lit(2), "*"))


@query(f"""
    WITH {LOG}, {JOINED}, c AS (
        SELECT CAST(sum(CASE WHEN second = 0 THEN 1 ELSE greatest(first - second, 0) END) AS BIGINT) AS unique1, CAST(sum(CASE WHEN first = 0 THEN 1 ELSE greatest(second - first, 0) END) AS BIGINT) AS unique2,
            count(*) FILTER (first > 0 AND second > 0) AS shared, (SELECT CAST(sum(diff_count) AS BIGINT) FROM d) AS differences FROM sets
    ) SELECT *, unique1 + unique2 + differences > 0 AS has_differences FROM c""")
def compare_summary(spark, sf_dir):
    j = _joined(spark, sf_dir)
    return compare.summary(j, compare.pairs(j))


@query(f"WITH {LOG}, {JOINED}, f AS (SELECT key, occurrence, 'k' AS path, k1 AS v, k2 AS w FROM d WHERE k1 <> k2 UNION ALL SELECT key, occurrence, 'key', y1, y2 FROM d WHERE y1 <> y2) SELECT key, path, occurrence, v AS value1, w AS value2, 'modified' AS change, count(*) OVER (PARTITION BY key, path) AS instances FROM f")
def compare_regrouped(spark, sf_dir):
    return compare.regrouped(compare.pairs(_joined(spark, sf_dir), True))


for _by, _order in (("time", "min(since) OVER (PARTITION BY key)"), ("component", "component"), ("level", "CASE level WHEN 'ERROR' THEN 0 WHEN 'WARN' THEN 1 ELSE 2 END"), ("type", "kind"), ("diff-count", "-diff_count")):

    def _sorted_pairs(spark, sf_dir, by=_by):
        return compare.sorted_pairs(compare.pairs(_joined(spark, sf_dir)), by).limit(60).select("key", "occurrence", "line1", "line2", "diff_count")

    _sorted_pairs.__name__ = f"compare_sort_{_by.replace('-', '_')}"
    query(f"""WITH {LOG}, {JOINED}, o AS (SELECT d.*, least(x.ts, y.ts) AS since, x.component, x.level, x.kind FROM d JOIN log x ON x.seq = s1 JOIN log y ON y.seq = s2)
        SELECT key, occurrence, s1 + 1 AS line1, s2 + 1 AS line2, diff_count FROM (SELECT *, {_order} AS place FROM o) ORDER BY place, key, occurrence LIMIT 60""")(_sorted_pairs)


# --- inference and export --------------------------------------------------------------------

@query(f"WITH {LOG} SELECT DISTINCT 'component' AS what, component AS name FROM log UNION ALL SELECT DISTINCT 'request', name FROM log WHERE kind = 'Request'")
def infer_names(spark, sf_dir):
    return infer.known_names(events_log(spark, sf_dir))


@query(f"WITH {LOG}, p AS (SELECT 'manager-' AS prefix FROM log UNION ALL SELECT 'eyes-' FROM log) SELECT prefix, count(*) AS count FROM p GROUP BY 1 HAVING count(*) > 1")
def infer_prefixes(spark, sf_dir):
    return infer.prefix_ranks(events_log(spark, sf_dir))


@query(f"""
    WITH {LOG}, l AS (SELECT * FROM log ORDER BY seq LIMIT 100) SELECT count(*) AS entries, string_agg(DISTINCT component, ',' ORDER BY component) AS components, string_agg(DISTINCT level, ',' ORDER BY level) AS levels,
        strftime(arg_min(ts, seq), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS start, strftime(arg_max(ts, seq), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS "end" FROM l""")
def llm_metadata(spark, sf_dir):
    return export.metadata(events_log(spark, sf_dir))


@query(f"WITH {LOG}, l AS (SELECT * FROM log ORDER BY seq LIMIT 100) SELECT CASE kind WHEN 'Generic' THEN 'Generic' ELSE kind || ':' || direction || ':' || name END AS type, count(*) AS count FROM l GROUP BY 1")
def llm_types(spark, sf_dir):
    return export.type_counts(events_log(spark, sf_dir))


@query(f"""
    WITH {LOG}, l AS (SELECT * FROM keyed ORDER BY seq LIMIT 100) SELECT seq + 1 AS idx, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS ts, component || ' (' || component_id || ')' AS comp, level AS lvl,
        CASE kind WHEN 'Generic' THEN 'G' ELSE substr(kind, 1, 1) || ':' || direction || ':' || name END AS typ, message AS msg, regexp_replace(payload_json, '"key":"[^"]*"', '"key":"[REDACTED]"') AS data FROM l""")
def llm_export(spark, sf_dir):
    return export.export(events_log(spark, sf_dir))


@query(f"""WITH {LOG} SELECT seq, regexp_replace(payload_json, '"key":"[^"]*"', '"key":"[REDACTED]"') AS redacted FROM log""")
def redact(spark, sf_dir):
    return events_log(spark, sf_dir).select("seq", redact_json("payload_json").alias("redacted"))


@query("SELECT conv_id, turn, CASE WHEN text IS NULL THEN '{}' ELSE json_object('text', CASE WHEN length(text) > 100 THEN substr(text, 1, 97) || '...' ELSE text END)::VARCHAR END AS compacted FROM conversations")
def compact(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select("conv_id", "turn", compact_json(F.to_json(F.struct("text"))).alias("compacted"))


# --- parsing: entries written as text, and read back ---------------------------------------------

_ISO_MS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def _round_trip(spark, sf_dir, fmt, raw):
    from tracewright.profile import builtin

    log = events_log(spark, sf_dir)
    framed = barrier(log.select(F.lit("f").alias("file"), "source_line_number", raw(log).alias("raw_logline")))
    return parse_entries(framed, fmt, builtin("eyes").parser, year=2024)


_BACK = "seq + 1 AS source_line_number"


@query(f"""WITH {LOG} SELECT {_BACK}, component, component_id, strftime(date_trunc('millisecond', ts), '%Y-%m-%d %H:%M:%S.%f') AS timestamp, level, kind, name, direction, request_id, payload_json FROM (
    SELECT seq, ts, component, component_id, level, kind, CASE kind WHEN 'Request' THEN 'checkout' WHEN 'Event' THEN 'Page.view' END AS name, direction, request_id, payload_json FROM log)""")
def parse_classic_roundtrip(spark, sf_dir):
    def raw(_):
        words = (
            F.when(F.col("kind") == "Request", F.concat(F.col("message"), F.lit(" with body "), F.col("payload_json")))
            .when(F.col("kind") == "Event", F.concat(F.when(F.col("direction") == "Emit", "Emit").otherwise("Received"), F.lit(' event of type "Page.view" with payload '), F.col("payload_json")))
            .otherwise(F.concat("message", F.lit(" "), "payload_json"))
        )
        return F.concat("component", F.lit(" ("), "component_id", F.lit(") | "), F.date_format("timestamp", _ISO_MS), F.lit(" ["), F.rpad("level", 5, " "), F.lit("] "), words)

    return _round_trip(spark, sf_dir, "classic", raw).select("source_line_number", "component", "component_id", "timestamp", "level", "kind", "name", "direction", "request_id", "payload_json")


@query(f"""WITH {LOG} SELECT {_BACK}, 'core::' || component AS component, level, 'did ' || log.event_type AS message, CAST(log.user_id AS VARCHAR) AS "user", e.props AS props FROM log JOIN events e ON e.event_id = log.seq""")
def parse_tracing_roundtrip(spark, sf_dir):
    def raw(_):
        fields = "structured_fields"
        return F.concat(
            F.date_format("timestamp", _ISO_MS), F.lit(" "), F.lower("level"), F.lit(" app::core::"), F.col("component"), F.lit(": did "), F.element_at(fields, "action"), F.lit(" user="), F.element_at(fields, "user"),
            F.lit(" props="), F.when(F.col("kind") == "Event", F.concat(F.substring_index("payload_json", ',"key"', 1), F.lit("}"))).otherwise(F.col("payload_json")),
        )

    out = _round_trip(spark, sf_dir, "rust-tracing", raw)
    get = lambda k: F.element_at("structured_fields", k)
    return out.select("source_line_number", "component", "level", "message", get("user").alias("user"), F.replace(get("props"), F.lit(":"), F.lit(": ")).alias("props"))


@query(f"""WITH {LOG} SELECT {_BACK}, component, CAST(user_id AS VARCHAR) AS component_id, level, event_type || ' host' AS host, strftime(date_trunc('second', ts), '%m-%d %H:%M:%S') AS day FROM log""")
def parse_syslog_roundtrip(spark, sf_dir):
    def raw(_):
        return F.concat(F.date_format("timestamp", "MMM d HH:mm:ss"), F.lit(" "), F.element_at("structured_fields", "action"), F.lit(" "), F.col("component"), F.lit("["), F.element_at("structured_fields", "user"), F.lit("]: "), F.lower("level"), F.lit(" something"))

    out = _round_trip(spark, sf_dir, "syslog", raw)
    return out.select("source_line_number", "component", "component_id", "level", F.concat(F.element_at("structured_fields", "host"), F.lit(" host")).alias("host"), F.date_format("timestamp", "MM-dd HH:mm:ss").alias("day"))


@query(f"""WITH {LOG} SELECT {_BACK}, component, component_id, level, message, CAST(user_id AS VARCHAR) AS "user", CASE WHEN kind <> 'Request' THEN regexp_replace(payload_json, '"key":"[^"]*"', '"key":"x"') END AS payload_json FROM log""")
def parse_jsonl_roundtrip(spark, sf_dir):
    def raw(_):
        return F.to_json(F.struct(F.date_format("timestamp", _ISO_MS).alias("ts"), F.lower("level").alias("lvl"), F.col("component").alias("service"), "component_id", F.col("message").alias("msg"), F.element_at("structured_fields", "user").alias("user"), F.from_json("payload_json", "k bigint, key string").alias("payload")))

    out = _round_trip(spark, sf_dir, "json-lines", raw)
    return out.select("source_line_number", "component", "component_id", "level", "message", F.element_at("structured_fields", "user").alias("user"), F.regexp_replace("payload_json", '"key":"[^"]*"', '"key":"x"').alias("payload_json"))


@query("""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
    f AS (SELECT *, sum(CASE WHEN regexp_matches(t, '^[A-M]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS e FROM l)
    SELECT CAST(doc_id AS VARCHAR) AS file, min(line) AS source_line_number, string_agg(t, chr(10) ORDER BY line) AS raw_logline FROM f WHERE e > 0 GROUP BY doc_id, e""")
def frame_multiline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = docs.select(F.col("doc_id").cast("string").alias("file"), F.posexplode(F.split("text", "\n")).alias("p", "text"))
    return frame(lines.select("file", F.floor(F.col("p") / 16).alias("block"), (F.col("p") + 1).cast("long").alias("line"), "text"), F.rlike("text", F.lit("^[A-M]"))).select("file", "source_line_number", "raw_logline")


@query(f"WITH {LOG} SELECT seq, CAST(row_number() OVER (ORDER BY ts, seq) AS BIGINT) AS place FROM log")
def merged_timeline(spark, sf_dir):
    one, two = split_halves(events_log(spark, sf_dir), 400)
    return timeline_places(one.unionByName(two)).select("seq", F.col("place").cast("long").alias("place"))


def _all() -> None:
    from tracewright.plans import files  # noqa: F401  registers its queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_ORACLES)
