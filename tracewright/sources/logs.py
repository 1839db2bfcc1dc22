"""Log files as entries: scan, format detection, framing, header parsing and classification.

Files are read in splits. Line order inside a split is the scan's; splits of a
file are put in order by their start, and only one row a split (its number of
lines, the last entry start in it) is carried from split to split. So one huge
file is framed by many tasks.
"""

from __future__ import annotations

import datetime
import json
import re
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions.payload import canonical, find_payload
from tracewright.functions.text import contains_any, infer_level, module_component, normalize_level
from tracewright.profile import ParserRules, Profile
from tracewright.operators.numbering import numbered
from tracewright.schema import COMMAND, ENTRY, EVENT, GENERIC, REQUEST, barrier

# What the four formats look like.
_ISO = r"\d{4}-\d{2}-\d{2}[T ][0-9:.+-]+(?:Z|[+-]\d{2}:?\d{2})?"
_BSD = r"[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}"
_LEVELS = "(?i:trace|debug|info|warn|warning|error|fatal)"
CLASSIC_START = r"^[\w-]+(?:\s+\([^)]*\))?\s+\|\s+\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"
TRACING_START = rf"^{_ISO}\s+{_LEVELS}\b"
TRACING = rf"^({_ISO})\s+({_LEVELS})\s+([A-Za-z0-9_:.-]+):\s*([\s\S]*)$"
SYSLOG_START = rf"^(?:{_ISO}|{_BSD})\s+\S+\s+\S+(?:\[\d+\])?:"
SYSLOG = rf"^((?:{_ISO})|(?:{_BSD}))\s+(\S+)\s+([^\s:\[]+)(?:\[(\d+)\])?:\s*([\s\S]*)$"
STARTS = {"classic": CLASSIC_START, "rust-tracing": TRACING_START, "syslog": SYSLOG_START}
DETECT_LINES = 10


class LogFormatError(ValueError):
    """A file that can't be read in its format."""


def looks_like_json(line: str) -> bool:
    try:
        return line.startswith("{") and isinstance(json.loads(line), dict)
    except ValueError:
        return False


def detect_format(lines: list[str], configured: str = "auto") -> str:
    """The format that most of the first ten non-blank lines have; ties go to the one named first, no hit to classic."""
    if configured != "auto":
        return configured
    shown = [x for x in lines if x.strip()][:DETECT_LINES]
    tests = {
        "classic": lambda x: re.search(CLASSIC_START, x),
        "rust-tracing": lambda x: re.search(TRACING, x),
        "syslog": lambda x: re.search(SYSLOG, x),
        "json-lines": lambda x: looks_like_json(x.strip()),
    }
    scores = {name: sum(bool(test(x)) for x in shown) for name, test in tests.items()}
    return max(scores, key=scores.get)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 1) and text of a file, and the split (by start) it stands in. \\r before a line's end goes."""
    raw = spark.read.option("lineSep", "\n").text(path)
    raw = raw.select(F.regexp_replace("value", r"\r$", "").alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    own = raw.withColumn("own", F.row_number().over(Window.partitionBy("file", "block").orderBy("place")))
    sizes = raw.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a split
    return own.join(sizes.withColumn("before", before).drop("n"), ["file", "block"]).select("file", "block", (F.col("before") + F.col("own")).alias("line"), "text")


def frame(lines: DataFrame, start: Column) -> DataFrame:
    """Entries of lines (file, block, line, text): a line that starts one takes the lines up to the next start; lines before the first start go."""
    rows = lines.withColumn("opens", F.when(start, F.col("line")))
    inside = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    last = rows.groupBy("file", "block").agg(F.max("opens").alias("last"))
    carried = F.last("last", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.join(last.withColumn("carried", carried).drop("last"), ["file", "block"])
    rows = rows.withColumn("entry", F.coalesce(F.last("opens", ignorenulls=True).over(inside), "carried")).where("entry is not null")
    part = F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"])
    return rows.groupBy("file", "entry").agg(F.array_join(part, "\n").alias("raw_logline")).withColumnRenamed("entry", "source_line_number")


def parse_timestamp(text: Column, year: int | None = None) -> Column:
    """Zoned or local ISO times, else the syslog form in the given year (this one if None); NULL if none fits."""
    year = year or datetime.datetime.now(datetime.UTC).year
    iso = F.when(F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(\s?(Z|[+-]\d{2}:?\d{2}))?$")), F.try_to_timestamp(F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")))
    bsd = F.when(F.rlike(text, F.lit(f"^{_BSD}$")), F.try_to_timestamp(F.concat(F.lit(f"{year} "), F.regexp_replace(text, r"\s+", " ")), F.lit("yyyy MMM d HH:mm:ss")))
    return F.coalesce(iso, bsd)


# --- trailing key=value fields ---------------------------------------------

_KEY = re.compile(r"[A-Za-z_][A-Za-z0-9_.:-]*=")
_CLOSERS = {"{": "}", "[": "]", "(": ")"}


def _field_end(text: str, at: int) -> int | None:
    """Past the value that begins at `at`: quoted, bracketed or bare; None if there is none."""
    if at >= len(text) or text[at].isspace():
        return None
    quote = text[at] if text[at] in "\"'" else ""
    if quote:
        at += 1
        while at < len(text) and text[at] != quote:
            at += 2 if text[at] == "\\" else 1
        return at + 1 if at < len(text) else None
    if text[at] not in _CLOSERS:
        return re.compile(r"\S+").match(text, at).end()
    stack: list[str] = []
    while at < len(text):
        ch = text[at]
        if ch in "\"'":
            at += 1
            while at < len(text) and text[at] != ch:
                at += 2 if text[at] == "\\" else 1
        elif ch in _CLOSERS:
            stack.append(_CLOSERS[ch])
        elif stack and ch == stack[-1]:
            stack.pop()
            if not stack:
                return at + 1
        at += 1
    return None


def parse_fields(text: str) -> dict[str, str] | None:
    """key=value pairs that make up the whole text, of one key the last; None if anything else is in it."""
    out, at = {}, 0
    while at < len(text):
        m = _KEY.match(text, at)
        end = _field_end(text, m.end()) if m else None
        if end is None or (end < len(text) and not text[end].isspace()):
            return None
        value = text[m.end() : end]
        if value[0] in "\"'":
            value = re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t", "r": "\r"}.get(x[1], x[1]), value[1:-1], flags=re.S)
        out[m.group()[:-1]] = value
        at = end
        while at < len(text) and text[at].isspace():
            at += 1
    return out or None


def split_fields(text: str) -> tuple[str, dict[str, str]]:
    """The message, and the fields after the earliest white space from which on there are only fields."""
    text = text.rstrip()
    for at in [0, *(m.end() for m in re.finditer(r"\s", text))]:
        if (fields := parse_fields(text[at:].lstrip())) is not None:
            return text[:at].rstrip(), fields
    return text, {}


def message_and_fields(column: Column) -> Column:
    def run(texts: pd.Series) -> pd.DataFrame:
        got = [split_fields(t or "") for t in texts]
        return pd.DataFrame({"message": [m for m, _ in got], "fields": [f for _, f in got]})

    return F.pandas_udf(run, "struct<message:string,fields:map<string,string>>")(column)


# --- JSON lines --------------------------------------------------------------

_TIMES, _RANKS, _MODULES = ("timestamp", "@timestamp", "ts", "time"), ("level", "lvl", "severity"), ("module_path", "module", "target", "logger")
_COMPONENTS, _IDS, _MESSAGES, _PAYLOADS = ("component", "service", "source"), ("component_id", "session_id"), ("message", "msg", "event"), ("payload", "fields")
#: Keys with a place of their own; all others are structured fields (session_id is both).
_PLACED = {*_TIMES, *_RANKS, *_MODULES, *_COMPONENTS, "component_id", *_MESSAGES, *_PAYLOADS}


def _as_text(value) -> str:
    return value if isinstance(value, str) else canonical(value)


def map_json_line(line: str) -> dict | None:
    """Fields of an entry; None for what is no object or has no timestamp; ValueError for what is no JSON."""
    value = json.loads(line)
    if not isinstance(value, dict):
        return None
    string = lambda keys: next((value[k] for k in keys if isinstance(value.get(k), str)), None)
    if string(_TIMES) is None:
        return None
    level = next((_as_text(value[k]) for k in _RANKS if k in value and not isinstance(value[k], (dict, list)) and value[k] is not None), "INFO")
    found = [value[k] for k in _PAYLOADS if k in value]
    payload = canonical(found[0]) if found else None
    message = string(_MESSAGES)
    return {
        "ts": string(_TIMES), "lvl": level, "module": string(_MODULES), "component": string(_COMPONENTS), "component_id": string(_IDS) or "", "payload": payload,
        "message": message if message is not None else payload if payload is not None else line, "fields": {k: _as_text(v) for k, v in value.items() if k not in _PLACED},
    }


_JSON_ROW = "struct<ts:string,lvl:string,module:string,component:string,component_id:string,payload:string,message:string,fields:map<string,string>,ok:boolean>"


def _json_udf(strict: bool):
    @F.pandas_udf(_JSON_ROW)
    def read(column: pd.Series) -> pd.DataFrame:
        rows = []
        for line in column:
            try:
                row = map_json_line(line)
            except ValueError as e:
                if strict:
                    raise LogFormatError(f"malformed JSON line: {e}") from None
                row = None
            rows.append({**(row or dict.fromkeys(("ts", "lvl", "module", "component", "component_id", "payload", "message", "fields"))), "ok": row is not None})
        return pd.DataFrame(rows, columns=["ts", "lvl", "module", "component", "component_id", "payload", "message", "fields", "ok"])

    return read


# --- headers -------------------------------------------------------------------

def _headers(entries: DataFrame, fmt: str, rules: ParserRules, year: int | None, strict: bool) -> DataFrame:
    """raw_logline to component, component_id, timestamp, level, text, structured_fields, module_path, own_payload."""
    raw, none = F.col("raw_logline"), F.lit(None).cast("string")
    no_fields = F.create_map().cast("map<string,string>")
    if fmt == "classic":
        head, rest = F.substring_index(raw, " | ", 1), F.substr(raw, F.instr(raw, " | ") + 3)
        named = F.rlike(head, F.lit(r"^[^ ]* \([\s\S]*\)$"))
        opens = F.instr(rest, "[")
        after = F.substr(rest, opens + 1)
        columns = {
            "component": F.substring_index(head, " ", 1), "component_id": F.when(named, F.regexp_extract(head, r"^[^ ]* \(([\s\S]*)\)$", 1)).otherwise(""),
            "timestamp": parse_timestamp(F.trim(F.substring_index(rest, "[", 1)), year), "level": normalize_level(F.substring_index(after, "]", 1)),
            "text": F.substr(after, F.instr(after, "]") + 2), "structured_fields": no_fields, "module_path": none, "own_payload": none,
        }
        return entries.where((F.instr(raw, " | ") > 0) & (opens > 0) & (F.instr(after, "]") > 0)).select("*", *[c.alias(k) for k, c in columns.items()])
    if fmt == "rust-tracing":
        part = lambda i: F.regexp_extract(raw, TRACING, i)
        got = entries.where(F.rlike(raw, F.lit(TRACING))).withColumn("got", message_and_fields(part(4)))
        columns = {
            "component": module_component(part(3), rules.module_depth, rules.module_strip_prefix), "component_id": F.lit(""), "timestamp": parse_timestamp(part(1), year), "level": normalize_level(part(2)),
            "text": F.col("got.message"), "structured_fields": F.col("got.fields"), "module_path": part(3), "own_payload": none,
        }
        return got.select(*entries.columns, *[c.alias(k) for k, c in columns.items()])
    if fmt == "syslog":
        part = lambda i: F.regexp_extract(raw, SYSLOG, i)
        fields = F.map_filter(F.create_map(F.lit("host"), part(2), F.lit("pid"), part(4)), lambda k, v: v != "")
        columns = {
            "component": part(3), "component_id": part(4), "timestamp": parse_timestamp(part(1), year), "level": infer_level(part(5)), "text": part(5), "structured_fields": fields, "module_path": none, "own_payload": none,
        }
        return entries.where(F.rlike(raw, F.lit(SYSLOG))).select("*", *[c.alias(k) for k, c in columns.items()])
    got = entries.withColumn("got", _json_udf(strict)(raw)).where("got.ok")
    columns = {
        "component": F.coalesce("got.component", module_component(F.col("got.module"), rules.module_depth, rules.module_strip_prefix), F.lit("json")), "component_id": F.col("got.component_id"),
        "timestamp": parse_timestamp(F.col("got.ts"), year), "level": normalize_level(F.col("got.lvl")), "text": F.col("got.message"), "structured_fields": F.col("got.fields"), "module_path": F.col("got.module"), "own_payload": F.col("got.payload"),
    }
    return got.select(*entries.columns, *[c.alias(k) for k, c in columns.items()])


# --- classification -------------------------------------------------------------

def _payload_udf(indicators: tuple[str, ...]):
    @F.pandas_udf("struct<payload:string,place:int>")
    def read(column: pd.Series) -> pd.DataFrame:
        rows = []
        for text in column:
            found, value, place = find_payload(text, indicators) if text and ("{" in text or "[" in text) else (False, None, -1)
            first = place
            if found and indicators:  # the cleaned message is cut at the leftmost bracket that holds a payload
                first = find_payload(text)[2]
            rows.append((canonical(value) if found else None, first))
        return pd.DataFrame(rows, columns=["payload", "place"])

    return read


def _first_marker(text: Column, markers, build: str, skip_empty: bool) -> Column:
    """What stands before (up to and with), or after, the first of the markers that the text has; NULL if none."""
    known = [F.lit(m) for m in markers if m or not skip_empty]
    if not known:
        return F.lit(None).cast("string")
    found = F.get(F.filter(F.array(*known), lambda m: F.contains(text, m)), F.lit(0))
    at = F.instr(text, found)
    if build == "cleaned":
        return F.concat(F.substr(text, F.lit(1), at - 1), found, F.lit(" [JSON removed]"))
    return F.substr(text, at + F.length(found) - int(build == "last"))


def classify(entries: DataFrame, rules: ParserRules) -> DataFrame:
    """text to kind, name, direction, request_id, endpoint, message, payload_json; events without a type go."""
    t, null = F.col("text"), F.lit(None).cast("string")
    sep, prefix, suffix, ask = rules.event_payload_separator, rules.command_prefix, rules.command_start_marker, rules.request_prefix
    emits = contains_any(t, rules.event_emit_markers) if sep else F.lit(False)
    receives = (contains_any(t, rules.event_receive_markers) if sep else F.lit(False)) & ~emits
    part = F.substring_index(t, sep, 1) if sep else t
    event = (emits | receives) & (F.contains(t, F.lit(sep)) if sep else F.lit(False))
    braces = F.concat(F.lit("{"), F.substring_index(F.substr(part, F.instr(part, "{") + 1), "}", 1), F.lit("}"))
    by_name = F.try_variant_get(F.try_parse_json(braces), "$.name", "variant")
    event_type = F.when(F.contains(part, F.lit('"name":')), F.when(by_name.isNotNull(), F.when(F.schema_of_variant(by_name) == "STRING", F.try_variant_get(F.try_parse_json(braces), "$.name", "string")).otherwise(""))).otherwise(F.nullif(F.regexp_extract(part, r'^[^"]*("[^"]*")', 1), F.lit("")))
    event_type = F.when(F.contains(part, F.lit('"name":')), event_type).otherwise(F.regexp_replace(event_type, '^"|"$', ""))
    after = F.substr(t, F.instr(t, prefix) + len(prefix)) if prefix else t
    command = (~emits & ~receives & F.contains(t, F.lit(prefix)) & F.contains(t, F.lit(suffix))) if prefix and suffix else F.lit(False)
    is_command = command & F.contains(after, F.lit(suffix)) if suffix else F.lit(False)
    tail = F.substr(t, F.instr(t, ask) + len(ask)) if ask else t
    request = (~emits & ~receives & ~command & F.contains(t, F.lit(ask))) if ask else F.lit(False)
    is_request = request & F.contains(tail, F.lit('"'))
    request_id = F.nullif(F.regexp_extract(F.substr(tail, F.instr(tail, '"') + 1), r"^ \[([^\] ]*--[^\] ]*)\]", 1), F.lit(""))
    mark = rules.request_endpoint_marker
    place = F.substr(t, F.instr(t, mark) + len(mark)) if mark else t
    endpoint = F.when(F.contains(t, F.lit(mark)) & F.contains(place, F.lit("]")), F.substring_index(place, "]", 1)) if mark else null
    kind = F.when(event, EVENT).when(is_command, COMMAND).when(is_request, REQUEST).otherwise(GENERIC)
    is_ = lambda k: F.col("kind") == k
    rows = barrier(entries.withColumn("kind", kind))
    rows = barrier(rows.withColumn("name", F.when(is_(EVENT), event_type).when(is_(COMMAND), F.substring_index(after, suffix, 1) if suffix else null).when(is_(REQUEST), F.substring_index(tail, '"', 1))))
    rows = rows.where(~is_(EVENT) | F.col("name").isNotNull())
    holder = (
        F.when(is_(EVENT), F.trim(F.substr(t, F.instr(t, sep) + len(sep)))) if sep else F.when(F.lit(False), t)
    ).when(is_(COMMAND), _first_marker(t, rules.command_payload_markers, "last", True)).when(is_(REQUEST), _first_marker(t, rules.request_payload_markers, "after", False)).otherwise(t)
    plain = barrier(rows.withColumn("holder", holder))
    plain = barrier(plain.withColumn("got", F.when(F.col("holder").isNotNull(), _payload_udf(rules.json_indicators)(F.col("holder")))))
    generic = F.when(F.col("got.payload").isNotNull() & (F.col("got.place") >= 0), F.concat(F.substr(t, F.lit(1), F.col("got.place")), F.lit("[JSON removed]")))
    said = {
        EVENT: F.concat(part, F.lit(f" {sep} [JSON removed]")), COMMAND: _first_marker(t, rules.command_payload_markers, "cleaned", True),
        REQUEST: _first_marker(t, (*rules.command_payload_markers, *rules.request_payload_markers), "cleaned", False), GENERIC: generic,
    }
    message = F.coalesce(F.when(is_(EVENT), said[EVENT]).when(is_(COMMAND), said[COMMAND]).when(is_(REQUEST), said[REQUEST]).otherwise(said[GENERIC]), t)
    direction = F.when(is_(EVENT), F.when(emits, "Emit").otherwise("Receive")).when(is_(REQUEST), F.when(contains_any(t, rules.request_receive_markers), "Receive").otherwise("Send"))
    own = F.coalesce(F.col("got.payload"), F.when(is_(GENERIC), F.col("own_payload")))
    return plain.select("*", message.alias("message"), direction.alias("direction"), F.when(is_(REQUEST), request_id).alias("request_id"), F.when(is_(REQUEST), endpoint).alias("endpoint"), own.alias("payload_json"))


def parse_entries(framed: DataFrame, fmt: str, rules: ParserRules, file_idx: int = 0, year: int | None = None, strict: bool = True) -> DataFrame:
    """Entries from framed raw text (file, source_line_number, raw_logline); what has no readable header goes."""
    rows = classify(barrier(_headers(framed, fmt, rules, year, strict).where("timestamp is not null"), apart=True), rules)
    rows = rows.withColumn("file_idx", F.lit(file_idx)).withColumn("seq", F.col("source_line_number"))
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ENTRY.fields])


def read_log(spark: SparkSession, path: str, profile: Profile | None = None, file_idx: int = 0, year: int | None = None, strict: bool = True) -> DataFrame:
    """One log file as entries. seq is the line an entry begins at: ascending, with gaps."""
    rules = (profile or Profile()).parser
    lines = read_lines(spark, path)
    fmt = rules.format
    if fmt == "auto":
        first = spark.read.text(path).where("trim(value) <> ''").limit(DETECT_LINES).collect()
        fmt = detect_format([r["value"] for r in first])
    if fmt == "json-lines":
        framed = lines.where("trim(text) <> ''").select("file", F.col("line").alias("source_line_number"), F.col("text").alias("raw_logline"))
    else:
        framed = frame(lines, F.rlike("text", F.lit(STARTS[fmt])))
    return parse_entries(framed, fmt, rules, file_idx, year, strict)


def read_logs(spark: SparkSession, paths: list[str], profile: Profile | None = None, year: int | None = None, strict: bool = True) -> DataFrame:
    """Several files as one timeline: order by schema.order() gives the merge."""
    parts = [read_log(spark, p, profile, i, year, strict) for i, p in enumerate(paths)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_sequence(entries: DataFrame) -> DataFrame:
    """seq from 0 without gaps inside each file, as contexts need it."""
    return numbered(entries.drop("seq"), ("file_idx",), "source_line_number", "seq").withColumn("seq", F.col("seq") - 1).select(entries.columns)


def detect_file(spark: SparkSession, path: str, profile: Profile | None = None) -> str:
    first = spark.read.text(path).where("trim(value) <> ''").limit(DETECT_LINES).collect()
    return detect_format([r["value"] for r in first], (profile or Profile()).parser.format)


def parse_text(spark: SparkSession, text: str, profile: Profile | None = None, line: int = 1) -> DataFrame:
    """One entry from its text."""
    profile = profile or Profile()
    fmt = detect_format(text.split("\n"), profile.parser.format)
    framed = spark.createDataFrame([("", line, text)], "file string, source_line_number long, raw_logline string")
    return parse_entries(framed, fmt, replace(profile.parser, format=fmt))
