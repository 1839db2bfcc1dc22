import datetime as dt

import pytest

from tests.entries import entry
from tracewright.cli import main
from tracewright.operators import perf
from tracewright.operators.filters import FilterError, LogFilter
from tracewright.operators.infer import infer_profile
from tracewright.operators.sessions import common_fields, completion, sessions
from tracewright.profile import ProfileError, builtin, load_profile, parse_profile, to_toml
from tracewright.render import LAYOUTS, coloured, compare_report, plural, preview
from tracewright.schema import ENTRY
from tracewright.sources.logs import detect_format, parse_fields, parse_text, read_log, read_logs, split_fields

EYES = builtin("eyes")


def one(spark, text, profile=EYES):
    rows = parse_text(spark, text, profile).collect()
    return rows[0] if rows else None


def head(message, cid="mgr-1/eyes-2"):
    return f"drv ({cid}) | 2026-01-01T00:00:01.500Z [WARN ] {message}"


def test_classic_header(spark):
    e = one(spark, "svc | 2026-01-01T00:00:00.000Z [INFO ] plain words")
    assert (e.component, e.component_id, e.level, e.message, e.kind, e.payload_json) == ("svc", "", "INFO", "plain words", "Generic", None)
    e = one(spark, head("switching", "a/b & c/d"))
    assert (e.component_id, e.level) == ("a/b & c/d", "WARN")
    assert e.timestamp == dt.datetime(2026, 1, 1, 0, 0, 1, 500000)


def test_events(spark):
    e = one(spark, head('Emit event of type "X.y" with payload {a: \'b\', c: undefined}'))
    assert (e.kind, e.name, e.direction, e.payload_json) == ("Event", "X.y", "Emit", '{"a":"b","c":null}')
    assert e.message == 'Emit event of type "X.y"  with payload [JSON removed]'
    e = one(spark, head('Received event of type {"name":"X.z"} with payload [1.0, 1]'))
    assert (e.name, e.direction, e.payload_json) == ("X.z", "Receive", "[1.0,1]")
    assert one(spark, head("Emit event of type none with payload {}")) is None
    assert one(spark, head('Emit event of type "X" and no more')).kind == "Generic"


def test_requests(spark):
    e = one(spark, head('Request "r" [0--id] will be sent to the address "[POST]http://h/p" with body {"k": [1]}'))
    assert (e.kind, e.name, e.request_id, e.endpoint, e.direction, e.payload_json) == ("Request", "r", "0--id", "POST", "Send", '{"k":[1]}')
    e = one(spark, head('Request "r" finished successfully with body [ {"a": 1} ]'))
    assert (e.request_id, e.direction, e.payload_json, e.message) == (None, "Receive", '[{"a":1}]', 'Request "r" finished successfully with body [JSON removed]')
    assert one(spark, head('Request "r" will be sent with body {"a":{ ... }}')).payload_json is None


def test_commands_and_base_profile(spark):
    e = one(spark, head('Command "c" is called with settings {x: 1}'))
    assert (e.kind, e.name, e.payload_json, e.message) == ("Command", "c", '{"x":1}', 'Command "c" is called with settings [JSON removed]')
    e = one(spark, head('Request "r" will be sent with body {"k": 1}'), builtin("base"))
    assert (e.kind, e.payload_json) == ("Generic", '{"k":1}')
    e = one(spark, head("retry [3] times"))
    assert (e.payload_json, e.message) == ("[3]", "retry [JSON removed]")


def test_tracing_syslog_json(spark):
    e = one(spark, "2026-03-10T08:15:30.123Z INFO app_x::a::b::c: did it trace_id=q1 n=2")
    assert (e.component, e.message, e.structured_fields, e.module_path) == ("b::c", "did it", {"trace_id": "q1", "n": "2"}, "app_x::a::b::c")
    e = one(spark, "2026-03-10T08:15:30Z host-a proc[42]: ERROR boom")
    assert (e.component, e.component_id, e.level, e.structured_fields["host"]) == ("proc", "42", "ERROR", "host-a")
    e = one(spark, '{"timestamp":"2026-03-10T08:15:30Z","level":"warn","target":"a::b::c","message":"m","session_id":"s","n":1,"payload":{"b":1,"a":2}}')
    assert (e.level, e.component, e.component_id, e.message, e.structured_fields, e.payload_json) == ("WARN", "b::c", "s", "m", {"session_id": "s", "n": "1"}, '{"a":2,"b":1}')
    assert one(spark, '{"timestamp": 5}') is None


def test_fields():
    assert split_fields('say "x" a="q \\"r\\"" b={c: [1, 2]} d=(x) e=f ') == ('say "x"', {"a": 'q "r"', "b": "{c: [1, 2]}", "d": "(x)", "e": "f"})
    assert split_fields("a=1 then words") == ("a=1 then words", {})
    assert parse_fields("k=") is None and parse_fields("a=1 a=2") == {"a": "2"}


def test_detect_format():
    tracing = "2026-03-10T08:15:30Z INFO app::x: hello"
    assert detect_format([tracing]) == "rust-tracing"
    assert detect_format(["2026-03-10T08:15:30Z h p[1]: x", "", "Mar 10 08:15:30 h p: x"]) == "syslog"
    assert detect_format(['{"a":1}']) == "json-lines"
    assert detect_format(["???"]) == "classic"
    assert detect_format([tracing], "syslog") == "syslog"


LINES = [
    "lost before the first entry",
    "a (manager-1/eyes-1) | 2026-01-01T00:00:00Z [INFO ] Command \"openEyes\" is called with settings {",
    "  size: 5,",
    "}",
    "dotted.name | 2026-01-01T00:00:01Z [INFO ] continuation",
    "b | 2026-01-01T00:00:02Z [ERROR] failed 123456789",
]


def test_framing_and_splits(spark, tmp_path):
    path = tmp_path / "x.log"
    path.write_bytes(("\r\n".join(LINES) + "\r\n").encode())
    got = read_log(spark, str(path), EYES).orderBy("source_line_number").collect()
    assert [(e.source_line_number, e.component) for e in got] == [(2, "a"), (6, "b")]
    assert got[0].payload_json == '{"size":5}' and "\r" not in got[0].raw_logline and got[0].raw_logline.endswith("continuation")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        again = read_log(spark, str(path), EYES).orderBy("source_line_number").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert again == got


def test_last_start_wins_and_percentiles(spark):
    rows = [entry(i, "Request", "r", d, "0--1") for i, d in enumerate(["Send", "Send", "Receive", "Receive", "Send"])]
    paired = perf.steps(spark.createDataFrame(rows, ENTRY))
    assert [r.duration_ms for r in perf.operations(paired).collect()] == [1000]
    assert perf.orphans(paired).count() == 1
    ops = spark.createDataFrame([("Request", "x", d) for d in (1, 2, 3, 4)], "op_type string, name string, duration_ms long")
    assert perf.stats(ops).first().p50_duration_ms == 3


def test_commands_pair_only_with_completions(spark):
    rules = builtin("service-api").perf
    rows = [entry(0, "Command", "c", message="Operation begin", cid="s"), entry(1, "Command", "c", message="Operation finished", cid="s")]
    df = spark.createDataFrame(rows, ENTRY)
    assert perf.tracks_commands(df, rules) and not perf.tracks_commands(df.limit(0), rules)
    assert [r.duration_ms for r in perf.operations(perf.steps(df, rules, commands=True)).collect()] == [1000]


def test_event_keys(spark):
    payloads = ['{"id":5,"key":"k"}', '{"traceId":"t","key":"k"}', "[1]", None, '{"key":1.5}']
    df = spark.createDataFrame([(p,) for p in payloads], "payload_json string").select(perf.event_key(perf.PerfRules()).alias("k"))
    assert [r.k for r in df.collect()] == ["k", "t", None, None, None]


def test_filter_grammar():
    for bad in ("nocolon", "level:", "direction:sideways"):
        with pytest.raises(FilterError):
            LogFilter.parse(bad)
    f = LogFilter.parse("comp:a !l:b 'x y':z t:\"p q\"")
    assert [(t.kind, t.exclude) for t in f.terms] == [("component", False), ("level", True), ("field", False), ("text", False)]
    assert f.terms[3].value == '"p q"' and LogFilter.parse("").is_empty
    assert LogFilter.parse("l:verbose").warnings() == ["unknown level verbose"]


def test_profiles(tmp_path):
    assert builtin("Config/EYES.toml").levels[0].complete_commands == ("getResults", "closeBatch")
    with pytest.raises(ProfileError):
        builtin("nope")
    path = tmp_path / "p.toml"
    path.write_text(to_toml(EYES, "two\nlines"))
    assert load_profile(str(path)) == EYES
    assert parse_profile('[parser]\nformat = "current"').parser.format == "classic"
    for bad in ("x = [", '[parser]\nformat = "odd"'):
        with pytest.raises(ProfileError):
            parse_profile(bad)


def test_text_helpers():
    assert (plural(1, "session"), plural(2, "session"), preview(list("abcdefg")), preview(["a"])) == ("1 session", "2 sessions", "a, b, c, d, e and 2 more", "a")
    assert coloured("[INFO ] x\n████ █") == "\x1b[32m[INFO ]\x1b[0m x\n\x1b[31m████\x1b[0m \x1b[32m█\x1b[0m"


def test_sessions(spark):
    rows = [
        entry(0, "Command", "makeManager", payload='{"concurrency":5,"batch":{"id":"b"}}', cid="manager-1"),
        entry(1, "Command", "openEyes", payload="{}", cid="manager-1/eyes-1"),
        entry(2, "Generic", None, cid="manager-1/eyes-1/check-7"),
        entry(3, "Command", "close", cid="manager-1/eyes-1"),
        entry(4, "Command", "closeBatch", cid="manager-1"),
    ]
    table = sessions(spark.createDataFrame(rows, ENTRY), EYES.levels)
    got = {r.session_id: r for r in table.collect()}
    assert got["eyes-1"].parent == "manager-1" and got["eyes-1"].created_via == "openEyes" and got["eyes-1"].completed_via == "close" and got["eyes-1"].entry_count == 3
    assert got["manager-1"].completed_via == "closeBatch" and got["manager-1"].summary == {"concurrency": "5", "batch.id": '"b"'}
    assert {r.level: r.completed for r in completion(table).collect()} == {"manager": 1, "eyes": 1}
    assert {(r.field, r.value) for r in common_fields(table).collect()} == {("concurrency", "5"), ("batch.id", '"b"')}


def test_inference(spark):
    rows = [entry(i, "Request", f"q{i % 2}", cid=c, component="w") for i, c in enumerate(["manager-1/eyes-1", "manager-2/eyes-1", "manager-3", "task-1"])]
    p = infer_profile(spark.createDataFrame(rows, ENTRY), detected={"classic"})
    assert [x.segment_prefix for x in p.levels] == ["manager-", "eyes-"] and p.profile.known_requests == ("q0", "q1") and p.parser.format == "classic"
    modules = spark.createDataFrame(rows, ENTRY).selectExpr("* except (module_path)", "case when seq = 0 then 'shop_front::a' else 'shop_core' end as module_path")
    p = infer_profile(modules)
    assert (p.parser.module_depth, p.parser.module_strip_prefix) == (2, "shop_")


@pytest.fixture
def files(tmp_path):
    a, b = tmp_path / "a.log", tmp_path / "b.log"
    line = lambda s, text, cid="manager-1/eyes-1", level="INFO ": f"svc ({cid}) | 2026-01-01T00:00:{s:02}Z [{level}] {text}"
    a.write_text("\n".join([line(5, 'Request "q" [0--1] finished successfully with body {"v": 2}'), line(6, "failed 1234567", level="ERROR")]))
    b.write_text("\n".join([line(1, 'Request "q" [0--1] will be sent with body {"v": 1}'), line(2, 'Request "q" [0--2] will be sent with body {"v": 1}'), line(6, "failed 7654321", level="ERROR")]))
    return str(a), str(b)


def run(capsys, *args):
    code = main(list(args))
    return code, capsys.readouterr().out


def test_command_line(spark, files, capsys, tmp_path):
    a, b = files
    import json

    assert read_logs(spark, [a, b], EYES).count() == 5
    code, out = run(capsys, "perf", a, b, "--preset", "eyes", "-j")
    data = json.loads(out)
    assert code == 0 and [o["duration_ms"] for o in data["operations"]] == [4000] and len(data["orphans"]) == 1
    data = json.loads(run(capsys, "errors", a, b, "--preset", "eyes", "-j")[1])["errors"]
    assert data["clusters_total"] == 1 and data["clusters"][0]["count"] == 2 and data["clusters"][0]["affected_sessions"][0]["outcome"] == "orphaned"
    data = json.loads(run(capsys, "search", b, "--preset", "eyes", "-f", "l:error", "--context", "1", "-j")[1])["search"]
    assert [e["is_match"] for e in data["entries"]] == [False, True]
    data = json.loads(run(capsys, "trace", a, b, "--id", "0--1", "--preset", "eyes", "-j")[1])["trace"]
    assert (data["count"], data["total_duration_ms"]) == (2, 4000)
    data = json.loads(run(capsys, "extract", b, "--field", "v", "--preset", "eyes", "-j")[1])["extract"]
    assert data["groups"] == [{"value": 1, "count": 2}] and data["missing_payload"] == 1
    data = json.loads(run(capsys, "diff", b, b, "--preset", "eyes", "-j")[1])
    assert data["summary"]["has_differences"] is False
    assert '[1] {"v":1}' in run(capsys, "compare", b, b, "--preset", "eyes", "--full", "-v")[1]
    one = read_log(spark, b, EYES)
    for layout in LAYOUTS:
        report = compare_report(one, one, LogFilter(), layout=layout).data
        assert len(report["comparisons"]) == 1 and report["summary"]["unique_to_log1_count"] == 0
    data = json.loads(run(capsys, "process", b, "--preset", "eyes", "--limit", "2", "-j")[1])
    assert data["metadata"]["filtered_entries"] == 3 and len(data["logs"]) == 2
    assert "svc" in run(capsys, "info", a, "--preset", "eyes", "-s", "-t", "-p", "--json-schema")[1]
    out = tmp_path / "p.toml"
    assert run(capsys, "generate-config", a, b, "-o", str(out))[0] == 0 and parse_profile(out.read_text()).profile.known_components == ("svc",)
    assert run(capsys, "search", b, "-f", "broken")[0] == 1
    assert "\x1b[31m[ERROR]\x1b[0m" in run(capsys, "search", b, "--preset", "eyes", "--color", "always")[1] and "\x1b" not in run(capsys, "search", b, "--preset", "eyes")[1]
