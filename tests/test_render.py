"""Reports are written in pieces: what grows with a log is never held whole."""

import json
import os

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tests.entries import entry
from tracewright import render
from tracewright.plans import files, queries
from tracewright.operators.filters import LogFilter
from tracewright.profile import Profile
from tracewright.schema import ENTRY

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("indent", [None, 2])
def test_pieces_equal_json_of_the_whole(indent):
    count = [0]

    def items():
        for i in range(3):
            count[0] += 1
            yield {"i": i, "said": 'a\n"é', "empty": [], "inner": {"x": [1, {"y": {}}]}}

    report = {"a": {"items": render.Streamed(items), "count": lambda: count[0], "none": render.Streamed(lambda: ())}, "b": [1, 2], "c": {}}
    pieces = list(render.json_pieces(report, indent))
    assert "".join(pieces) == json.dumps(render.whole(report | {"a": report["a"] | {"count": 3}}), indent=indent, ensure_ascii=False)
    assert len(pieces) > 6


def test_spool_keeps_lines_in_order_beyond_memory(monkeypatch):
    monkeypatch.setattr(render.Spool, "MOST", 100)
    spool = render.Spool()
    for i in range(200):
        spool.add(i % 3, f"é {i}")
    assert spool.file is not None
    assert [list(spool.lines(k)) for k in spool.names()] == [[f"é {i}" for i in range(200) if i % 3 == k] for k in range(3)]


def _collected(monkeypatch):
    """How many rows collect() brings to the driver, call by call."""
    sizes = []
    for kind in {DataFrame, *DataFrame.__subclasses__()}:
        if "collect" in vars(kind):
            real = vars(kind)["collect"]
            monkeypatch.setattr(kind, "collect", lambda self, real=real: sizes.append(real(self)) or sizes[-1])
    return sizes


def test_reports_collect_no_list_of_entries(spark, monkeypatch):
    rows = []
    for i in range(40):
        rows += [entry(2 * i, "Request", "r", "Send", f"id{i}", payload=f'{{"k":{i}}}'), entry(2 * i + 1, "Request", "r", "Receive", f"id{i}", payload=f'{{"k":{i}}}')]
    rows += [entry(100 + i, "Generic", None, message=f"only {i}", payload="{}") for i in range(40)]
    one = spark.createDataFrame(rows, ENTRY)
    two = spark.createDataFrame([(*r[:-1], '{"k":-1}') for r in rows[:60]], ENTRY)
    sizes = _collected(monkeypatch)
    report = render.perf_report(one, Profile(), LogFilter())
    data = json.loads("".join(report.json_pieces()))
    assert len(data["operations"]) == 40
    report.close()
    for layout in render.LAYOUTS:
        report = render.compare_report(one, two, LogFilter(), layout=layout)
        data = json.loads("".join(report.json_pieces()))
        names = ("instances", "json_differences") if layout == "standard" else ("instances", "differences") if layout == "readable" else ("i", "d")
        assert sum(len(c[names[0]]) for c in data["comparisons"]) == 60
        assert len(data["unique_to_log1"]) == data["summary"]["unique_to_log1_count"] == 60  # 20 surplus occurrences, 40 messages
        assert len(report.text.splitlines()) == 1 + 2 * len(data["comparisons"])
        report.close()
    assert sizes
    assert max(map(len, sizes)) <= 2


def test_pairs_reach_the_driver_in_blocks(spark, monkeypatch):
    one = spark.createDataFrame([entry(i, "Request", "r", "Send", payload=f'{{"k":{i},"s":"é"}}') for i in range(300)], ENTRY)
    two = spark.createDataFrame([entry(i, "Request", "r", "Send", payload=f'{{"k":{i + 1},"s":[{{}}]}}') for i in range(300)], ENTRY)
    seen = []
    for kind in {DataFrame, *DataFrame.__subclasses__()}:
        if "toLocalIterator" in vars(kind):
            real = vars(kind)["toLocalIterator"]
            monkeypatch.setattr(kind, "toLocalIterator", lambda self, *a, real=real, **k: (seen.append(r) or r for r in real(self, *a, **k)))
    report = render.compare_report(one, two, LogFilter())
    found = json.loads("".join(report.json_pieces()))["comparisons"]
    assert [(x["log1_index"], x["diff_count"]) for x in found[0]["instances"]] == [(i + 1, 2) for i in range(300)]
    assert found[0]["instance_count"] == 300
    assert found[0]["differences"] == [
        {"path": "k", "value1": list(range(300)), "value2": list(range(1, 301)), "indexes": [[i, i] for i in range(1, 301)]},
        {"path": "s", "value1": ["é"] * 300, "value2": [[{}]] * 300, "indexes": [[i, i] for i in range(1, 301)]},
    ]
    assert len(seen) == -(-300 // render.compare.PAIRS) + 2 * 3 * -(-300 // render.compare.DIFFERING)
    text = report.text.splitlines()
    assert text[2] == "    k: " + "; ".join(f"{i} -> {i + 1}" for i in range(300))
    report.close()


def test_instances_are_read_as_a_report_goes_by(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files.Instances, "SIZE", 300)
    monkeypatch.setattr(files.Instances, "ROWS", 7)
    deep = [{"l1": 9, "dc": 9, "r": "no"}]
    told = lambda k: {"k": {"r": f"{k}\n\"é"}, "i": [{"l1": i, "t1": None, "dc": i % 3} for i in range(1, 11)], "d": [{"p": "x", "v1": deep, "v2": [deep], "i": [[1, 1]]}]}
    out = files.Instances(spark, str(tmp_path / "rows"))
    for text in render.json_pieces({"unique_to_log1": [{"i": 0, "r": "no"}], "comparisons": render.Streamed(lambda: map(told, range(3)))}):
        for at in range(0, len(text), 50):
            out.write(text[at : at + 50])
            assert len(out.rows[0]) < 7
            assert sum(map(len, out.pieces)) <= 350
    out.write("\n")
    assert sorted(map(tuple, out.table().collect())) == [(f'{k}"é', i, i % 3) for k in range(3) for i in range(1, 11)]


def test_only_the_first_line_is_kept():
    out = files.FirstLine()
    for text in ("only in ", "the first: 1\n[FILE1]", " x\n", "y"):
        out.write(text)
    assert out.line == "only in the first: 1"


def test_instances_on_one_line_are_read_as_a_report_goes_by(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files.OneLine, "SIZE", 300)
    monkeypatch.setattr(files.OneLine, "ROWS", 7)
    odd = {"key": {"raw_key": 'no, "instances": ["'}, "instances": [{"log1_index": 9, "diff_count": 9}]}
    differences = [{"path": 'a"]}, {"key": {"', "value1": [odd, "]"], "value2": odd, "change_type": "modified"}]
    told = lambda k: {"key": {"details": 'é "instances": [', "raw_key": f'{k}\n"é'}, "instances": [{"log1_index": i, "text1": None, "diff_count": i % 3, "json_differences": differences} for i in range(1, 11)], "instance_count": 10}
    report = {"unique_to_log1": [{"index": 0, "raw_key": '{"key": {"raw_key": "no"}'}], "comparisons": render.Streamed(lambda: map(told, range(3)))}
    text = "".join(render.json_pieces(report, None))
    for step in (1, 50):
        out = files.OneLine(spark, str(tmp_path / f"rows{step}"))
        for at in range(0, len(text), step):
            out.write(text[at : at + step])
            assert len(out.rows[0]) < 7
            assert sum(map(len, out.pieces)) <= 1300  # an instance has some 500 characters
        out.write("\n")
        assert sorted(map(tuple, out.table().collect())) == [(f'{k}"é', i, i % 3) for k in range(3) for i in range(1, 11)]
    out = files.OneLine(spark, str(tmp_path / "cut"))
    out.write(text[: text.rindex('"log1_index"')])
    with pytest.raises(ValueError, match="midway"):
        out.table()


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
def test_llm_diff_query_holds_no_report(spark, monkeypatch):
    def held(*_):
        raise AssertionError("a report is held whole")

    monkeypatch.setattr(files, "_said", held)
    assert queries.queries()["cli_llm_diff"](spark, SMALL).count() > 0


def test_trace_reaches_the_driver_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(render, "TRACED", 16)
    log = spark.createDataFrame([entry(i, "Request", "r", "Send", f"id{i}", message=f'a\n"é" {i}', cid="s-1" if i % 2 else "s-2") for i in range(200, 0, -1)], ENTRY)
    sizes = _collected(monkeypatch)
    report = render.trace_report(log.withColumn("structured_fields", F.create_map(F.lit("b"), F.lit("é"), F.lit("a"), F.lit(None).cast("string"))), None, "s-1", LogFilter())
    data = json.loads("".join(report.json_pieces()))["trace"]
    assert (data["count"], data["total_duration_ms"]) == (100, 198_000)
    assert [(e["source_line_number"], e["delta_ms"], e["elapsed_ms"]) for e in data["entries"]] == [(i + 1, 2000 if i > 1 else 0, 1000 * (i - 1)) for i in range(1, 200, 2)]
    assert list(data["entries"][0]) == [*render._SHOWN, "delta_ms", "elapsed_ms", "request_id"]
    assert data["entries"][0]["structured_fields"] == {"b": "é", "a": None}
    assert data["entries"][0]["timestamp"] == "2026-01-01T00:00:01.000Z"
    assert "".join(report.json_pieces()) == json.dumps({"trace": data}, indent=2, ensure_ascii=False)
    assert "".join(report.json_pieces(None)) == json.dumps({"trace": data}, ensure_ascii=False)
    lines = report.text.splitlines()
    assert lines[1] == '+2000ms (2000ms)      4 2026-01-01T00:00:03.000Z [INFO] c (s-1): a\\n"é" 3'
    assert (len(lines), lines[-1]) == (101, "100 entries, 198000 ms")
    assert max(map(len, sizes)) <= 2
    none = render.trace_report(log, "nobody", None, LogFilter())
    assert json.loads("".join(none.json_pieces()))["trace"] == {"selector": {"type": "id", "value": "nobody", "match_mode": "contains"}, "count": 0, "total_duration_ms": 0, "entries": []}
    assert none.text == "0 entries, 0 ms"


def test_entries_are_read_as_a_trace_goes_by(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files.Entries, "SIZE", 300)
    monkeypatch.setattr(files.Entries, "ROWS", 7)
    told = lambda i: {"source_line_number": i, "message": '\n        "delta_ms": 9', "structured_fields": {"delta_ms": "9", "source_line_number": "9"}, "delta_ms": i % 3, "elapsed_ms": 10 * i}
    out = files.Entries(spark, str(tmp_path / "rows"))
    for text in render.json_pieces({"trace": {"count": 30, "entries": render.Streamed(lambda: map(told, range(30)))}}):
        out.write(text)
        assert len(out.rows[0]) < 7
        assert sum(map(len, out.pieces)) <= 600
    out.write("\n")
    assert sorted(map(tuple, out.table().collect())) == [(i, i % 3, 10 * i) for i in range(30)]
