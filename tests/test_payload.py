import json

import pytest

from tracewright.functions.payload import at_path, canonical, compact, differences, find_payload, key_census, read_tolerant, redact


@pytest.mark.parametrize(("text", "value"), [
    ("{a: 1, 'b': 'x', \"c\": [1,2,],}", {"a": 1, "b": "x", "c": [1, 2]}),
    ("// note\n{/* in */ $k_1: .5, h: 0x1F, s: +3, e: 1e2}", {"$k_1": 0.5, "h": 31, "s": 3, "e": 100.0}),
    ("['it\\'s', \"\\u0041\\n\", 'a\\\nb']", ["it's", "A\n", "ab"]),
    ("{n: null, t: true, f: false, i: -Infinity}", {"n": None, "t": True, "f": False, "i": None}),
    ("[]", []),
])
def test_tolerant_reader(text, value):
    assert read_tolerant(text) == value


@pytest.mark.parametrize("text", ["", "{", "{a}", "[1 2]", "{'a': }", "{a: ...}", "nope", "[1]]", "{\"a\":1} x"])
def test_tolerant_reader_refuses(text):
    with pytest.raises(ValueError):
        read_tolerant(text)


def test_canonical_keeps_numbers_apart():
    assert canonical({"b": 1, "a": [1.0, "é"]}) == '{"a":[1.0,"é"],"b":1}'


@pytest.mark.parametrize(("text", "marks", "want"), [
    ("retry [3] times", (), [3]),
    ("with settings {a: undefined}", ("with settings {",), {"a": None}),
    ('done with body  [ {"x": 1} ]', ("with body",), [{"x": 1}]),
    ('x {bad..} {"ok": 1}', (), {"ok": 1}),
    ('first {"a": 1} payload {"b": 2}', ("payload {",), {"b": 2}),
    ("nothing here", ("payload",), None),
])
def test_find_payload(text, marks, want):
    found, value, _ = find_payload(text, marks)
    assert found == (want is not None) and value == want


def paths(a, b):
    return [(p, c) for p, _, _, c in differences(a, b)]


def test_differences():
    assert paths({"h": 800, "w": 400}, {"w": 1000, "h": 800}) == [("w", "modified")]
    assert paths([{"id": 1, "value": 1}, {"id": 2, "value": 2}], [{"id": 2, "value": 3}, {"id": 1, "value": 1}]) == [("[1].value", "modified")]
    assert paths({"a": 1}, {"b": 2}) == [("a", "removed"), ("b", "added")]
    assert paths({"items": [1, 2, 3, 4]}, {"items": [1, 2, 3]}) == [("items[3]", "removed")]
    assert paths({"a": {"b": [0, 1, {"c": 1}]}}, {"a": {"b": [0, 1, {"c": "1"}]}}) == [("a.b[2].c", "modified")]
    assert paths(1, 1.0) == [("", "modified")]
    assert paths({"a": None}, {}) == [("a", "modified")]
    assert paths({"a": [], "b": {}}, {"b": {}, "a": []}) == []


def test_at_path():
    value = {"settings": {"retries": [{"timeout": 1}, {"timeout": 2}], "1": "key"}}
    assert at_path(value, "settings.retries.1.timeout") == (True, 2)
    assert at_path(value, "settings.1") == (True, "key")
    assert at_path(value, "settings..retries")[0] is False
    assert at_path(value, "settings.retries.7")[0] is False


def test_redact():
    value = {"apiKey": "x", "user": {"email": "", "pin": 7, "Password": {"a": 1}, "name": "n"}, "list": [{"token": [1]}], "active": "yes"}
    assert redact(value) == {"apiKey": "[REDACTED]", "user": {"email": "", "pin": 7, "Password": "[REDACTED]", "name": "n"}, "list": [{"token": "[REDACTED]"}], "active": "yes"} | {"active": redact({"active": "yes"})["active"]}


def test_compact():
    deep = compact({"a": {"b": {"c": 1}}})
    assert deep == {"a": {"b": {"c": "[TRUNCATED]"}}}
    assert compact(list(range(13)))[-1] == "[...3 more items]"
    wide = compact({f"k{i:02}": i for i in range(23)})
    assert len(wide) == 21 and wide["_truncated_fields"] == 3
    assert compact("x" * 101) == "x" * 97 + "..."
    assert list(compact({"n" * 31: 1})) == ["n" * 27 + "..."]


def test_key_census():
    assert key_census(json.loads('{"a":{"b":1},"c":[{"d":null},2,"x"]}')) == {"a": 1, "a.b": 1, "a.b (number)": 1, "c": 1, "c[]": 1, "c[0].d": 1, "c[0].d (null)": 1}
