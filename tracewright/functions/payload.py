"""JSON payloads: a tolerant reader, canonical text, and the recursive functions that Catalyst can't express.

Values are Python objects; text is canonical: sorted keys, no white space,
non-ASCII as it is, 1 and 1.0 distinct. The functions run as Arrow-batched UDFs
over whole columns.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


# --- tolerant reading ------------------------------------------------------

_SPACE = re.compile(r"(?:\s|//[^\n]*(?:\n|\Z)|/\*.*?\*/)*", re.S)
_NAME = re.compile(r"[A-Za-z_$ª-￿][\w$‌‍]*")
_NUMBER = re.compile(r"[+-]?(?:0[xX][0-9a-fA-F]+|Infinity|NaN|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)")
_ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "0": "\0"}


class _Reader:
    """Recursive descent over JSON with bare and single-quoted names, single quotes, trailing commas, comments and loose numbers."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def fail(self):
        raise ValueError(f"no JSON at {self.at}")

    def skip(self) -> str:
        self.at = _SPACE.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def document(self):
        value = self.value()
        if self.skip():
            self.fail()
        return value

    def value(self):
        ch = self.skip()
        if ch == "{":
            return self.members()
        if ch == "[":
            return self.items()
        if ch and ch in "\"'":
            return self.string(ch)
        for word, value in (("true", True), ("false", False), ("null", None)):
            if self.text.startswith(word, self.at):
                self.at += len(word)
                return value
        return self.number()

    def number(self):
        m = _NUMBER.match(self.text, self.at) or self.fail()
        self.at = m.end()
        text = m.group()
        sign, body = (-1 if text[0] == "-" else 1), text.lstrip("+-")
        if body[:2] in ("0x", "0X"):
            return sign * int(body, 16)
        if body in ("Infinity", "NaN"):
            return None  # as JSON text can't say them
        value = sign * (float(body) if any(c in body for c in ".eE") else int(body))
        return value if math.isfinite(value) else None

    def string(self, quote: str) -> str:
        out, self.at = [], self.at + 1
        while True:
            if self.at >= len(self.text):
                self.fail()
            ch = self.text[self.at]
            self.at += 1
            if ch == quote:
                return "".join(out)
            if ch == "\n":
                self.fail()
            if ch != "\\":
                out.append(ch)
                continue
            ch = self.text[self.at : self.at + 1]
            self.at += 1
            if ch in ("u", "x"):
                n = 4 if ch == "u" else 2
                out.append(chr(int(self.text[self.at : self.at + n], 16)))
                self.at += n
            elif ch != "\n":
                out.append(_ESCAPES.get(ch, ch))

    def items(self) -> list:
        out, self.at = [], self.at + 1
        while self.skip() != "]":
            out.append(self.value())
            if (ch := self.skip()) == ",":
                self.at += 1
            elif ch != "]":
                self.fail()
        self.at += 1
        return out

    def members(self) -> dict:
        out, self.at = {}, self.at + 1
        while (ch := self.skip()) != "}":
            if ch and ch in "\"'":
                key = self.string(ch)
            else:
                m = _NAME.match(self.text, self.at) or self.fail()
                key, self.at = m.group(), m.end()
            if self.skip() != ":":
                self.fail()
            self.at += 1
            out[key] = self.value()
            if (ch := self.skip()) == ",":
                self.at += 1
            elif ch != "}":
                self.fail()
        self.at += 1
        return out


def read_tolerant(text: str):
    """The value of a JSON or JSON5 text; ValueError if it is neither."""
    try:
        return json.loads(text)
    except ValueError:
        pass
    try:
        reader = _Reader(text)
        value = reader.document()
        json.dumps(value).encode()  # lone surrogates don't pass
        return value
    except (ValueError, RecursionError, UnicodeEncodeError) as e:
        raise ValueError(str(e)) from None


def balanced_end(text: str, start: int) -> int | None:
    """Past the bracket that closes the one at start; only double-quoted strings hide brackets."""
    depth, at, quoted = 0, start, False
    while at < len(text):
        ch = text[at]
        if quoted:
            if ch == "\\":
                at += 1
            elif ch == '"':
                quoted = False
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            depth += 1
        elif ch in "}]":
            depth -= 1
            if not depth:
                return at + 1
        at += 1
    return None


def payload_at(text: str, start: int):
    """(found, value) of the bracketed text at start, `undefined` read as null."""
    end = balanced_end(text, start)
    if end is None:
        return False, None
    try:
        return True, read_tolerant(text[start:end].replace("undefined", "null"))
    except ValueError:
        return False, None


_BRACKET = re.compile(r"[\[{]")


def find_payload(text: str, indicators: tuple[str, ...] = ()):
    """(found, value, place) of the first payload: after the indicators in their order, else at any bracket from the left."""
    for mark in indicators:
        at = text.find(mark) if mark else -1
        if at < 0:
            continue
        place = at + len(mark) - 1
        if text[place] not in "[{":
            m = _BRACKET.search(text, at + len(mark)) if mark.rstrip() == "with body" else None
            place = m.start() if m else -1
        if place >= 0:
            found, value = payload_at(text, place)
            if found:
                return True, value, place
    for m in _BRACKET.finditer(text):
        found, value = payload_at(text, m.start())
        if found:
            return True, value, m.start()
    return False, None, -1


# --- paths, differences, redaction, compaction, keys -----------------------

def at_path(value, path: str):
    """(found, value) at a dotted path; a number picks an array's element or an object's key."""
    for part in path.split("."):
        if not part:
            return False, None
        if isinstance(value, dict) and part in value:
            value = value[part]
        elif isinstance(value, list) and part.isascii() and part.isdigit() and int(part) < len(value):
            value = value[int(part)]
        else:
            return False, None
    return True, value


def differences(one, two, path: str = "") -> list[tuple[str, object, object, str]]:
    """(path, value1, value2, added/removed/modified) between two values. Key order doesn't count; a missing side is None.

    Arrays compare by place, but arrays of as many objects match each left
    element with the right one that differs least, the first of equals.
    """
    same = lambda a, b: canonical(a) == canonical(b)
    if isinstance(one, dict) and isinstance(two, dict):
        out = []
        for key in sorted(one.keys() | two.keys()):
            own = f"{path}.{key}" if path else key
            if key in one and key in two:
                out += differences(one[key], two[key], own)
            else:
                a, b = one.get(key), two.get(key)
                out.append((own, a, b, _change(a, b)))
        return out
    if isinstance(one, list) and isinstance(two, list):
        if one and len(one) == len(two) and all(isinstance(x, dict) for x in one + two):
            return _matched(one, two, path)
        out = []
        for i in range(max(len(one), len(two))):
            own = f"{path}[{i}]"
            if i < len(one) and i < len(two):
                out += differences(one[i], two[i], own)
            else:
                a, b = (one[i], None) if i < len(one) else (None, two[i])
                out.append((own, a, b, _change(a, b)))
        return out
    return [] if same(one, two) else [(path, one, two, _change(one, two))]


def _matched(one: list, two: list, path: str):
    out, free = [], list(range(len(two)))
    for i, left in enumerate(one):
        best = None
        for j in free:
            found = differences(left, two[j], f"{path}[{i}]")
            if best is None or len(found) < len(best[1]):
                best = (j, found)
            if not found:
                break
        free.remove(best[0])
        out += best[1]
    return out


def _change(a, b) -> str:
    return "added" if a is None and b is not None else "removed" if b is None and a is not None else "modified"


# Words that mark a key as sensitive wherever they stand in it.
SENSITIVE = (
    "password", "passwd", "pwd", "secret", "key", "token", "auth", "authorization", "session", "cookie", "credentials", "private",
    "confidential", "apikey", "api_key", "access_token", "refresh_token", "client_secret", "client_id", "user_id", "email", "phone",
    "address", "ssn", "credit_card", "card_number", "cvv", "pin", "hash", "signature", "encrypted", "cipher", "salt", "nonce", "iv",
    "certificate", "cert",
)


def redact(value):
    """Non-empty strings, objects and arrays under sensitive keys become [REDACTED]; values themselves aren't inspected."""
    if isinstance(value, list):
        return [redact(x) for x in value]
    if not isinstance(value, dict):
        return value
    out = {}
    for key, x in value.items():
        hot = any(word in key.lower() for word in SENSITIVE)
        out[key] = "[REDACTED]" if hot and (isinstance(x, (dict, list)) or (isinstance(x, str) and x)) else x if hot else redact(x)
    return out


def compact(value, most: int = 3, depth: int = 0):
    """A short form: limits on depth, keys, elements and lengths, each one marked where it cuts."""
    if depth >= most:
        return "[TRUNCATED]"
    if isinstance(value, dict):
        keys = sorted(value)
        out = {k if len(k) <= 30 else k[:27] + "...": compact(value[k], most, depth + 1) for k in keys[:20]}
        if len(keys) > 20:
            out["_truncated_fields"] = len(keys) - 20
        return out
    if isinstance(value, list):
        out = [compact(x, most, depth + 1) for x in value[:10]]
        return [*out, f"[...{len(value) - 10} more items]"] if len(value) > 10 else out
    if isinstance(value, str) and len(value) > 100:
        return value[:97] + "..."
    return value


def key_census(value, path: str = "") -> Counter:
    """How often each key path, array and typed scalar occurs in a value."""
    out: Counter = Counter()
    if isinstance(value, dict):
        for key, x in value.items():
            own = f"{path}.{key}" if path else key
            out[own] += 1
            out += key_census(x, own)
    elif isinstance(value, list):
        out[f"{path}[]"] += 1
        for i, x in enumerate(value):
            if isinstance(x, (dict, list)):
                out += key_census(x, f"{path}[{i}]")
    else:
        kind = "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string"
        out[f"{path} ({kind})"] += 1
    return out


# --- columns ----------------------------------------------------------------

def _each(column: pd.Series, f) -> pd.Series:
    """f over the values that aren't NULL; equal texts are read once a batch."""
    known: dict = {}
    out = []
    for text in column:
        if text is None or text != text:
            out.append(None)
            continue
        if text not in known:
            known[text] = f(text)
        out.append(known[text])
    return pd.Series(out, dtype=object)


# UDFs are made when they are called: a worker that imports this module has no session to parse types with.

def redact_json(column: Column | str) -> Column:
    """Payload text with redacted values."""

    def run(texts: pd.Series) -> pd.Series:
        return _each(texts, lambda t: canonical(redact(json.loads(t))))

    return F.pandas_udf(run, "string")(column)


def compact_json(column: Column | str) -> Column:
    """Payload text in its short form."""

    def run(texts: pd.Series) -> pd.Series:
        return _each(texts, lambda t: canonical(compact(json.loads(t))))

    return F.pandas_udf(run, "string")(column)


def json_keys(column: Column | str) -> Column:
    """Key paths of a payload, each as often as it occurs."""

    def run(texts: pd.Series) -> pd.Series:
        return _each(texts, lambda t: list(key_census(json.loads(t)).elements()))

    return F.pandas_udf(run, "array<string>")(column)


def json_differences(one: Column | str, two: Column | str) -> Column:
    """Differences of two payloads, values as canonical text; NULL unless both are there."""

    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(left, right, strict=True):
            if a is None or b is None:
                out.append(None)
            else:
                found = [] if a == b else differences(json.loads(a), json.loads(b))
                out.append([{"path": p, "value1": canonical(x), "value2": canonical(y), "change": c} for p, x, y, c in found])
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<struct<path:string,value1:string,value2:string,change:string>>")(one, two)


def value_at(path: str, column: Column | str) -> Column:
    """Canonical text of the value at a dotted path, NULL where there is none."""

    def pick(text: str) -> str | None:
        found, value = at_path(json.loads(text), path)
        return canonical(value) if found else None

    def run(texts: pd.Series) -> pd.Series:
        return _each(texts, pick)

    return F.pandas_udf(run, "string")(column)


def written(value, indent: int | None, level: int) -> str:
    """A value as reports write it, at a level of their indentation."""
    said = json.dumps(value, indent=indent, ensure_ascii=False)
    return said if indent is None else said.replace("\n", "\n" + " " * (indent * level))  # strings have no raw line feeds


def json_string(column: Column | str) -> Column:
    """A text as a JSON string."""

    def run(texts: pd.Series) -> pd.Series:
        return _each(texts, lambda t: json.dumps(t, ensure_ascii=False))

    return F.pandas_udf(run, "string")(column)


def json_written(column: Column | str, indent: int | None = None, level: int = 0) -> Column:
    """Canonical text as reports write it, at a level of their indentation."""

    def run(texts: pd.Series) -> pd.Series:
        return _each(texts, lambda t: written(json.loads(t), indent, level))

    return F.pandas_udf(run, "string")(column)


def differences_written(column: Column | str, indent: int | None = None, level: int = 0) -> Column:
    """What json_differences() gives, as reports write it."""

    def run(lists: pd.Series) -> pd.Series:
        said = lambda d: {"path": d["path"], "value1": json.loads(d["value1"]), "value2": json.loads(d["value2"]), "change_type": d["change"]}
        return pd.Series([written([said(d) for d in x], indent, level) for x in lists], dtype=object)

    return F.pandas_udf(run, "string")(column)


def packed(column: Column) -> Column:
    """A text in few bytes, as a driver that reads many of them holds them."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([zlib.compress(t.encode(), 1) for t in texts], dtype=object)

    return F.pandas_udf(run, "binary")(column)


def unpacked(data: bytes) -> str:
    return zlib.decompress(data).decode()


def packed_rows(df: DataFrame, each: int, said: Callable[[list[dict]], str]) -> DataFrame:
    """What said makes of some rows, each at most, in few bytes. The order in a partition stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, each):
                some = batch.slice(at, each).to_pylist(maps_as_pydicts="strict")
                yield pa.RecordBatch.from_pydict({"packed": pa.array([zlib.compress(said(some).encode(), 1)], pa.binary())})

    return df.mapInArrow(run, "packed binary")


def key_parts(key: str) -> dict:
    """component, level, kind and details of a comparison key, where it has them."""
    parts = key.split("|")
    named = dict(zip(("component", "level", "kind"), (p.strip() if i == 2 else p for i, p in enumerate(parts)), strict=False)) if len(parts) >= 3 else {}
    return named | ({"details": parts[3].strip() if len(parts) > 3 else ""} if named else {}) | {"raw_key": key}


def key_written(column: Column | str, names: dict[str, str], indent: int | None = None, level: int = 0) -> Column:
    """A comparison key's parts as reports write them, under other names where names has one."""

    def run(keys: pd.Series) -> pd.Series:
        return _each(keys, lambda t: written({names.get(k, k): x for k, x in key_parts(t).items()}, indent, level))

    return F.pandas_udf(run, "string")(column)
