"""Renderers: reports as dictionaries for JSON, and as plain text. Lists that grow with a log are streamed into what is written; the operators stay lazy."""

from __future__ import annotations

import itertools
import json
import re
import tempfile
from collections.abc import Callable, Iterable, Iterator
from functools import cache, cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.payload import differences_written, json_string, json_written, key_parts, key_written, packed, packed_rows, unpacked, written
from tracewright.functions.text import component_label, iso_millis, log_key, truncated
from tracewright.operators import compare, errors, export, info, perf, search, sessions, trace
from tracewright.operators.filters import LogFilter
from tracewright.profile import Profile
from tracewright.schema import TIMELINE
from tracewright.session import settled


def plain(value):
    """Rows, dates and nested values as JSON can say them."""
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if hasattr(value, "isoformat"):
        return value.isoformat(timespec="milliseconds") + "Z"
    return value


def rows(df: DataFrame) -> list[dict]:
    return [plain(r) for r in df.collect()]


def streamed_rows(df: DataFrame) -> Iterator[dict]:
    """rows(), a partition at a time."""
    return (plain(r) for r in df.toLocalIterator())


class Streamed:
    """A list in a report whose items are made as they are written. A report may also have functions for values, called when their turn comes.

    indented: make is told the indentation, for items that are texts already.
    """

    def __init__(self, make: Callable[..., Iterable], indented: bool = False):
        self.make, self.indented = make, indented

    def items(self, indent: int | None) -> Iterable:
        return self.make(indent) if self.indented else self.make()


class Said:
    """Some items of a Streamed list as JSON text, with what stands between them, indented as in a list that stands alone."""

    def __init__(self, text: str):
        self.text = text


def whole(value):
    """A value of a report with all that it streams."""
    if callable(value):
        return whole(value())
    if isinstance(value, Streamed):
        return [x for own in value.items(None) for x in (json.loads(f"[{own.text}]") if isinstance(own, Said) else [whole(own)])]
    return {k: whole(v) for k, v in value.items()} if isinstance(value, dict) else value


def json_pieces(value, indent: int | None = 2, level: int = 0) -> Iterator[str]:
    """What json.dumps gives of whole(value), in pieces."""
    if callable(value):
        yield from json_pieces(value(), indent, level)
    elif isinstance(value, Said):
        yield value.text if indent is None else value.text.replace("\n", "\n" + " " * (indent * (level - 1)))
    elif isinstance(value, Streamed) or (isinstance(value, dict) and any(callable(v) or isinstance(v, (Streamed, dict)) for v in value.values())):
        named = isinstance(value, dict)
        edge = "" if indent is None else "\n" + " " * (indent * level)
        inner = "" if indent is None else edge + " " * indent
        yield "{" if named else "["
        some = False
        for x in value.items() if named else value.items(indent):
            yield ("," + (inner or " ") if some else inner) + (json.dumps(x[0], ensure_ascii=False) + ": " if named else "")
            yield from json_pieces(x[1] if named else x, indent, level + 1)
            some = True
        yield (edge if some else "") + ("}" if named else "]")
    else:
        said = json.dumps(value, indent=indent, ensure_ascii=False)
        yield said if indent is None else said.replace("\n", "\n" + " " * (indent * level))  # strings have no raw line feeds


def to_json(report: dict, indent: int | None = 2) -> str:
    return "".join(json_pieces(report, indent))


class Spool:
    """Lines under names, in the order they came: in memory up to MOST characters, beyond in a temporary file."""

    MOST = 4 << 20

    def __init__(self):
        self.held: dict = {}
        self.places: dict = {}
        self.size, self.file = 0, None

    def add(self, name, line: str) -> None:
        self.places.setdefault(name, [])
        self.held.setdefault(name, []).append(line)
        self.size += len(line) + 8
        if self.size > self.MOST:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.seek(0, 2)
            for name, lines in self.held.items():
                data = "".join(x + "\n" for x in lines).encode("utf-8", "surrogatepass")
                self.places[name].append((self.file.tell(), len(data)))
                self.file.write(data)
            self.held, self.size = {}, 0

    def names(self) -> list:
        return list(self.places)

    def lines(self, name) -> Iterator[str]:
        for at, n in self.places.get(name, ()):
            self.file.seek(at)
            yield from self.file.read(n).decode("utf-8", "surrogatepass").split("\n")[:-1]
        yield from self.held.get(name, ())


class Report:
    """A report as a dictionary and as text; either may be a function, so that only what is asked for is collected. Text may also be pieces of it, one after the other.

    done is called once nothing more will be asked for.
    """

    def __init__(self, data, text, done: Callable[[], object] | None = None):
        self._data, self._text, self._done = data, text, done

    @cached_property
    def data(self) -> dict:
        return whole(self._data)

    @cached_property
    def text(self) -> str:
        return "".join(self.text_pieces())

    def json_pieces(self, indent: int | None = 2) -> Iterator[str]:
        return json_pieces(self._data, indent)

    def text_pieces(self) -> Iterable[str]:
        said = self._text() if callable(self._text) else self._text
        return [said] if isinstance(said, str) else said

    def close(self) -> None:
        if self._done:
            self._done()


def _table(items: list[dict], columns: list[str]) -> str:
    cells = [columns, *[["" if x.get(c) is None else str(x[c]) for c in columns] for x in items]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in cells)


#: Terminal colours: of levels, and of a share of the most from low to high.
LEVEL_TINTS = {"ERROR": 31, "FATAL": 31, "WARN": 33, "WARNING": 33, "INFO": 32, "DEBUG": 36, "TRACE": 90}
SHARE_TINTS = ((0.75, 31), (0.5, 33), (0.25, 32), (0.0, 34))


def tint(text: str, colour: int | None) -> str:
    return text if colour is None else f"\x1b[{colour}m{text}\x1b[0m"


def coloured(text: str) -> str:
    """A report's text with its levels and bars in colour."""
    text = re.sub(r"\[(\w+) *\]", lambda m: tint(m[0], LEVEL_TINTS.get(m[1])), text)
    longest = max(map(len, re.findall("█+", text)), default=1)
    return re.sub("█+", lambda m: tint(m[0], next(c for share, c in SHARE_TINTS if len(m[0]) >= share * longest)), text)


def plural(n: int, word: str) -> str:
    return f"{n} {word}" if n == 1 else f"{n} {word}s"


def preview(names: list[str], most: int = 5) -> str:
    """The first few names, and how many there are beyond."""
    rest = len(names) - most
    return ", ".join(names[:most]) + (f" and {rest} more" if rest > 0 else "")


_SHOWN = (
    "source_line_number", "timestamp", "component", "component_id", "level", "kind", "log_key", "message", "raw_logline", "module_path", "structured_fields",
)


def _line(e: dict) -> str:
    label = e["component"] + (f" ({e['component_id']})" if e["component_id"] else "")
    return f"{e['source_line_number']:>6} {e['timestamp']} [{e['level']}] {label}: " + e["message"].replace("\n", "\\n")


def search_report(entries: DataFrame, wanted: LogFilter, file: str, context: int = 0, payloads: bool = False, by: str | None = None) -> Report:
    matches = wanted.apply(entries).count()
    if by:
        groups = rows(search.count_by(entries, wanted, by))
        return Report({"search": {"file": file, "matches": matches, "count_by": by, "groups": groups}}, f"Matches: {matches}\n" + _table(groups, ["count", "key"]))
    shown = search.with_context(entries, wanted, context).withColumn("log_key", log_key()).withColumn("timestamp", iso_millis(F.col("timestamp"))).orderBy("seq")
    found = rows(shown.select(*_SHOWN, "is_match", "new_chunk", F.col("payload_json").alias("payload")))
    lines = []
    for e in found:
        if e.pop("new_chunk") and context:
            lines.append("--")
        e["payload"] = json.loads(e["payload"]) if payloads and e["payload"] is not None else None
        lines.append(("> " if e["is_match"] else "  ") + _line(e))
        if e["payload"] is not None:
            lines.append("    " + json.dumps(e["payload"], ensure_ascii=False))
    return Report({"search": {"file": file, "matches": matches, "context": context, "show_payloads": payloads, "entries": found}}, "\n".join([*lines, f"Matches: {matches}"]))


def extract_report(entries: DataFrame, wanted: LogFilter, file: str, path: str) -> Report:
    groups = [{"value": json.loads(g["value"]), "count": g["count"]} for g in rows(search.extract(entries, wanted, path))]
    data = {"file": file, "field": path, **rows(search.extract_summary(entries, wanted, path))[0], "groups": groups}
    text = f"{data['extracted']} of {data['matches']} entries have {path}; without payload: {data['missing_payload']}, without field: {data['missing_field']}\n"
    return Report({"extract": data}, text + _table([{**g, "value": json.dumps(g["value"], ensure_ascii=False)} for g in groups], ["count", "value"]))


#: Entries of a trace that reach the driver at once.
TRACED = 256


def trace_report(entries: DataFrame, identifier: str | None, session: str | None, wanted: LogFilter) -> Report:
    """Executors write the texts of entries, in their order."""
    traced = trace.trace(entries, identifier, session, wanted)
    selector = {"type": "id" if identifier is not None else "session", "value": identifier if identifier is not None else session, "match_mode": "contains"}
    totals = cache(lambda: rows(trace.trace_summary(traced))[0])

    def blocks(said: Callable[[list[dict]], str]) -> Iterator[str]:
        parts = 1 + totals()["count"] // 16_384
        shown = compare.in_order(traced, parts, *TIMELINE).withColumn("timestamp", iso_millis(F.col("timestamp"))).select(*_SHOWN, "delta_ms", "elapsed_ms", "request_id")
        return (unpacked(r["packed"]) for r in settled(packed_rows(shown, TRACED, said)).toLocalIterator())

    def data():
        said = lambda indent: lambda found: _between(indent).join(written(e, indent, 1) for e in found)
        found = Streamed(lambda indent: map(Said, blocks(said(indent))), True)
        return {"trace": {"selector": selector, "count": totals()["count"], "total_duration_ms": totals()["total_duration_ms"], "entries": found}}

    def text():
        for some in blocks(lambda found: "".join(f"+{e['delta_ms']}ms ({e['elapsed_ms']}ms) {_line(e)}\n" for e in found)):
            yield some
        yield f"{totals()['count']} entries, {totals()['total_duration_ms']} ms"

    return Report(data, text)


def errors_report(entries: DataFrame, profile: Profile, wanted: LogFilter, top: int = 10, warn: bool = False, show_sessions: bool = False, by: str = "count") -> Report:
    commands = perf.tracks_commands(entries, profile.perf)
    impacts = errors.impacts(wanted.apply(entries), warn, profile.perf, commands).cache()
    clusters = errors.clusters(impacts)
    total = clusters.count()
    first = errors.sort_clusters(clusters, by, top)
    shown = rows(first)
    hit = errors.affected(impacts, first if top else None).orderBy("severity", "pattern", *errors.session_order())
    by_cluster: dict[tuple, list] = {}
    for x in rows(hit.drop("outcome_rank")):
        by_cluster.setdefault((x.pop("severity"), x.pop("pattern")), []).append(x)
    for c in shown:
        c["affected_sessions"] = by_cluster.get((c["severity"], c["pattern"]), [])
    s = rows(errors.summary(impacts))[0]
    impacts.unpersist()
    longest = {"severity": s["longest_severity"], "pattern": s["longest_pattern"], "session_path": s["longest_session"], "duration_ms": s["longest_blocking_ms"]} if s["longest_session"] else None
    summary = {k: s[k] for k in ("total", "errors", "warnings", "patterns", "sessions")} | {"longest_blocking": longest}
    data = {"summary": summary, "options": {"top_n": top, "show_sessions": show_sessions, "sort_by": by}, "clusters_total": total, "clusters_displayed": len(shown), "clusters": shown}
    lines = [f"{s['total']} entries ({s['errors']} errors, {s['warnings']} warnings), {s['patterns']} patterns, {s['sessions']} sessions"]
    for c in shown:
        lines.append(f"[{c['severity']}] x{c['count']} {c['pattern']}  ({preview(c['components'])}; {plural(c['affected_sessions_count'], 'session')})")
        if show_sessions:
            lines += [f"    {x['session_path']}: {x['error_count']} ({x['outcome']})" for x in c["affected_sessions"]]
    return Report({"errors": data}, "\n".join(lines))


#: Rows that the text shows at most: slow operations, open ones.
SLOW, ORPHANS = 20, 10


def perf_report(entries: DataFrame, profile: Profile, wanted: LogFilter, threshold_ms: int = 1000, top: int = 20, orphans_only: bool = False, op_type: str | None = None, by: str = "duration") -> Report:
    """The data hold everything; threshold, top, orphans_only and by shape the text only."""
    commands = perf.tracks_commands(entries, profile.perf)
    kept = wanted.apply(entries)
    paired = perf.steps(kept, profile.perf, op_type, commands).cache()
    ops = perf.operations(paired)
    stats = perf.stats(ops)
    open_ones = perf.orphans(paired)
    in_order = open_ones.orderBy("op_type", "start_time", "correlation_id")

    def data():
        span = rows(info.time_range(kept))[0]
        return {
            "operations": Streamed(lambda: streamed_rows(ops.orderBy("end_time", "op_type", "correlation_id"))), "orphans": Streamed(lambda: streamed_rows(in_order)), "stats": rows(perf.sorted_stats(stats)),
            "time_range": {"start": span["first_timestamp"], "end": span["last_timestamp"]} if span["entries"] else None, "total_entries": span["entries"],
        }

    def text():
        orphans = _table(rows(in_order.limit(ORPHANS)), ["op_type", "name", "correlation_id", "component", "start_time"])
        count = open_ones.count()
        if orphans_only:
            return f"{count} orphans\n{orphans}"
        slow = rows(perf.slowest(perf.slow(ops, threshold_ms), min(top, SLOW)))
        return "\n\n".join([
            f"{ops.count()} operations, {count} orphans",
            _table(rows(perf.sorted_stats(stats, by, top)), ["op_type", "name", "count", "avg_duration_ms", "min_duration_ms", "max_duration_ms", "p50_duration_ms", "p95_duration_ms", "p99_duration_ms"]),
            f"At {threshold_ms} ms or above:\n" + _table(slow, ["op_type", "name", "correlation_id", "duration_ms"]), orphans,
        ])

    return Report(data, text, paired.unpersist)


# The names of the short layout.
_SHORT = {
    "index": "i", "component": "c", "level": "l", "kind": "k", "details": "d", "raw_key": "r", "log1_index": "l1", "log2_index": "l2", "text1": "t1", "text2": "t2",
    "log1_line": "ln1", "log2_line": "ln2", "diff_count": "dc", "path": "p", "value1": "v1", "value2": "v2", "indexes": "i", "key": "k", "instances": "i", "instance_count": "ic", "differences": "d",
}


def _shortened(value):
    if isinstance(value, list):
        return [_shortened(x) for x in value]
    if isinstance(value, Streamed):
        return Streamed(lambda indent: map(_shortened, value.items(indent)), True)
    if callable(value):
        return lambda: _shortened(value())
    return {_SHORT.get(k, k): (x if k in ("value1", "value2") else _shortened(x)) for k, x in value.items()} if isinstance(value, dict) else value


LAYOUTS = ("readable", "standard", "short")
#: Unique keys that reach the driver at once.
KEYS = 1000


def _text_of(fields: dict[str, Column], indent: int | None) -> Column:
    """JSON text of an object in a list, from the texts of its values (NULL: null)."""
    edge, inner = ("", "") if indent is None else ("\n" + " " * indent, "\n" + " " * (2 * indent))
    said = [x for i, (k, v) in enumerate(fields.items()) for x in (F.lit(("," + (inner or " ") if i else "{" + inner) + json.dumps(k) + ": "), F.coalesce(v.cast("string"), F.lit("null")))]
    return F.concat(*said, F.lit(edge + "}"))


def _between(indent: int | None) -> str:
    return ", " if indent is None else ",\n" + " " * indent


def _comparisons(table: DataFrame, parts: int, by: str, layout: str, indent: int | None) -> Iterator[dict]:
    """A comparison a key. Instances and differences by path come as texts from the executors, in blocks."""
    name = lambda k: _SHORT[k] if layout == "short" else k
    n, text = F.col("occurrence"), lambda i: F.when(F.col(f"text{i}").isNotNull(), json_string(f"text{i}"))
    instance = {"log1_index": n, "log2_index": n, "text1": text(1), "text2": text(2), "log1_line": F.col("line1"), "log2_line": F.col("line2"), "diff_count": F.col("diff_count")}
    if layout == "standard":
        instance["json_differences"] = differences_written("differences", indent, 2)
    sections = [(False, [_text_of({name(k) if k in _SHORT else k: v for k, v in instance.items()}, indent)])]
    if layout != "standard":
        edge, inner = ("", "") if indent is None else ("\n" + " " * indent, "\n" + " " * (2 * indent))
        index = F.concat(F.lit("[" + inner), n.cast("string"), F.lit("," + (inner or " ")), n.cast("string"), F.lit(edge + "]"))
        sections.append((True, [json_written("value1", indent, 1), json_written("value2", indent, 1), index]))
    found = compare.blocks(table, sections, parts, by).select("key", "section", "path", "field", F.size("texts").alias("n"), packed(F.array_join("texts", _between(indent))).alias("text"))
    for key, own in itertools.groupby(settled(found).toLocalIterator(), lambda r: r["key"]):
        apart, count = itertools.groupby(own, lambda r: r["section"]), [0]

        def instances(apart=apart, count=count):
            for r in next(apart)[1]:  # each key has some
                count[0] += r["n"]
                yield Said(unpacked(r["text"]))

        def differences(apart=apart):
            for _, some in apart:
                for path, rs in itertools.groupby(some, lambda r: r["path"]):
                    fields = itertools.groupby(rs, lambda r: r["field"])
                    values = lambda fields=fields: (Said(unpacked(r["text"])) for r in next(fields)[1])  # noqa: E731  in their order
                    yield {"path": path, "value1": Streamed(values), "value2": Streamed(values), "indexes": Streamed(values)}

        yield {"key": key_parts(key), "instances": Streamed(instances), "instance_count": lambda count=count: count[0]} | ({} if layout == "standard" else {"differences": Streamed(differences)})


def _compared_text(table: DataFrame, parts: int, by: str) -> Iterator[str]:
    """Under each key its differences, a line a path, then payloads where the pairs have them."""
    line = F.concat(json_written("value1"), F.lit(" -> "), json_written("value2"))
    sections = [(False, [F.lit("")]), (True, [line])]
    if "payload_json1" in table.columns:
        sections.append((False, [F.concat(*[x for n in (1, 2) for x in (F.lit("\n    ["), F.col("occurrence").cast("string"), F.lit("] "), F.col(f"payload_json{n}"))])]))
    found = compare.blocks(table, sections, parts, by, by_key=True).select("key", "section", "path", F.when(F.col("section") == 1, F.array_join("texts", "; ")).otherwise(F.array_join("texts", "")).alias("text"))
    for key, own in itertools.groupby(found.toLocalIterator(), lambda r: r["key"]):
        yield f"\n{key}"
        for (section, path), some in itertools.groupby(own, lambda r: (r["section"], r["path"])):
            for i, r in enumerate(some):
                yield (("; " if i else f"\n    {path}: ") if section == 1 else "") + r["text"]


def compare_report(one: DataFrame, two: DataFrame, wanted: LogFilter, diff_only: bool = False, by: str = "time", verbose: bool = False, full: bool = False, layout: str = "readable") -> Report:
    """layout: differences by path over all instances (readable, or short with short names), or with each instance (standard). full adds payloads to the text."""
    sides = [compare.keyed(x, wanted).cache() for x in (one, two)]
    joined = compare.paired(*map(compare.occurrences, sides)).cache()
    table = compare.pairs(joined, diff_only).cache()
    s = rows(compare.summary(joined, table))[0]
    for x in sides:
        x.unpersist()
    parts = 1 + table.count() // 12_800 + s["differences"] // 32_768  # some 4 MB of texts each

    def keys(n: int, said: Callable[[str], Column]) -> Iterator[str]:
        few = 1 + s[f"unique{n}"] // 16_384
        for found, name, order in ((compare.unique_keys(joined, n), "key", ["key"]), (compare.unpaired(joined, n), "label", ["key", "occurrence"])):
            texts = compare.in_order(found, few, *order).select(said(name).alias("text"))
            for r in settled(packed_rows(texts, KEYS, lambda some: json.dumps([x["text"] for x in some]))).toLocalIterator():
                yield from json.loads(unpacked(r["packed"]))

    def unique(n: int, indent: int | None) -> Iterator[Said]:
        names = _SHORT if layout == "short" else {}
        edge = "{" if indent is None else "{\n" + " " * (2 * indent)
        index, rest = f'{edge}"{names.get("index", "index")}": ', "," + (edge[1:] or " ")
        texts = (f"{index}{i}{rest}{x[len(edge):]}" for i, x in enumerate(keys(n, lambda c: key_written(c, names, indent, 1))))
        return (Said(_between(indent).join(some)) for some in itertools.batched(texts, 1000))

    def data():
        shared, total = ("shared_log_count", "total_differences_count") if layout == "standard" else ("shared_count", "differences_count")
        out = {
            "summary": {"unique_to_log1_count": s["unique1"], "unique_to_log2_count": s["unique2"], shared: s["shared"], total: s["differences"], "has_differences": s["has_differences"]},
            "unique_to_log1": Streamed(lambda indent: unique(1, indent), True), "unique_to_log2": Streamed(lambda indent: unique(2, indent), True),
            "comparisons": Streamed(lambda indent: _comparisons(table, parts, by, layout, indent), True),
        }
        return out | {"comparisons": _shortened(out["comparisons"])} if layout == "short" else out

    def text():
        yield f"only in the first: {s['unique1']}, only in the second: {s['unique2']}, shared keys: {s['shared']}, differences: {s['differences']}"
        if verbose:
            for n in (1, 2):
                for k in keys(n, F.col):
                    yield f"\n[FILE{n}] {k}"
        shown = table.join(joined.select("key", "occurrence", "payload_json1", "payload_json2"), ["key", "occurrence"]) if full else table
        yield from _compared_text(shown, parts, by)

    def done():
        table.unpersist()
        joined.unpersist()

    return Report(data, text, done)


def info_report(entries: DataFrame, profile: Profile, show_samples: bool = False, schema: bool = False, payloads: bool = False, show_timeline: bool = False) -> Report:
    span = rows(info.time_range(entries))[0]
    counts = rows(info.distributions(entries).orderBy("dimension", F.desc("count"), "value"))
    data = {"entries": span["entries"], "time_range": [span["first_timestamp"], span["last_timestamp"]], "distributions": counts, "unknown": rows(info.unknown_names(entries, profile.profile).orderBy("what", "value"))}
    data["span"] = rows(info.span(entries))[0]["span"]
    lines = [f"{span['entries']} entries, {span['first_timestamp']} to {span['last_timestamp']} ({data['span']})", _table(counts, ["dimension", "value", "count", "percent", "bar"])]
    if profile.levels:
        s = sessions.sessions(entries, profile.levels).cache()
        data["sessions"] = {"levels": rows(sessions.completion(s).orderBy("level")), "common_fields": rows(sessions.common_fields(s))}
        s.unpersist()
        lines.append(_table(data["sessions"]["levels"], ["level", "sessions", "completed", "incomplete"]))
    extras = {"payload_sizes": (payloads, lambda: info.payload_sizes(entries).orderBy(F.desc("avg_bytes"))), "payload_keys": (schema, lambda: info.payload_keys(entries).orderBy("kind", "name", "place")), "component_timeline": (show_timeline and span["entries"] > 5, lambda: info.component_timeline(entries).orderBy(F.desc("total"), "component", "bucket")), "timeline": (show_timeline and span["entries"] > 5, lambda: info.timeline(entries).orderBy("bucket"))}
    for name, (on, make) in extras.items():
        if on:
            data[name] = rows(make())
            lines.append(_table(data[name], list(data[name][0]) if data[name] else []))
    if show_samples:
        data["samples"] = rows(info.samples(entries).select(component_label().alias("component"), "level", truncated(F.col("message"), 100).alias("message")))
        lines.append(_table(data["samples"], ["component", "level", "message"]))
    return Report(data, "\n\n".join(lines))


def export_report(entries: DataFrame, wanted: LogFilter, limit: int = 100, sanitize: bool = True) -> Report:
    kept = wanted.apply(entries)
    m = rows(export.metadata(kept, limit))[0]
    logs = rows(export.export(kept, limit, sanitize).orderBy("idx"))
    for x in logs:
        x["data"] = json.loads(x["data"]) if x["data"] is not None else None
    types = {r["type"]: r["count"] for r in rows(export.type_counts(kept, limit))}
    split = lambda text: text.split(",") if text else []
    meta = {"total_entries": entries.count(), "filtered_entries": kept.count(), "components": split(m["components"]), "levels": split(m["levels"]), "entry_types": types, "time_range": {"start": m["start"], "end": m["end"]} if m["entries"] else None}
    data = {"metadata": meta, "logs": [{k: v for k, v in x.items() if v is not None} for x in logs]}
    return Report(data, to_json(data, None))
