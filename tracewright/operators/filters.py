"""The filter language: terms `[!]type:value`, folded to one predicate column."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import contains_ci, flow

_NAMES = {
    "component": "component", "comp": "component", "c": "component",
    "level": "level", "lvl": "level", "l": "level",
    "text": "text", "t": "text",
    "direction": "direction", "dir": "direction", "d": "direction",
}
_WAYS = {"incoming": "Incoming", "outgoing": "Outgoing"}
KNOWN_LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "WARNING", "ERROR", "FATAL")


class FilterError(ValueError):
    """A term without a colon or a value, or with an unknown direction."""


@dataclass(frozen=True)
class Term:
    kind: str
    value: str
    exclude: bool = False
    key: str | None = None

    @classmethod
    def parse(cls, text: str) -> Term:
        exclude = text.startswith("!")
        name, colon, value = text[exclude:].partition(":")
        if not colon or not name:
            raise FilterError(f"no filter of the form type:value: {text}")
        if not value:
            raise FilterError(f"no value: {text}")
        kind = _NAMES.get(name.lower())
        if kind == "direction":
            if value.lower() not in _WAYS:
                raise FilterError(f"no direction (incoming or outgoing): {value}")
            value = _WAYS[value.lower()]
        return cls(kind or "field", value, exclude, None if kind else name)


def split_terms(text: str) -> list[str]:
    """Parts between white space; quotes hold a part together and stay in it."""
    parts, now, quote = [], "", ""
    for ch in text:
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "\"'":
            quote = ch
        elif ch.isspace():
            if now:
                parts.append(now)
            now = ""
            continue
        now += ch
    return [*parts, now] if now else parts


@dataclass(frozen=True)
class LogFilter:
    """Terms of one filter. Includes of one type are alternatives, types must all hold, no exclude may; fields are one type."""

    terms: tuple[Term, ...] = field(default=())

    @classmethod
    def parse(cls, text: str | None) -> LogFilter:
        return cls(tuple(Term.parse(t) for t in split_terms(text or "")))

    def _with(self, kind: str, value: str, exclude: bool = False, key: str | None = None) -> LogFilter:
        return LogFilter((*self.terms, Term(kind, value, exclude, key)))

    def component(self, value: str, exclude: bool = False) -> LogFilter:
        return self._with("component", value, exclude)

    def level(self, value: str, exclude: bool = False) -> LogFilter:
        return self._with("level", value, exclude)

    def text(self, value: str, exclude: bool = False) -> LogFilter:
        return self._with("text", value, exclude)

    def direction(self, value: str, exclude: bool = False) -> LogFilter:
        return self._with("direction", _WAYS[value.lower()], exclude)

    def field(self, key: str, value: str, exclude: bool = False) -> LogFilter:
        return self._with("field", value, exclude, key)

    def includes(self, kind: str) -> list[Term]:
        return [t for t in self.terms if t.kind == kind and not t.exclude]

    def excludes(self, kind: str) -> list[Term]:
        return [t for t in self.terms if t.kind == kind and t.exclude]

    @property
    def is_empty(self) -> bool:
        return not self.terms

    def warnings(self) -> list[str]:
        return [f"unknown level {t.value}" for t in self.terms if t.kind == "level" and not any(t.value.upper() in k for k in KNOWN_LEVELS)]

    @staticmethod
    def _test(t: Term) -> Column:
        if t.kind == "direction":
            hit = flow() == t.value
        elif t.kind == "field":
            hit = contains_ci(F.try_element_at("structured_fields", F.lit(t.key)), t.value)
        else:
            hit = contains_ci(F.col("message" if t.kind == "text" else t.kind), t.value)
        return F.coalesce(hit, F.lit(False))  # a missing direction or field fails an include and passes an exclude

    def column(self) -> Column:
        tests: list[Column] = []
        for kind in ("component", "level", "text", "direction", "field"):
            if some := self.includes(kind):
                tests.append(reduce(lambda a, b: a | b, map(self._test, some)))
            tests += [~self._test(t) for t in self.excludes(kind)]
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    def apply(self, entries: DataFrame) -> DataFrame:
        return entries if self.is_empty else entries.where(self.column())


def error_levels(warn: bool = False) -> Column:
    level = F.upper("level")
    return F.contains(level, F.lit("ERROR")) | (F.contains(level, F.lit("WARN")) if warn else F.lit(False))


def trace_selector(identifier: str | None = None, session: str | None = None) -> Column:
    """Entries that mention an id (raw line, any field, request id), or of a session path; exactly one is given."""
    if (identifier is None) == (session is None):
        raise ValueError("give an id or a session")
    if session is not None:
        return (F.col("component_id") != "") & F.contains("component_id", F.lit(session))
    needle = F.lit(identifier)
    return F.contains("raw_logline", needle) | F.exists(F.map_values("structured_fields"), lambda v: F.contains(v, needle)) | F.coalesce(F.contains("request_id", needle), F.lit(False))
