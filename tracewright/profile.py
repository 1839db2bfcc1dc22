"""Profiles: declarative rules of how a system words its entries."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from pathlib import PurePath


@dataclass(frozen=True)
class ParserRules:
    format: str = "auto"
    event_emit_markers: tuple[str, ...] = ()
    event_receive_markers: tuple[str, ...] = ()
    event_payload_separator: str = "payload"
    command_prefix: str = ""
    command_start_marker: str = ""
    command_payload_markers: tuple[str, ...] = ()
    request_prefix: str = ""
    request_send_markers: tuple[str, ...] = ()
    request_receive_markers: tuple[str, ...] = ()
    request_payload_markers: tuple[str, ...] = ()
    request_endpoint_marker: str = ""
    json_indicators: tuple[str, ...] = ()
    module_depth: int = 2
    module_strip_prefix: str = ""


@dataclass(frozen=True)
class PerfRules:
    command_start_markers: tuple[str, ...] = ()
    command_completion_markers: tuple[str, ...] = ()
    event_correlation_keys: tuple[str, ...] = ("trace_id", "traceId", "request_id", "requestId", "id", "key")


@dataclass(frozen=True)
class KnownNames:
    known_components: tuple[str, ...] = ()
    known_commands: tuple[str, ...] = ()
    known_requests: tuple[str, ...] = ()


@dataclass(frozen=True)
class SessionLevel:
    name: str
    segment_prefix: str
    create_command: str | None = None
    complete_commands: tuple[str, ...] = ()
    summary_fields: tuple[str, ...] = ()


@dataclass(frozen=True)
class Profile:
    profile_name: str = "base"
    parser: ParserRules = field(default_factory=ParserRules)
    perf: PerfRules = field(default_factory=PerfRules)
    profile: KnownNames = field(default_factory=KnownNames)
    levels: tuple[SessionLevel, ...] = ()


FORMATS = ("auto", "classic", "rust-tracing", "syslog", "json-lines")
_ALIASES = {"current": "classic", "default": "classic"}


class ProfileError(ValueError):
    """A profile that can't be read, parsed or found."""


def _section(kind, values: dict):
    known = {f.name for f in fields(kind)}
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known})


def parse_profile(text: str) -> Profile:
    """A profile from TOML; sections and keys that are left out have their defaults."""
    try:
        data = tomllib.loads(text)
        parser = dict(data.get("parser", {}))
        if "format" in parser:
            parser["format"] = _ALIASES.get(parser["format"], parser["format"])
            if parser["format"] not in FORMATS:
                raise ProfileError(f"unknown format: {parser['format']}")
        levels = tuple(_section(SessionLevel, x) for x in data.get("sessions", {}).get("levels", []))
        return Profile(data.get("profile_name", "base"), _section(ParserRules, parser), _section(PerfRules, data.get("perf", {})), _section(KnownNames, data.get("profile", {})), levels)
    except (tomllib.TOMLDecodeError, TypeError) as e:
        raise ProfileError(f"can't parse profile: {e}") from e


# The bundled profiles' marker strings and names.
_CLASSIC_WORDING = ParserRules(
    event_emit_markers=("Emit event of type",),
    event_receive_markers=("Received event of type",),
    event_payload_separator="with payload",
    command_prefix='Command "',
    command_start_marker='" is called',
    command_payload_markers=("with settings",),
    request_prefix='Request "',
    request_send_markers=("will be sent",),
    request_receive_markers=("finished successfully", "respond with"),
    request_payload_markers=("with body",),
    request_endpoint_marker='address "[',
    json_indicators=("with settings {", "with body [", "with body {", "with body", "with body "),
)
_CLASSIC_PERF = PerfRules(("is called",), ("finished", "returned", "completed"), ("key",))
_BUILTIN = {
    "base": Profile(),
    "custom-start": Profile(
        "custom-start", _CLASSIC_WORDING, _CLASSIC_PERF, KnownNames(("api", "worker"), ("sync", "publish"), ("fetchUser", "createOrder")),
        (SessionLevel("level-1", "trace-"), SessionLevel("level-2", "span-")),
    ),
    "service-api": Profile(
        "service-api",
        ParserRules(
            event_emit_markers=("Published event",), event_receive_markers=("Consumed event", "Received event"), event_payload_separator="payload",
            command_prefix='Operation "', command_start_marker='" started', command_payload_markers=("with settings", "settings"),
            request_prefix='Request "', request_send_markers=("sent", "queued", "requested"), request_receive_markers=("completed", "responded", "failed"),
            request_payload_markers=("with body", "payload"), request_endpoint_marker='to "[',
            json_indicators=("with settings {", "settings {", "with body [", "with body {", "payload [", "payload {", "payload", "with body"),
        ),
        PerfRules(("started", "begin"), ("completed", "finished", "failed"), ("key", "traceId", "requestId")),
        KnownNames(("gateway", "orders", "billing", "worker"), ("reconcile", "syncCache", "publish"), ("createOrder", "getOrder", "authorizePayment")),
        (SessionLevel("level-1", "trace-"), SessionLevel("level-2", "request-")),
    ),
    "event-pipeline": Profile(
        "event-pipeline",
        ParserRules(
            event_emit_markers=("Published", "Emitted"), event_receive_markers=("Consumed", "Received"), event_payload_separator="payload",
            command_prefix='Stage "', command_start_marker='" begin', command_payload_markers=("with settings", "config"),
            request_prefix='Call "', request_send_markers=("started", "dispatched"), request_receive_markers=("done", "completed", "failed"),
            request_payload_markers=("payload", "with body"), request_endpoint_marker='target "[',
            json_indicators=("with settings {", "config {", "payload [", "payload {", "payload", "with body [", "with body {", "with body"),
        ),
        PerfRules(("begin", "started"), ("done", "completed", "failed"), ("key", "eventId", "traceId", "jobId")),
        KnownNames(("bus", "worker", "scheduler", "dead-letter"), ("enrich", "validate", "persist", "retry"), ("fetchTemplate", "loadConfig", "ack")),
        (SessionLevel("level-1", "job-"), SessionLevel("level-2", "trace-")),
    ),
    # Rebuilt from its documented behaviour: the wording of custom-start with three session levels.
    "eyes": Profile(
        "eyes", _CLASSIC_WORDING, _CLASSIC_PERF, KnownNames(),
        (
            SessionLevel("manager", "manager-", "makeManager", ("getResults", "closeBatch"), ("concurrency", "batch.id")),
            SessionLevel("eyes", "eyes-", "openEyes", ("close", "abort")),
            SessionLevel("environment", "environment-"),
        ),
    ),
}


def builtin_names() -> list[str]:
    return sorted(_BUILTIN)


def builtin(name: str) -> Profile:
    """A bundled profile by its bare name, its file name or a path ending in it."""
    key = PurePath(name).name
    key = key.removesuffix(".toml").lower()
    if key not in _BUILTIN:
        raise ProfileError(f"unknown profile {name!r}; built-in ones: {', '.join(builtin_names())}")
    return _BUILTIN[key]


def load_profile(path: str | None = None, preset: str | None = None) -> Profile:
    """From a file if a path is given, else a bundled one, else base."""
    if path is None:
        return builtin(preset or "base")
    try:
        with open(path, encoding="utf-8") as f:
            return parse_profile(f.read())
    except OSError as e:
        raise ProfileError(f"can't read profile {path}: {e}") from e


def _quoted(text: str) -> str:
    out = text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r")
    return f'"{out}"'


def _toml(value) -> str:
    if isinstance(value, tuple):
        return "[" + ", ".join(map(_toml, value)) + "]"
    return _quoted(value) if isinstance(value, str) else str(value)


def to_toml(profile: Profile, header: str = "") -> str:
    """The profile as TOML, under header lines as comments."""
    lines = [f"# {x}".rstrip() for x in header.splitlines()] + [f"profile_name = {_toml(profile.profile_name)}"]
    for name in ("parser", "perf", "profile"):
        section = getattr(profile, name)
        lines += ["", f"[{name}]"] + [f"{f.name} = {_toml(getattr(section, f.name))}" for f in fields(section)]
    for level in profile.levels:
        lines += ["", "[[sessions.levels]]"] + [f"{f.name} = {_toml(v)}" for f in fields(level) if (v := getattr(level, f.name)) not in (None, ())]
    return "\n".join(lines) + "\n"
