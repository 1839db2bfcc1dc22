"""Command line: tracewright COMMAND FILE..."""

from __future__ import annotations

import argparse
import contextlib
import itertools
import os
import re
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from tracewright import render
from tracewright.operators.export import redacted
from tracewright.operators.filters import FilterError, LogFilter
from tracewright.operators.infer import infer_profile
from tracewright.profile import Profile, ProfileError, builtin, load_profile, to_toml
from tracewright.session import local_session
from tracewright.sources.logs import LogFormatError, detect_file, read_log, read_logs, with_sequence


def _parser() -> argparse.ArgumentParser:
    env = lambda name, default=None: os.environ.get(f"TRACEWRIGHT_{name}", default)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("-f", "--filter", default=env("FILTER"), help="terms [!]type:value")
    common.add_argument("-F", "--format", choices=("text", "json"), default=env("FORMAT", "text"))
    common.add_argument("-j", "--json", action="store_true", help="short for -F json")
    common.add_argument("-c", "--compact", action="store_true", help="JSON on one line")
    common.add_argument("-o", "--output", default=env("OUTPUT"), help="write to a file")
    which = common.add_mutually_exclusive_group()
    which.add_argument("--config", default=env("CONFIG"), help="profile file")
    which.add_argument("--preset", default=env("PRESET"), help="bundled profile")
    common.add_argument("--color", choices=("auto", "always", "never"), default=env("COLOR", "auto"), help="of text on a terminal")
    common.add_argument("-v", "--verbose", action="count", default=0)
    common.add_argument("-q", "--quiet", action="store_true")
    parser = argparse.ArgumentParser(prog="tracewright", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)

    def command(name, *aliases, files="+"):
        p = sub.add_parser(name, aliases=list(aliases), parents=[common])
        p.set_defaults(command=name)
        p.add_argument("files", nargs=files)
        return p

    orders = ("time", "component", "level", "type", "diff-count")
    for name, aliases in (("compare", ["cmp"]), ("diff", []), ("llm-diff", [])):
        p = command(name, *aliases, files=2)
        p.add_argument("-s", "--sort-by", choices=orders, default="time")
        p.add_argument("-D", "--diff-only", action="store_true", default=name != "compare")
        p.add_argument("--full", action="store_true")
        p.add_argument("--layout", choices=render.LAYOUTS, default="readable", help="of JSON")
        p.add_argument("--no-sanitize", action="store_true")
    p = command("info", "i", "inspect")
    for flags in (("-s", "--samples"), ("--json-schema",), ("-p", "--payloads"), ("-t", "--timeline")):
        p.add_argument(*flags, action="store_true")
    p = command("search", files=1)
    p.add_argument("--context", type=int, default=0)
    p.add_argument("--payloads", action="store_true")
    p.add_argument("--count-by", choices=("matches", "component", "level", "type", "payload"))
    p = command("errors")
    p.add_argument("--top-n", type=int, default=10)
    p.add_argument("--warn", action="store_true")
    p.add_argument("--sessions", action="store_true")
    p.add_argument("-s", "--sort-by", choices=("count", "time", "impact"), default="count")
    p = command("extract", files=1)
    p.add_argument("--field", required=True)
    p = command("perf")
    p.add_argument("--threshold-ms", type=int, default=1000)
    p.add_argument("--top-n", type=int, default=20)
    p.add_argument("--orphans-only", action="store_true")
    p.add_argument("--op-type", choices=("request", "event", "command"))
    p.add_argument("-s", "--sort-by", choices=("duration", "count", "name"), default="duration")
    p = command("trace")
    one = p.add_mutually_exclusive_group(required=True)
    one.add_argument("--id")
    one.add_argument("--session")
    p = command("process", "llm", files=1)
    p.add_argument("--limit", type=int, default=100)
    p.add_argument("--no-sanitize", action="store_true")
    p.add_argument("-s", "--sort-by", choices=orders, default="time", help="has no effect")
    p = command("generate-config", "gen-config")
    p.add_argument("--profile-name", default="generated")
    p.add_argument("--template")
    return parser


def _run(args, profile: Profile, wanted: LogFilter, spark: SparkSession | None = None) -> render.Report:
    if spark is None:
        spark = local_session(os.cpu_count() or 4)
        spark.sparkContext.setLogLevel("ERROR")
    if args.command in ("compare", "diff", "llm-diff"):
        logs = [read_log(spark, f, profile, i) for i, f in enumerate(args.files)]
        if args.command == "llm-diff" and not args.no_sanitize:
            logs = [redacted(x) for x in logs]
        return render.compare_report(*logs, wanted, args.diff_only, args.sort_by, args.verbose > 0, args.full, args.layout)
    entries = read_logs(spark, args.files, profile)
    if args.command in ("search", "extract", "process"):
        entries = with_sequence(entries)
    entries = entries.cache()  # several reports read it
    if args.command == "info":
        return render.info_report(wanted.apply(entries), profile, args.samples, args.json_schema, args.payloads, args.timeline)
    if args.command == "search":
        return render.search_report(entries, wanted, args.files[0], args.context, args.payloads, args.count_by)
    if args.command == "errors":
        return render.errors_report(entries, profile, wanted, args.top_n, args.warn, args.sessions, args.sort_by)
    if args.command == "extract":
        return render.extract_report(entries, wanted, args.files[0], args.field)
    if args.command == "perf":
        return render.perf_report(entries, profile, wanted, args.threshold_ms, args.top_n, args.orphans_only, args.op_type and args.op_type.capitalize(), args.sort_by)
    if args.command == "trace":
        return render.trace_report(entries, args.id, args.session, wanted)
    if args.command == "process":
        return render.export_report(entries, wanted, args.limit, not args.no_sanitize)
    template = (load_profile(args.template) if os.path.exists(args.template) else builtin(args.template)) if args.template else None
    found = infer_profile(wanted.apply(entries), args.profile_name, template, {detect_file(spark, f, profile) for f in args.files})
    return render.Report({"profile": found.profile_name}, to_toml(found, "Generated profile.\nReview the markers before use."))


def _reason(e: Exception) -> str:
    """What went wrong, without the trace of a worker it went wrong in."""
    said = str(e)
    found = re.search(r"LogFormatError: (.*)", said)
    return found[1] if found else said.splitlines()[0] if isinstance(e, PySparkException) and said else said


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        wanted = LogFilter.parse(args.filter)
        if not args.quiet:
            for note in wanted.warnings():
                print(f"warning: {note}", file=sys.stderr)
        report = _run(args, load_profile(args.config, args.preset), wanted, spark)
        as_json = (args.json or args.format == "json" or args.command == "llm-diff") and args.command != "generate-config"
        pieces = iter(report.json_pieces(None if args.compact or args.command == "llm-diff" else 2) if as_json else report.text_pieces())
        shown = sys.stdout.isatty() and "NO_COLOR" not in os.environ if args.color == "auto" else args.color == "always"
        if shown and not as_json and not args.output and args.command != "generate-config":
            pieces = iter([render.coloured("".join(pieces))])
        first = next(pieces, "")  # what fails at once leaves no file
        with open(args.output, "w", encoding="utf-8") if args.output else contextlib.nullcontext(sys.stdout) as out:
            for piece in itertools.chain([first], pieces, ["\n"]):
                out.write(piece)
        report.close()
    except (FilterError, ProfileError, LogFormatError, OSError, PySparkException) as e:
        print(f"error: {_reason(e)}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
