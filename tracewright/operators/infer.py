"""Profile inference from entries."""

from __future__ import annotations

import os
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import segment_prefix
from tracewright.profile import KnownNames, Profile, SessionLevel
from tracewright.schema import COMMAND, REQUEST


def known_names(entries: DataFrame) -> DataFrame:
    """what, name: distinct components, commands and requests."""
    pairs = F.array(
        F.struct(F.lit("component").alias("what"), F.col("component").alias("name")),
        F.struct(F.when(F.col("kind") == COMMAND, "command").when(F.col("kind") == REQUEST, "request").alias("what"), F.col("name").alias("name")),
    )
    return entries.select(F.explode(pairs).alias("p")).where("p.what is not null").select("p.what", "p.name").distinct()


def prefix_ranks(entries: DataFrame) -> DataFrame:
    """prefix, count: prefixes of the first two path segments that occur more than once."""
    path = F.filter(F.split("component_id", "/"), lambda s: s != "")
    return entries.select(F.explode(F.slice(path, 1, 2)).alias("s")).select(segment_prefix(F.col("s")).alias("prefix")).where("prefix <> ''").groupBy("prefix").agg(F.count("*").alias("count")).where("count > 1")


def module_roots(entries: DataFrame) -> DataFrame:
    """root, deep: distinct first segments of module paths, and whether any of the paths has two segments or more."""
    parts = F.filter(F.split("module_path", "::"), lambda s: s != "")
    return entries.where("module_path is not null").groupBy(F.get(parts, F.lit(0)).alias("root")).agg(F.max(F.size(parts) > 1).alias("deep"))


def strip_prefix(roots: list[str]) -> str:
    """The longest common prefix of the roots up to its last underscore, if it has three characters or more."""
    common = os.path.commonprefix(roots) if roots else ""
    cut = common[: common.rfind("_") + 1]
    return cut if len(cut) >= 3 else ""


def infer_profile(entries: DataFrame, name: str = "generated", template: Profile | None = None, detected: set[str] | None = None) -> Profile:
    """A profile with the names, session levels and module rules that the entries show. The lists it makes are the profile: they come to the driver."""
    base = template or Profile()
    names: dict[str, list[str]] = {"component": [], "command": [], "request": []}
    for r in known_names(entries).orderBy("what", "name").collect():
        names[r["what"]].append(r["name"])
    levels = base.levels or tuple(SessionLevel(f"level-{i + 1}", r["prefix"]) for i, r in enumerate(prefix_ranks(entries).orderBy(F.desc("count"), "prefix").collect()))
    parser = base.parser
    roots = module_roots(entries).orderBy("root").collect()
    if roots:
        parser = replace(parser, format="rust-tracing", module_depth=2 if any(r["deep"] for r in roots) else 1, module_strip_prefix=strip_prefix([r["root"] for r in roots]))
    if detected and len(detected) == 1:
        parser = replace(parser, format=next(iter(detected)))
    return replace(base, profile_name=name, parser=parser, profile=KnownNames(*(tuple(names[k]) for k in ("component", "command", "request"))), levels=levels)
