"""Structural comparison of two runs: entries pair by key and occurrence, payloads are compared field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.payload import json_differences
from tracewright.functions.text import compare_key, level_rank
from tracewright.operators import numbering
from tracewright.operators.filters import LogFilter
from tracewright.schema import barrier

SORTS = ("time", "component", "level", "type", "diff-count")


def keyed(entries: DataFrame, wanted: LogFilter | None = None) -> DataFrame:
    """What a comparison needs of each entry, with its key."""
    return (wanted or LogFilter()).apply(entries).select(compare_key().alias("key"), "seq", "source_line_number", "timestamp", "component", "level", "kind", "message", "payload_json")


def numbered(entries: DataFrame, wanted: LogFilter | None = None) -> DataFrame:
    """keyed() entries with their occurrence under their key in file order."""
    return occurrences(keyed(entries, wanted))


def occurrences(rows: DataFrame) -> DataFrame:
    """keyed() rows, read twice, with their occurrence."""
    return numbering.numbered(rows, ("key",), "seq", "occurrence").withColumn("occurrence", F.col("occurrence").cast("int"))


def paired(one: DataFrame, two: DataFrame) -> DataFrame:
    """Full outer join of two numbered files on key and occurrence: one shuffle a side, whatever the repetition of a key."""
    side = lambda df, n: df.select("key", "occurrence", *[F.col(c).alias(f"{c}{n}") for c in df.columns if c not in ("key", "occurrence")])
    return side(one, 1).join(side(two, 2), ["key", "occurrence"], "full_outer")


def pairs(joined: DataFrame, diff_only: bool = False) -> DataFrame:
    """Pairs with both payloads: their differences, and both messages where these differ too."""
    both = joined.where("payload_json1 is not null and payload_json2 is not null").withColumn("differences", json_differences("payload_json1", "payload_json2"))
    both = barrier(both).withColumn("diff_count", F.size("differences"))
    if diff_only:
        both = both.where("diff_count > 0")
    other = (F.col("diff_count") > 0) & (F.col("message1") != F.col("message2"))
    return both.select(
        "key", "occurrence", F.col("source_line_number1").alias("line1"), F.col("source_line_number2").alias("line2"), "diff_count", "differences",
        F.when(other, F.col("message1")).alias("text1"), F.when(other, F.col("message2")).alias("text2"),
        F.least("timestamp1", "timestamp2").alias("at"), F.col("component1").alias("component"), F.col("level1").alias("level"), F.col("kind1").alias("kind"),
    )


def key_sets(joined: DataFrame) -> DataFrame:
    """key, first and second: how many occurrences either file has."""
    return joined.groupBy("key").agg(F.count("seq1").alias("first"), F.count("seq2").alias("second"))


def unique_keys(joined: DataFrame, side: int) -> DataFrame:
    """Keys that only one file (1 or 2) has."""
    other = "second" if side == 1 else "first"
    return key_sets(joined).where(F.col(other) == 0).select("key")


def unpaired(joined: DataFrame, side: int) -> DataFrame:
    """Surplus occurrences of shared keys: key, occurrence (from 1), line, label."""
    surplus = joined.where(F.col(f"seq{3 - side}").isNull())
    shared = key_sets(joined).where("first > 0 and second > 0").select("key")
    label = F.format_string("%s [unpaired occurrence %d at line %d]", "key", "occurrence", f"source_line_number{side}")
    return surplus.join(shared, "key", "left_semi").select("key", "occurrence", F.col(f"source_line_number{side}").alias("line"), label.alias("label"))


def sorted_pairs(table: DataFrame, by: str = "time") -> DataFrame:
    """By the key's earliest time, component, level, kind, or number of differences; ties by key and occurrence."""
    earliest = F.min("at").over(Window.partitionBy("key"))
    orders: dict[str, Column] = {"time": F.asc("earliest"), "component": F.asc("component"), "level": F.desc(level_rank(F.col("level"))), "type": F.asc("kind"), "diff-count": F.desc("diff_count")}
    return table.withColumn("earliest", earliest).orderBy(orders[by], "key", "occurrence").drop("earliest")


#: Pairs of one key in a block at most, and pairs whose differences of one path are: texts of about 20 kB.
PAIRS, DIFFERING = 64, 512


def in_order(df: DataFrame, parts: int, *order: Column | str) -> DataFrame:
    """orderBy() in so many partitions, whatever their bytes: what a driver that reads one at a time holds stays bounded."""
    return df.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def blocks(table: DataFrame, sections: list[tuple[bool, list[Column]]], parts: int, by: str = "time", by_key: bool = False) -> DataFrame:
    """Texts of sorted_pairs() in blocks, each key's together, keys by their first pair (by_key: by name): key, section, path, field, texts.

    A section has texts of a pair or, if it is one of differences, of a difference (path, value1, value2 besides
    occurrence): these come path by path, paths as they come first. Of several texts, all first ones (field 0) come before
    all second ones.
    """
    value = {"time": F.col("at"), "component": F.col("component"), "level": -level_rank(F.col("level")), "type": F.col("kind"), "diff-count": -F.col("diff_count")}[by]
    best = table.groupBy("key").agg(F.min(value).alias("__best"))
    rows = table.withColumn("__own", F.lit(0) if by == "time" else value).withColumn("__at", F.lit(0))
    out = None
    for k, (apart, texts) in enumerate(sections):
        own = rows.select("key", "__own", "occurrence", F.posexplode("differences").alias("__at", "d")).select("*", "d.path", "d.value1", "d.value2") if apart else rows.withColumn("path", F.lit(None).cast("string"))
        block = F.floor((F.col("occurrence") - 1) / (DIFFERING if apart else PAIRS)).alias("__block")
        items = own.select("key", "path", "__own", block, F.struct("occurrence", "__at", F.array(*texts).alias("texts")).alias("item"))
        found = items.groupBy("key", "path", "__own", "__block").agg(F.sort_array(F.collect_list("item")).alias("items"))
        place = F.min(F.struct("__own", "occurrence", "__at")).alias("__place")
        if apart:
            found = found.join(own.groupBy("key", "path").agg(place), ["key", "path"])
        else:
            found = found.withColumn("__place", F.lit(None).cast(own.agg(place).schema[0].dataType))
        nth = lambda i: F.transform("items", lambda x: x["texts"][i])
        fields = F.array(*map(nth, range(len(texts))))
        found = found.select("key", "path", "__own", "__block", "__place", F.lit(k).alias("section"), F.posexplode(fields).alias("field", "texts"))
        out = found if out is None else out.union(found)
    order = [*([] if by_key else ["__best"]), "key", "section", "__place", "path", "field", "__own", "__block"]
    return in_order(out.join(best, "key"), parts, *order).select("key", "section", "path", "field", "texts")


def regrouped(table: DataFrame) -> DataFrame:
    """Differences by key and path: a row for each pair of occurrences, with either side's value and how many such rows there are."""
    rows = table.select("key", "occurrence", F.inline("differences"))
    counts = rows.groupBy("key", "path").agg(F.count("*").alias("instances"))
    return rows.join(counts, ["key", "path"]).select("key", "path", "occurrence", "value1", "value2", "change", "instances")


def summary(joined: DataFrame, compared: DataFrame) -> DataFrame:
    """One row: unique and shared keys, all differences, has_differences. Surplus occurrences count as unique."""
    sets = key_sets(joined)
    surplus = lambda a, b: F.sum(F.when(F.col(b) == 0, 1).when(F.col(a) > F.col(b), F.col(a) - F.col(b)).otherwise(0))
    counts = sets.agg(
        F.coalesce(surplus("first", "second"), F.lit(0)).alias("unique1"), F.coalesce(surplus("second", "first"), F.lit(0)).alias("unique2"), F.count_if((F.col("first") > 0) & (F.col("second") > 0)).alias("shared")
    )
    found = compared.agg(F.coalesce(F.sum("diff_count"), F.lit(0)).alias("differences"))
    return counts.crossJoin(F.broadcast(found)).withColumn("has_differences", (F.col("unique1") + F.col("unique2") + F.col("differences")) > 0)  # one row by one row
