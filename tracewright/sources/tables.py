"""Adapters from star-schema tables to the entry schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.schema import ENTRY


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as log entries.

    A click sends request `checkout` and a purchase answers it, a view receives
    event `Page.view` and a signup emits it, an error is a generic entry. Users
    are sessions; an event's payload also has its user as `key`.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    request, event = kind.isin("click", "purchase"), kind.isin("view", "signup")
    payload = F.replace(F.col("props"), F.lit(": "), F.lit(":"))
    message = (
        F.when(kind == "click", F.concat(F.lit('Request "checkout" [0--'), user, F.lit("] will be sent")))
        .when(kind == "purchase", F.concat(F.lit('Request "checkout" [0--'), user, F.lit("] finished successfully")))
        .when(kind == "view", F.lit("Received event of type Page.view"))
        .when(kind == "signup", F.lit("Emit event of type Page.view"))
        .otherwise(F.concat(F.lit("failed to load item "), (F.col("event_id") + 1_000_000).cast("string"), F.lit(" of group "), (F.col("user_id") % 7).cast("string")))
    )
    columns = {
        "file_idx": F.lit(0), "file": F.lit("events"), "seq": F.col("event_id"), "source_line_number": F.col("event_id") + 1,
        "component": F.concat(F.lit("svc-"), (F.col("user_id") % 4).cast("string")),
        "component_id": F.concat(F.lit("manager-"), (F.col("user_id") % 10).cast("string"), F.lit("/eyes-"), user),
        "timestamp": F.col("ts").cast("timestamp"),
        "level": F.when(kind == "error", "ERROR").when(kind == "signup", "WARN").otherwise("INFO"),
        "message": message, "raw_logline": message,
        "structured_fields": F.create_map(F.lit("user"), user, F.lit("action"), kind),
        "module_path": F.lit(None),
        "kind": F.when(request, "Request").when(event, "Event").otherwise("Generic"),
        "name": F.when(request, "checkout").when(event, "Page.view"),
        "direction": F.when(kind == "click", "Send").when(kind.isin("purchase", "view"), "Receive").when(kind == "signup", "Emit"),
        "request_id": F.when(request, F.concat(F.lit("0--"), user)),
        "endpoint": F.lit(None),
        "payload_json": F.when(event, F.concat(F.expr("left(replace(props, ': ', ':'), length(replace(props, ': ', ':')) - 1)"), F.lit(',"key":"'), user, F.lit('"}'))).otherwise(payload),
    }
    return e.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in ENTRY.fields])


def split_halves(entries: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
    """Two files out of one: entries up to seq `at`, and those after it."""
    return entries.where(F.col("seq") < at), entries.where(F.col("seq") >= at).withColumn("file_idx", F.lit(1))
