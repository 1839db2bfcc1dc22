"""The entry schema: one wide row for each log entry, whatever its kind.

DataFrames have no order, so (timestamp, file_idx, source_line_number) travel
with every row; `seq` is the order inside one file. payload_json is canonical
JSON text (sorted keys, no white space); NULL means no payload, the text
`null` a JSON null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY = T.StructType([
    T.StructField("file_idx", T.IntegerType()),
    T.StructField("file", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("source_line_number", T.LongType()),
    T.StructField("component", T.StringType()),
    T.StructField("component_id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("level", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("raw_logline", T.StringType()),
    T.StructField("structured_fields", T.MapType(T.StringType(), T.StringType())),
    T.StructField("module_path", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("direction", T.StringType()),
    T.StructField("request_id", T.StringType()),
    T.StructField("endpoint", T.StringType()),
    T.StructField("payload_json", T.StringType()),
])

EVENT, COMMAND, REQUEST, GENERIC = "Event", "Command", "Request", "Generic"

#: Total order of a merged timeline.
TIMELINE = ("timestamp", "file_idx", "source_line_number")


def order():
    return [F.col(c) for c in TIMELINE]


def order_key():
    """The timeline position as one comparable struct, for min_by and max_by."""
    return F.struct(*TIMELINE)


def barrier(df: DataFrame, apart: bool = False) -> DataFrame:
    """The same rows behind a node that projections don't collapse over: each column is worked out once, not wherever it is used.

    apart: generated code ends there too, as for expressions that together pass the size of a method.
    """
    whole = F.array(F.struct(*df.columns))
    return df.select(F.inline(F.filter(whole, lambda x: x.isNotNull()) if apart else whole))
