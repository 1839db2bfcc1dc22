"""Operation timing over a stream of entries.

Batch timing needs no state; over a stream a start waits for its end. One value
is kept for each key: the last start. A watermark bounds how long it waits,
after which it is reported as an orphan.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewright.functions.text import request_id_in
from tracewright.operators.perf import event_key
from tracewright.profile import PerfRules
from tracewright.schema import EVENT, REQUEST

RESULT = "op_type string, correlation_id string, name string, start_time timestamp, end_time timestamp, duration_ms long, outcome string"
STATE = "start_us long, name string"
#: How long a start may stay open, in milliseconds of event time.
WAIT_MS = 3_600_000


def _pair(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    op_type, correlation_id = key
    start, name = state.get if state.exists else (None, None)
    out = []
    row = lambda a, b, n, outcome: (op_type, correlation_id, n, pd.Timestamp(a, unit="us"), pd.Timestamp(b, unit="us") if b is not None else pd.NaT, (b - a) // 1000 if b is not None else None, outcome)
    if state.hasTimedOut:
        out.append(row(start, None, name, "orphaned"))
        state.remove()
    else:
        rows = pd.concat(list(batches)).sort_values(["at_us", "seq"])
        for at, starts, own in zip(rows["at_us"], rows["starts"], rows["name"], strict=True):
            if starts:
                start, name = int(at), own
            elif start is not None:
                out.append(row(start, int(at), own, "completed"))
                start = name = None
        if start is None:
            if state.exists:
                state.remove()
        else:
            state.update((start, name))
            state.setTimeoutTimestamp(max(start // 1000 + WAIT_MS, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(out, columns=["op_type", "correlation_id", "name", "start_time", "end_time", "duration_ms", "outcome"])


def stream_operations(entries: DataFrame, rules: PerfRules | None = None, watermark: str = "10 minutes") -> DataFrame:
    """Requests and events of a streaming entry DataFrame, paired; open starts come out as orphaned when their time is up."""
    kind, way = F.col("kind"), F.col("direction")
    begins = ((kind == REQUEST) & (way == "Send")) | ((kind == EVENT) & (way == "Receive"))
    ends = ((kind == REQUEST) & (way == "Receive")) | ((kind == EVENT) & (way == "Emit"))
    key = F.when(kind == REQUEST, F.coalesce("request_id", request_id_in(F.col("message")))).when(kind == EVENT, event_key(rules or PerfRules()))
    rows = entries.withWatermark("timestamp", watermark).where(begins | ends)
    rows = rows.select(kind.alias("op_type"), key.alias("correlation_id"), "timestamp", F.unix_micros("timestamp").alias("at_us"), "seq", begins.alias("starts"), "name").where("correlation_id is not null")
    return rows.groupBy("op_type", "correlation_id").applyInPandasWithState(_pair, RESULT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
