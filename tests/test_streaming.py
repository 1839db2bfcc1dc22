import datetime as dt

from tests.entries import entry
from tracewright.schema import ENTRY
from tracewright.streaming.pairing import stream_operations


def test_stream_pairs_and_orphans(spark, tmp_path):
    at = lambda i: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=i)
    rows = [entry(0, "Request", "q", "Send", "0--1"), entry(1, "Request", "q", "Send", "0--1"), entry(3, "Request", "q", "Receive", "0--1"), entry(4, "Request", "q", "Send", "0--2")]
    later = [entry(5 + i, "Request", "z", "Send", f"0--9{i}") for i in range(2)]
    place = ENTRY.fieldNames().index("timestamp")
    late = [(*r[:place], at(300 + 200 * i), *r[place + 1 :]) for i, r in enumerate(later)]
    for k, part in enumerate((rows, late[:1], late[1:])):
        spark.createDataFrame(part, ENTRY).coalesce(1).write.parquet(str(tmp_path / f"in/part{k}"))
    stream = spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = stream_operations(stream).writeStream.format("memory").queryName("paired").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.correlation_id, r.outcome, r.duration_ms) for r in spark.table("paired").collect()}
    assert ("0--1", "completed", 2000) in got and ("0--2", "orphaned", None) in got
