import io
from contextlib import redirect_stdout

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.operators.numbering import timeline_before, timeline_places
from tracewright.schema import TIMELINE


def timeline(spark, n):
    at = F.timestamp_micros(1_700_000_000_000_000 + F.pmod(F.xxhash64("id"), F.lit(10**12)))
    return spark.range(n, numPartitions=7).select(at.alias("timestamp"), F.lit(0).alias("file_idx"), F.col("id").alias("source_line_number"))


def test_slices_are_cut_once(spark):
    """Approximate cuts worked out in each branch of a plan could differ from branch to branch."""
    for numbered in (timeline_before, timeline_places):
        said = io.StringIO()
        with redirect_stdout(said):
            numbered(timeline(spark, 1000)).explain()
        assert "percentile" not in said.getvalue()


def test_entry_before_and_place_of_many_entries(spark):
    rows = timeline(spark, 60_000)
    w = Window.orderBy(*TIMELINE)
    want = rows.withColumn("p", F.lag("timestamp").over(w)).withColumn("n", F.row_number().over(w))
    got = timeline_before(rows).join(timeline_places(rows), [*TIMELINE])
    assert got.count() == 60_000
    assert got.join(want, [*TIMELINE]).where("not (previous <=> p) or place <> n").count() == 0
    assert timeline_before(rows.limit(0)).count() == 0
