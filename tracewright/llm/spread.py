"""Distribution helpers: checkpoints, hash chunks, packed exchanges and global prefix sums."""

from __future__ import annotations

import ctypes
import inspect
import math
import tempfile

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.kernels import NULL_ID


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ready(spark: SparkSession) -> None:
    """Set a checkpoint folder on a single machine where none is named, and bound the Arrow batches."""
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tracewright-"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def cut(df: DataFrame, parts: int | None = None) -> DataFrame:
    """The same rows, read from the shared checkpoint folder: lineage ends here. parts: partitions at most, for tables of few rows."""
    ready(df.sparkSession)
    return (df.coalesce(parts) if parts else df).checkpoint()


def parts_for(rows: int, each: int = 100_000) -> int:
    """Partitions for a table of so many narrow rows: a few rows don't need a file in every task of a shuffle."""
    return max(1, math.ceil(rows / each))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(kernel):
    """The kernel, of one table or two, which afterwards gives the worker's free memory back: workers live on from task to task."""
    def one(table):
        try:
            return kernel(table)
        finally:
            _give_back()

    def two(left, right):
        try:
            return kernel(left, right)
        finally:
            _give_back()

    return one if len(inspect.signature(kernel).parameters) == 1 else two


def text_bytes(df: DataFrame) -> int:
    return int(df.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0)


#: Bytes of text in a hash chunk, about: what one task holds at once.
CHUNK = 10 << 20


def chunk_count(df: DataFrame, each: int = CHUNK) -> int:
    """Hash chunks, so that each holds about that many bytes of text: one task's memory does not grow with the table."""
    return max(partitions(df.sparkSession), math.ceil(text_bytes(df) / each))


def keyed(df: DataFrame, chunks: int, *carry: str) -> DataFrame:
    """doc_id, text and the chunk of each document, and the columns to carry; other columns go, NULL ids become NULL_ID."""
    doc = doc_key(F.col("doc_id"))
    return df.select(F.pmod(F.xxhash64(doc), F.lit(chunks)).cast("int").alias("chunk"), doc.alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *carry)


def doc_key(doc: Column) -> Column:
    """A doc_id as a long that is never NULL."""
    return F.coalesce(doc.cast("long"), F.lit(NULL_ID))


def given(doc: Column) -> Column:
    """A NULL_ID as NULL again."""
    return F.nullif(doc, F.lit(NULL_ID))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob; bytes of equal weight lie together, which suits sorted numbers."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts.append(f"{a.dtype.str},{len(a)};".encode())
        parts.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(data):
        head = data.index(b";", at)
        kind, n = data[at:head].decode().split(",")
        dtype, n = np.dtype(kind), int(n)
        at = head + 1
        planes = np.frombuffer(data, np.uint8, n * dtype.itemsize, at).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype))
        at += n * dtype.itemsize
    return out


def pack_sorted(sorted_values: np.ndarray) -> np.ndarray:
    """Ascending uint64 as steps, for pack(); np.cumsum undoes it."""
    return np.diff(sorted_values, prepend=np.uint64(0))


def running(df: DataFrame, order: list, value: str, name: str = "upto") -> DataFrame:
    """df with the sum of value over all rows up to this one in a global order, itself included.

    The rows are range-partitioned and sorted, each partition adds up its own
    rows, and one number a partition comes to the driver. order must tell rows
    apart, except rows that are alike. The result is checkpointed, so that the
    partitions that were added up are those that are used.
    """
    spark = df.sparkSession
    local = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType()), T.StructField("__pid", T.IntegerType())])
    at = df.columns.index(value)

    def add(batches):
        from pyspark import TaskContext

        pid, carry = TaskContext.get().partitionId(), 0
        for b in batches:
            sums = np.cumsum(b.column(at).fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False)) + carry
            if len(sums):
                carry = int(sums[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sums, pa.int64()), pa.array(np.full(len(sums), pid, np.int32))], names=[*b.schema.names, name, "__pid"])

    local = cut(local.mapInArrow(add, schema))
    tops = {r["__pid"]: r["top"] for r in local.groupBy("__pid").agg(F.max(name).alias("top")).collect()}
    offset, rows = 0, []
    for pid in sorted(tops):
        rows.append((pid, offset))
        offset += tops[pid]
    offsets = spark.createDataFrame(rows, "`__pid` int, `__before` long")
    return local.join(F.broadcast(offsets), "__pid").withColumn(name, F.col(name) + F.col("__before")).drop("__pid", "__before")


#: Rows of two or three numbers that are broadcast at most; beyond, a join shuffles both sides.
SMALL = 200_000
#: Links that one task joins up; beyond, rounds over DataFrames do.
LINKS = 1 << 20


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has few rows. df must be narrow and cheap to count."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def _union(batches):
    up: dict[int, int] = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "component"])


def components(links: DataFrame, most: int = LINKS) -> DataFrame:
    """Connected components of an undirected edge list (a, b) without nulls: node, component = smallest node reachable.

    Up to `most` links meet in one task; more go through alternating large-star
    and small-star rounds over DataFrames, each checkpointed, of which only two
    counters come to the driver.
    """
    links = cut(links)
    if links.limit(most + 1).count() <= most:
        return cut(links.coalesce(1).mapInArrow(_union, "node long, component long"))
    itself = links.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    count = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    seen = count(edges)
    parts = parts_for(seen["n"])  # a round makes no edges beyond twice those it has
    edges = edges.coalesce(parts)
    while True:
        ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        both = edges.select(F.inline(ways))
        lows = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = cut(both.join(lows, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), parts)
        lows = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lows, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        edges = cut(small.select("e.a", "e.b").where("a <> b").distinct(), parts)
        now = count(edges)
        if seen == now:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).union(itself.join(edges, F.col("node") == F.col("a"), "left_anti")).distinct()
    return cut(edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").union(roots), parts)
