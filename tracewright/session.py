"""Spark sessions as the operators expect them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 4, memory: str = "4g", name: str = "tracewright") -> SparkSession:
    """A session on this machine: UTC, AQE, as many shuffle partitions as cores."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", memory).config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: the cluster's checkpoint folder, or a temporary one on a single machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="tracewright-")


def settled(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder by all tasks at once: lineage ends here, so that one partition after the other can be read at little cost to the driver."""
    spark = df.sparkSession
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()
