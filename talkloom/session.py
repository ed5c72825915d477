"""Session defaults and the two ways this library materialises a frame."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "talkloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for (AQE, skew joins, UTC)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that spark.checkpoint.dir names. Where none is set, a local master gets a temporary
    folder; on a cluster, whose machines do not share such a folder, that is an error."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None) or temporary_folder(spark.sparkContext.master)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def temporary_folder(master: str) -> str:
    """A machine's own folder, for tests and other runs in one process."""
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all machines share (master {master})")
    return tempfile.mkdtemp(prefix="spark-")


def materialise(df: DataFrame) -> DataFrame:
    """Write a frame once as a table in the shared checkpoint folder and read it back.

    Several consumers then share one computation, a lost executor does not replay the lineage, and the
    columnar table still gives column pruning, pushdown and true sizes for join choices."""
    folder = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
