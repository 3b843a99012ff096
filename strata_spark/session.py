"""Session, shared work folder and size-checked broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 100_000


def build_session(app: str = "strata_spark", cores: int | str = "*") -> SparkSession:
    """Local session for tests and benchmarks; on a cluster use its own session."""
    parts = os.cpu_count() if cores == "*" else int(cores)
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="strata-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder named by ``spark.checkpoint.dir``.

    Where that setting is absent, a session in one process uses a temporary folder; a cluster must name a shared one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="strata-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: later steps start from files, not from its lineage."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_bounded(df: DataFrame, bound: int) -> DataFrame:
    """Broadcast ``df`` when its proven row bound is small, else leave it alone.

    ``bound`` comes from declared levels or the length of a literal table, so
    it does not grow with the data. Without the hint the join is planned from
    runtime sizes.
    """
    return F.broadcast(df) if bound <= MAX_BROADCAST_ROWS else df


def literal_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A table written in code, broadcast because its length is known here."""
    rows = list(rows)
    return broadcast_bounded(spark.createDataFrame(rows, schema), len(rows))
