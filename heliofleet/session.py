"""Session defaults and lineage cuts."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "heliofleet", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator here relies on (UTC, ANSI, AQE)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def workers_see_package(spark: SparkSession) -> None:
    """Python workers on this machine import the package from where the driver has it; a cluster gets it by --py-files."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), home) if x)


def checkpoint_folder(spark: SparkSession) -> str | None:
    """The cluster's shared folder; none in a local session that names none."""
    known = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return None


def cut_lineage(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once as a table in the shared checkpoint folder and read it back.

    For results that several passes read. A table instead of an RDD checkpoint keeps the scan
    columnar and pruned, and survives the loss of any executor. A local session without the folder keeps it in Spark's storage.
    """
    folder = checkpoint_folder(df.sparkSession)
    if folder is None:
        return df.persist(StorageLevel.DISK_ONLY)
    path = f"{folder.rstrip('/')}/cut-{uuid.uuid4().hex}"
    writer = df.write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
