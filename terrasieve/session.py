"""Session settings and the shared folder used to cut lineage or commit files."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "terrasieve", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators expect (UTC, AQE, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers once a context, so that they needn't have it installed."""
    context = spark.sparkContext
    if getattr(context, "_terrasieve_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="terrasieve-")) / "terrasieve.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, os.path.join(root.name, path.relative_to(root)))
    context.addPyFile(str(archive))
    context._terrasieve_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where it is unset (tests, on a local master) a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="terrasieve-")
        spark.sparkContext.setCheckpointDir(found)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder, so that a lost executor doesn't recompute its past."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def temporary_folder(spark: SparkSession, name: str) -> str:
    """new_folder for what is written only to be read again; it goes when the JVM ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(new_folder(spark, name))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return f"{path.toString()}/data"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def read_spread(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """read, spread over all cores where the files give fewer partitions than that; large tables are never shuffled by it.

    For work in Python on inputs of a few files, which would else run in one task.
    """
    df = read(spark, sf_dir, table)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
