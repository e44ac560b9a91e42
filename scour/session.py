"""Session helpers: a tuned local session for tests and bench, and the shared
folder for tables that a job writes between its steps.

On a cluster the operator names that folder in ``spark.checkpoint.dir``; it is
only read here. A folder of our own is made for local masters alone, where
driver and executors are one process; on any other master a missing setting is
an error, because executors would each write to their own disk.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app: str = "scour") -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SCOUR_DRIVER_MEMORY", "16g"))
    )
    if master.startswith("local[") or master == "local":
        builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="scour-ckpt-"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_own: dict[str, str] = {}       # application id -> folder made here (local masters)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, or the context's checkpoint
    folder; on a local master without either, one made for this application."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="scour-ckpt-")
    return _own[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder name in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage in one pass: write ``df`` as a Parquet table in the shared
    folder and read it back. The files survive the loss of any executor.

    ``DataFrame.checkpoint()`` computes the plan once to count and again to
    write the files unless the data is also cached; this writes once."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(_nullable(df)).parquet(path)


def _nullable(df: DataFrame):
    """The schema as Parquet gives it back: every field nullable."""
    from pyspark.sql import types as T

    return T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in df.schema])


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote below the shared folder."""
    if not path.startswith(checkpoint_dir(spark).rstrip("/") + "/"):
        raise ValueError(f"{path} is not below the shared folder")
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Stages:
    """Written tables of one job; ``clear`` deletes them when the job is done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def path(self, name: str) -> str:
        self.paths.append(scratch_path(self.spark, name))
        return self.paths[-1]

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(_nullable(df)).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            discard(self.spark, path)
        self.paths = []
