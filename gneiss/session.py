"""Sessions, table access and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "gneiss", cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("GNEISS_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``folder``, a file or a directory of parts."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. A local session without one, as in tests, gets its own;
    a cluster must name one, since a machine's own folder would not reach the other executors."""
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not known:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        known = tempfile.mkdtemp(prefix="gneiss-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(known)
    return known


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read back, so lost executors cost no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a parquet table in the shared checkpoint folder, read back: a cut in the lineage that
    survives lost executors and that several passes can read, each only its columns.

    ``clear_written`` deletes the tables of this process once their results have been read.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.parquet(path)


_WRITTEN: list[str] = []


def clear_written(spark: SparkSession) -> None:
    """Delete the tables that ``written`` made in this process; their DataFrames can no longer be read."""
    jvm = spark.sparkContext._jvm
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
