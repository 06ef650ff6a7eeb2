"""Sinks: clustered parquet, tables, appends that stay idempotent, JSON and CSV reports, write-if-absent."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, mode: str = "overwrite", compression: str = "zstd") -> None:
    df.write.mode(mode).option("compression", compression).parquet(path)


def clustered(df: DataFrame, path: str, by: Sequence[str], mode: str = "overwrite") -> None:
    """Range-partitioned and sorted by ``by``, so that row-group statistics prune point lookups.

    Keys are stored as they are: filter on the stored spelling, since a function over the column would
    keep the filter out of the scan.
    """
    df.repartitionByRange(*by).sortWithinPartitions(*by).write.mode(mode).option("compression", "zstd").parquet(path)


def spread(df: DataFrame, path: str, by: Sequence[str], salt: str, salts: int = 8, mode: str = "overwrite") -> None:
    """Sorted by ``by`` within files that each hold a share of every value of its first column: row-group statistics prune
    lookups, a hot value lies in ``salts`` tasks, and ``df`` is computed once, which ranges would sample first."""
    placed = df.repartition(by[0], F.pmod(F.xxhash64(salt), F.lit(salts)))
    placed.sortWithinPartitions(*by).write.mode(mode).option("compression", "zstd").parquet(path)


def by_key(df: DataFrame, path: str, key: str, mode: str = "append") -> None:
    """One distributed write with a directory for every value of ``key``, so that readers open only those they ask for."""
    df.repartition(key).write.mode(mode).option("compression", "zstd").partitionBy(key).parquet(path)


def table(df: DataFrame, name: str) -> None:
    """Create or replace a managed table."""
    df.write.mode("overwrite").saveAsTable(name)


def append_once(df: DataFrame, path: str, batch: str, batch_id: object) -> None:
    """A batch's rows in a partition of their own that a repetition overwrites: appending twice changes nothing."""
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        df.withColumn(batch, F.lit(batch_id)).write.mode("overwrite").partitionBy(batch).parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def json_report(df: DataFrame, path: str) -> None:
    """A small report as one JSON lines file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def csv_report(df: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header; arrays and maps as JSON text."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The parquet table at ``path``, made first where it is absent or ``force``."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if force or not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        parquet(make(), path)
    return spark.read.parquet(path)
