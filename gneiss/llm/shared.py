"""What several operators of this subpackage use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gneiss.session import written

__all__ = ["tasks", "written"]


def tasks(df: DataFrame | SparkSession) -> int:
    """How many tasks a costly step is cut into: what the cluster runs at once, at least a shuffle's partitions."""
    spark = df if isinstance(df, SparkSession) else df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
