"""Hot keys: exact counts, and joins that spread them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_counts(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Exact rows per group, partial counts before the shuffle."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"))


def hot_keys(df: DataFrame, key: str, least: int) -> DataFrame:
    """Keys with at least ``least`` rows: at most rows / ``least`` of them."""
    return group_counts(df.where(F.col(key).isNotNull()), key).where(F.col("n_rows") >= least).select(key)


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str, spread_by: str, salts: int = 16) -> DataFrame:
    """``left`` join ``right`` on ``key``, where ``right`` has one row per key and ``left`` may have hot keys.

    Every key of ``right`` is repeated under ``salts`` salts and the rows of ``left`` choose theirs by
    a hash of ``spread_by``, so no task gets more than 1/``salts`` of a key. Catalyst still broadcasts
    ``right`` where its statistics allow it; then the salt is an ordinary second join column.
    NULL keys meet nothing. ``how`` is inner, left, left_semi or left_anti.
    """
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [key, "__salt"], how).drop("__salt")
