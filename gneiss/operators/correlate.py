"""Correlations and agreement between sources, platforms and replicates of one feature."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.stats import confidence_ramp, correlation
from gneiss.operators.ranks import average_rank


def pearson_by(df: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """(by, n, r) with missing values taken as 0."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), correlation(F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))).alias("r"))


def spearman_by(df: DataFrame, by: Sequence[str], a: str, b: str, least: int = 3) -> DataFrame:
    """(by, n, rho) over rows that have both values; groups of fewer than ``least`` rows or of constant values are left out."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = both.withColumn("__a", average_rank(by, a)).withColumn("__b", average_rank(by, b))
    got = ranked.groupBy(*by).agg(
        F.count("*").alias("n"), correlation("__a", "__b").alias("rho"), F.count_distinct("__a").alias("__da"), F.count_distinct("__b").alias("__db")
    )
    return got.where((F.col("n") >= least) & (F.col("__da") > 1) & (F.col("__db") > 1)).drop("__da", "__db")


def platform_tier(rho: Column) -> Column:
    return F.when(rho >= 0.5, "consistent").when(rho >= 0.3, "cautious").otherwise("conflicting")


def least_pair_rho(long: DataFrame, feature: str, variant: str, entity: str, value: str, overlap: int) -> DataFrame:
    """(feature, n_variants, n_pairs, min_rho): the least Spearman correlation over a feature's pairs of variants.

    The pairs of one feature are its few isoforms'; entities meet by key, not by product.
    """
    mean = long.groupBy(feature, variant, entity).agg(F.avg(value).alias("v"))
    left = mean.select(feature, entity, F.col(variant).alias("p1"), F.col("v").alias("v1"))
    right = mean.select(feature, entity, F.col(variant).alias("p2"), F.col("v").alias("v2"))
    pairs = left.join(right, [feature, entity]).where(F.col("p1") < F.col("p2"))
    rhos = spearman_by(pairs, [feature, "p1", "p2"], "v1", "v2", overlap)
    least = rhos.groupBy(feature).agg(F.count("*").alias("n_pairs"), F.min("rho").alias("min_rho"))
    counts = long.groupBy(feature).agg(F.count_distinct(variant).alias("n_variants"))
    return counts.join(least, feature, "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0)))


def collapse_variants(long: DataFrame, feature: str, variant: str, entity: str, value: str, overlap: int, concordant: float) -> DataFrame:
    """(feature, entity, value, n_variants, rollup): one variant as it is, concordant ones by maximum, others by mean."""
    qc = least_pair_rho(long, feature, variant, entity, value, overlap)
    per_line = long.groupBy(feature, entity, variant).agg(F.avg(value).alias("v")).groupBy(feature, entity).agg(F.max("v").alias("top"), F.avg("v").alias("mean"))
    rollup = F.when(F.col("n_variants") == 1, "single").when(F.col("min_rho") >= concordant, "max").otherwise("mean")
    out = per_line.join(qc.select(feature, "n_variants", rollup.alias("rollup")), feature)
    return out.select(feature, entity, F.when(F.col("rollup") == "max", F.col("top")).otherwise(F.col("mean")).alias("value"), "n_variants", "rollup")


def agreement(a: DataFrame, b: DataFrame, feature: str, entity: str, value: str, least: int) -> DataFrame:
    """(feature, platform_rho, n_shared) between two platforms' means on shared entities."""
    left = a.groupBy(feature, entity).agg(F.avg(value).alias("__p"))
    right = b.groupBy(feature, entity).agg(F.avg(value).alias("__q"))
    got = spearman_by(left.join(right, [feature, entity]), [feature], "__p", "__q", least)
    return got.select(feature, F.col("rho").alias("platform_rho"), F.col("n").alias("n_shared"))


def weigh_by_agreement(z: DataFrame, agreements: DataFrame, feature: str, value: str, n_src: str, low: float, high: float) -> DataFrame:
    """z x confidence where at least two sources were merged; others as they are."""
    joined = z.join(agreements.select(feature, "platform_rho"), feature, "left")
    sure = confidence_ramp(F.col("platform_rho"), low, high)
    return joined.withColumn(value, F.when(F.col(n_src) >= 2, F.col(value) * sure).otherwise(F.col(value)))


def _moments(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Sums over a task's entities for every pair of features a < b both of which an entity has."""
    n = np.zeros((width, width))
    x, xx, xy = np.zeros_like(n), np.zeros_like(n), np.zeros_like(n)
    for batch in batches:
        rows = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, width)
        there = ~np.isnan(rows)
        v, w = np.where(there, rows, 0.0), there.astype(float)
        n += w.T @ w
        x += v.T @ w
        xx += (v * v).T @ w
        xy += v.T @ v
    a, b = np.nonzero(np.triu(n, k=1))
    if len(a):
        yield pa.RecordBatch.from_arrays(
            [pa.array(a), pa.array(b), *[pa.array(m) for m in (n[a, b], x[a, b], x[b, a], xx[a, b], xx[b, a], xy[a, b])]],
            ["i", "j", "n", "x", "y", "xx", "yy", "xy"],
        )


def pair_correlations(long: DataFrame, feature: str, entity: str, value: str, most_features: int = 5000) -> DataFrame:
    """(a, b, n, r) of every pair of features a < b over the entities that have both.

    An entity's values become one vector over the sorted features; a task multiplies its vectors' matrices and yields one
    row per pair, so no pair of values is ever made. Features are a dimension of at most ``most_features``; more
    are an error, since a task holds features x features sums. r is NULL where a feature does not vary. Of several values
    of an (entity, feature) the mean counts; NULL and NaN are missing.
    """
    known = long.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    names = sorted(r[0] for r in known.select(feature).where(F.col(feature).isNotNull()).distinct().limit(most_features + 1).collect())
    if len(names) > most_features:
        raise ValueError(f"more than {most_features} features")
    spark = long.sparkSession
    if len(names) < 2:
        return spark.createDataFrame([], "a string, b string, n bigint, r double")
    one = known.groupBy(entity, feature).agg(F.avg(value).alias("v")).groupBy(entity).agg(F.map_from_entries(F.collect_list(F.struct(feature, "v"))).alias("m"))
    vector = F.transform(F.array(*[F.lit(n) for n in names]), lambda k: F.coalesce(F.col("m")[k], F.lit(float("nan"))))
    fields = "i bigint, j bigint, n double, x double, y double, xx double, yy double, xy double"
    sums = one.select(vector.alias("v")).mapInArrow(partial(_moments, width=len(names)), fields)
    total = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    n, x, y = F.col("n"), F.col("x"), F.col("y")
    vx, vy = F.col("xx") - x * x / n, F.col("yy") - y * y / n
    r = F.when((vx > 1e-12 * F.col("xx")) & (vy > 1e-12 * F.col("yy")), (F.col("xy") - x * y / n) / F.sqrt(vx * vy))
    label = F.array(*[F.lit(k) for k in names])
    return total.select(F.get(label, F.col("i").cast("int")).alias("a"), F.get(label, F.col("j").cast("int")).alias("b"), n.cast("bigint").alias("n"), r.alias("r"))


def partial_correlation(xy: Column, xz: Column, yz: Column) -> Column:
    return (xy - xz * yz) / F.sqrt((1 - xz * xz) * (1 - yz * yz))
