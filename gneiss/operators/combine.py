"""Combining z-scores of several sources: the Stouffer family, residuals and the bounded score."""

from __future__ import annotations

from collections.abc import Sequence
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.stats import correlation, phi, signs_disagree
from gneiss.operators.correlate import spearman_by
from gneiss.operators.zscores import shrunken_z, standardise
from gneiss.session import written

#: Fixed values of the scoring rules.
W_FIRST, W_SECOND = sqrt(1.431), sqrt(1.45)
W_NORM = sqrt(1.431 + 1.45)
RHO_PRIOR, K_RHO, MIN_SHARED = 0.353, 30.0, 30


def stouffer_by_coverage(z: DataFrame, feature: str, entity: str, source: str, value: str, n_sources: int | None = None) -> DataFrame:
    """(feature, entity, z_t, k_src): sum(w z) / sqrt(sum w^2) with w = sqrt(entities the source has for the feature).

    With ``n_sources`` N, a pair seen by n < N sources is divided by sqrt(N / n). Missing z's do not vote.
    """
    known = z.where(F.col(value).isNotNull())
    weights = known.groupBy(feature, source).agg(F.sqrt(F.count_distinct(entity).cast("double")).alias("__w"))
    got = known.join(weights, [feature, source]).groupBy(feature, entity).agg(
        (F.sum(F.col("__w") * F.col(value)) / F.sqrt(F.sum(F.col("__w") ** 2))).alias("z_t"),
        F.count_distinct(source).alias("k_src"),
    )
    if n_sources is None:
        return got
    thin = F.col("k_src") < n_sources
    return got.withColumn("z_t", F.when(thin, F.col("z_t") / F.sqrt(F.lit(float(n_sources)) / F.col("k_src"))).otherwise(F.col("z_t")))


def stouffer_two_level(z: DataFrame, feature: str, entity: str, source: str, method: str, value: str, weight: str) -> DataFrame:
    """Methods of one source by sqrt(weight), then the sources alike: (feature, entity, z_t, k_src, k_methods)."""
    w = F.sqrt(F.col(weight).cast("double"))
    inner = z.where(F.col(value).isNotNull()).groupBy(feature, entity, source).agg(
        (F.sum(w * F.col(value)) / F.sqrt(F.sum(w * w))).alias("__z"), F.count_distinct(method).alias("__k")
    )
    return inner.groupBy(feature, entity).agg(
        (F.sum("__z") / F.sqrt(F.count("*").cast("double"))).alias("z_t"), F.count("*").alias("k_src"), F.sum("__k").alias("k_methods")
    )


def stouffer_simple(z: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """sum(z) / sqrt(k), with the mean and the spread of the z's."""
    return z.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        (F.sum(value) / F.sqrt(F.count("*").cast("double"))).alias("z_t"), F.avg(value).alias("z_mean"),
        (F.max(value) - F.min(value)).alias("z_spread"), F.count("*").alias("k_src"),
    )


def stouffer_pair(a: Column, b: Column, rho: float, w_a: float = 1.0, w_b: float = 1.0) -> Column:
    """Two z's of known correlation; one alone passes through."""
    both = (w_a * a + w_b * b) / sqrt(w_a**2 + w_b**2 + 2 * w_a * w_b * rho)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def stouffer_correlated(columns: dict[str, Column], rho: dict[tuple[str, str], float]) -> Column:
    """sum(z) / sqrt(sum over present pairs of R), any number of correlated sources; NULL if none is present."""
    names = list(columns)
    total, variance = F.lit(0.0), F.lit(0.0)
    for i, a in enumerate(names):
        there = columns[a].isNotNull().cast("double")
        total = total + F.coalesce(columns[a], F.lit(0.0))
        variance = variance + there
        for b in names[i + 1 :]:
            r = rho.get((a, b), rho.get((b, a), 0.0))
            variance = variance + 2.0 * r * there * columns[b].isNotNull().cast("double")
    return F.when(variance > 0, total / F.sqrt(variance))


def weighted_present(columns: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean over the layers that are present, weights renormalised; NULL if none is."""
    top, bottom = F.lit(0.0), F.lit(0.0)
    for k, c in columns.items():
        top = top + F.coalesce(c, F.lit(0.0)) * weights[k]
        bottom = bottom + F.when(c.isNotNull(), weights[k]).otherwise(0.0)
    return F.when(bottom > 0, top / bottom)


def regression_slopes(both: DataFrame, feature: str, x: str, y: str) -> DataFrame:
    """(feature, n_shared, rho, beta): shrunken correlation times shrunken SD ratio of y on x over shared rows.

    Features of fewer than ``MIN_SHARED`` rows take the prior correlation and the overall SD ratio.
    """
    overall = both.agg(F.stddev_samp(x).alias("__sx"), F.stddev_samp(y).alias("__sy"))
    each = both.groupBy(feature).agg(
        F.count("*").alias("n_shared"),
        correlation(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))).alias("__r"),
        F.stddev_samp(x).alias("__x"),
        F.stddev_samp(y).alias("__y"),
    )
    n = F.col("n_shared")
    lam, w = K_RHO / (n + K_RHO), n / (n + 25.0)
    rho = lam * RHO_PRIOR + (1 - lam) * F.coalesce("__r", F.lit(RHO_PRIOR))
    sx = F.sqrt(w * F.col("__x") ** 2 + (1 - w) * F.col("__sx") ** 2)
    sy = F.sqrt(w * F.col("__y") ** 2 + (1 - w) * F.col("__sy") ** 2)
    enough = n >= MIN_SHARED
    return each.join(F.broadcast(overall)).select(  # one row
        feature, "n_shared",
        F.when(enough, rho).otherwise(F.lit(RHO_PRIOR)).alias("rho"),
        F.when(enough, F.when(sx > 0, rho * sy / sx).otherwise(rho))
        .otherwise(F.when(F.col("__sx") > 0, RHO_PRIOR * F.col("__sy") / F.col("__sx")).otherwise(RHO_PRIOR)).alias("beta"),
    )


def core_score(first: DataFrame, second: DataFrame, feature: str, entity: str, z: str, n_src: str, fill_holes: bool = False) -> DataFrame:
    """(feature, entity, core_score, n_layers, combination_variant) from two layers' combined z-scores.

    The first layer is standardised within (feature, n_src); the second is regressed on it, the
    residual standardised with shrunken spread, and both are combined with fixed weights. Pairs on
    which both layers are sure and of opposite sign use the second's own standardised z instead.
    Entities without any second-layer row and features without any are scored by the first alone.
    A pair that only lacks its own second-layer value is dropped, as the rule has it, unless
    ``fill_holes``.
    """
    a = standardise(first.where(F.col(z).isNotNull()), feature, n_src, z, "a_std").select(feature, entity, F.col(z).alias("a"), "a_std")
    b = standardise(second.where(F.col(z).isNotNull()), feature, n_src, z, "b_std").select(feature, entity, F.col(z).alias("b"), "b_std")
    a, b = written(a), written(b)  # each is read for the pairs, the lone ones, and the lines and features both have
    both = a.join(b, [feature, entity])
    slopes = regression_slopes(both, feature, "a", "b").select(feature, "beta")
    residual = both.join(slopes, feature).withColumn("resid", F.col("b") - F.col("beta") * F.col("a"))
    scored = shrunken_z(residual, feature, "resid", "resid_z")
    swap = signs_disagree(F.col("a_std"), F.col("b_std"))
    plain = (W_FIRST * F.col("a_std") + W_SECOND * F.col("resid_z")) / W_NORM
    direct = (W_FIRST * F.col("a_std") + W_SECOND * F.col("b_std")) / W_NORM
    two = scored.select(
        feature, entity, F.when(swap, direct).otherwise(plain).alias("cz"), F.lit(2).alias("n_layers"),
        F.when(swap, "C_regime3").otherwise("A").alias("combination_variant"),
    )
    if fill_holes:
        lone = a.join(both.select(feature, entity), [feature, entity], "left_anti")
    else:
        shared_lines, shared_features = both.select(entity).distinct(), both.select(feature).distinct()
        lone = a.join(shared_lines, entity, "left_anti").unionByName(
            a.join(shared_lines, entity, "left_semi").join(shared_features, feature, "left_anti")
        )
    one = lone.select(
        feature, entity, (W_FIRST / W_NORM * F.col("a_std")).alias("cz"), F.lit(1).alias("n_layers"),
        F.lit("A_fallback_scaled").alias("combination_variant"),
    )
    out = two.unionByName(one).where(F.col("cz").isNotNull())
    return out.select(feature, entity, phi("cz").alias("core_score"), "n_layers", "combination_variant")


def residual_agreement(wide: DataFrame, feature: str, first: str, b: str, c: str, least: int = 3) -> DataFrame:
    """(feature, n_overlap, rho_resid): rank correlation of what two platforms leave beyond the first layer.

    Each platform's correlation with the first layer is shrunk toward the prior by K_RHO / (n + K_RHO), taken as the
    prior under ``K_RHO`` rows or where it is undefined, and kept within 0.99; residuals are compared where all three are measured.
    """
    figures = wide.groupBy(feature)
    slope = {}
    for name in (b, c):
        n, r = F.count(F.when(F.col(first).isNotNull(), F.col(name))), correlation(first, name)
        share = F.when(n >= K_RHO, K_RHO / (n + K_RHO)).otherwise(1.0)
        known = F.coalesce(F.when(~F.isnan(r), r), F.lit(RHO_PRIOR))
        slope[name] = F.greatest(F.least(share * RHO_PRIOR + (1 - share) * known, F.lit(0.99)), F.lit(-0.99)).alias(f"__p_{name}")
    slopes = figures.agg(*slope.values())
    both = wide.where(F.col(first).isNotNull() & F.col(b).isNotNull() & F.col(c).isNotNull()).join(slopes, feature)
    residuals = both.select(feature, (F.col(b) - F.col(f"__p_{b}") * F.col(first)).alias("x"), (F.col(c) - F.col(f"__p_{c}") * F.col(first)).alias("y"))
    return spearman_by(residuals, [feature], "x", "y", least).select(feature, F.col("n").alias("n_overlap"), F.col("rho").alias("rho_resid"))


def heterogeneity(df: DataFrame, feature: str, source: str, value: str, least: int = 2) -> DataFrame:
    """(feature, k, q, i2): Cochran's Q of the sources' means, weighted by n / variance, and the share of variation beyond chance.

    Sources of fewer than two values or without spread are left out; features with fewer than ``least`` sources too.
    """
    each = df.groupBy(feature, source).agg(F.avg(value).alias("m"), (F.count(value) / F.nullif(F.var_samp(value), F.lit(0.0))).alias("w")).where(F.col("w").isNotNull())
    w, m = F.col("w"), F.col("m")
    got = each.groupBy(feature).agg(F.count("*").alias("k"), F.sum(w).alias("sw"), F.sum(w * m).alias("swm"), F.sum(w * m * m).alias("swmm")).where(F.col("k") >= least)
    q = F.greatest(F.lit(0.0), F.col("swmm") - F.col("swm") * F.col("swm") / F.col("sw"))
    return got.select(feature, "k", q.alias("q"), F.when(q > 0, F.greatest(F.lit(0.0), (q - (F.col("k") - 1)) / q)).otherwise(0.0).alias("i2"))


def platform_score(z: DataFrame, conflicting: DataFrame, feature: str, entity: str, source: str, value: str, dropped: str) -> DataFrame:
    """(feature, entity, z_t, n_sources): sources weighted by the root of how many entities each has of the feature.

    The ``dropped`` source's rows of ``conflicting`` features do not count; pairs of few sources are not shrunk.
    """
    kept = z.where(F.col(value).isNotNull()).join(conflicting.select(feature, F.lit(dropped).alias(source)), [feature, source], "left_anti")
    weights = kept.groupBy(feature, source).agg(F.sqrt(F.count_distinct(entity).cast("double")).alias("__w"))
    w = F.col("__w")
    return kept.join(weights, [feature, source]).groupBy(feature, entity).agg(
        (F.sum(w * F.col(value)) / F.sqrt(F.sum(w * w))).alias("z_t"), F.count_distinct(source).alias("n_sources")
    )
