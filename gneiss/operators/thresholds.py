"""Thresholds from the data: critical correlations, sample sizes by power, null and matched correlations."""

from __future__ import annotations

import math
from functools import cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.operators.correlate import spearman_by
from gneiss.operators.resampling import digest


def _beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t for p > 1/2, by bisection."""
    low, high = 0.0, 1e6
    for _ in range(90):  # 1e6 halved to below the last bit
        mid = (low + high) / 2
        if 1 - _beta_share(df / 2, 0.5, df / (df + mid * mid)) / 2 < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


@cache
def critical_rho(n: int, alpha: float = 0.05) -> float:
    """Least correlation that is significant at n rows, two-sided."""
    n = max(n, 4)
    t = t_quantile(1 - alpha / 2, n - 2)
    return t / math.sqrt(n - 2 + t * t)


def least_rows(rho: float, alpha: float = 0.05, most: int = 300) -> int:
    """Fewest rows at which ``rho`` is significant."""
    wanted = min(max(abs(rho), 1e-3), 0.999)
    return next((n for n in range(4, most + 1) if critical_rho(n, alpha) <= wanted), most)


def paired_correlations(a: DataFrame, b: DataFrame, feature: str, entity: str, value: str, least: int, seed: int = 0) -> DataFrame:
    """(kind, rho): correlations between two platforms of each feature with itself ("matched") and with the next
    feature in a seeded order ("null")."""
    left = a.groupBy(feature, entity).agg(F.avg(value).alias("__a"))
    right = b.groupBy(feature, entity).agg(F.avg(value).alias("__b"))
    order = Window.orderBy(digest(seed, feature), F.col(feature))  # one row per feature
    ring = left.select(feature).distinct().withColumn("__next", F.coalesce(F.lead(feature).over(order), F.first(feature).over(order)))
    moved = left.join(ring.where(F.col("__next") != F.col(feature)), feature).select(F.col("__next").alias(feature), entity, "__a")
    out = None
    for kind, side in (("matched", left), ("null", moved)):
        rho = spearman_by(side.join(right, [feature, entity]), [feature], "__a", "__b", least).select(F.lit(kind).alias("kind"), "rho")
        out = rho if out is None else out.unionByName(rho)
    return out


def agreement_bounds(correlations: DataFrame, null_share: float = 0.95, matched_share: float = 0.5, gap: float = 0.05) -> DataFrame:
    """One row: ``low`` (a high quantile of the null) and ``high`` (a quantile of the matched, at least ``gap`` above)."""
    null, matched = F.when(F.col("kind") == "null", F.col("rho")), F.when(F.col("kind") == "matched", F.col("rho"))
    got = correlations.agg(F.percentile(null, F.lit(null_share)).alias("n"), F.percentile(matched, F.lit(matched_share)).alias("m"), F.count(null).alias("n_null"), F.count(matched).alias("n_matched"))
    low = F.least(F.greatest("n", F.lit(0.0)), F.lit(0.9))
    return got.select("n_null", "n_matched", low.alias("low"), F.least(F.greatest(low + gap, F.col("m")), F.lit(0.95)).alias("high"))


def derived(correlations: DataFrame, isoform_null: DataFrame, seed_rows: int, alpha: float = 0.05, null_share: float = 0.95, matched_share: float = 0.5, gap: float = 0.05, most: int = 300) -> DataFrame:
    """One row of thresholds: ``isoform_corr`` (a high quantile of correlations between different features), ``agree_low`` and
    ``agree_high`` as in ``agreement_bounds``, and ``min_shared``, the rows at which ``agree_low`` is significant.

    With fewer than 30 null or 10 matched correlations a bound is the correlation that is significant at ``seed_rows``.
    """
    floor = critical_rho(seed_rows, alpha)
    iso = isoform_null.where(F.col("kind") == "null").agg(F.percentile("rho", F.lit(null_share)).alias("q"), F.count("rho").alias("n"))
    iso_bound = F.when(F.col("n") >= 30, F.least(F.greatest("q", F.lit(0.0)), F.lit(0.95))).otherwise(F.lit(floor))
    bounds = agreement_bounds(correlations, null_share, matched_share, gap)
    enough = (F.col("n_matched") >= 10) & (F.col("n_null") >= 30)
    low = F.when(enough, F.col("low")).otherwise(F.lit(floor))
    high = F.when(enough, F.col("high")).otherwise(F.lit(min(floor + max(gap, floor), 0.9)))
    one = iso.select(iso_bound.alias("isoform_corr")).join(bounds.select(low.alias("agree_low"), high.alias("agree_high"), "n_null", "n_matched"))  # one row each
    # The least n whose critical value is at most agree_low, from the table of all candidates.
    table = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(critical_rho(n, alpha)).alias("r")) for n in range(4, most + 1)])
    fits = F.filter(table, lambda x: x["r"] <= F.greatest(F.abs("agree_low"), F.lit(1e-3)))
    return one.withColumn("min_shared", F.coalesce(F.get(fits, F.lit(0))["n"], F.lit(most)))
