"""Robust z-scores within (source, stratum, feature) groups, and their standardisation.

All windows of one operator share their partition keys, so Catalyst plans one exchange for them. A
group holds one row per entity, hence is bounded by the entity dimension.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.stats import clip
from gneiss.operators.ranks import normal_scores

#: Fixed values of the scoring rules.
MAD_SCALE = 1.4826
MAD_FLOOR = 0.384
MIN_PEERS = 5
SILENT_SHARE = 0.20
EXPRESSED = 1.0


def _deviation(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    w = Window.partitionBy(*by)
    return (
        df.withColumn("__n", F.count(value).over(w))
        .withColumn("__med", F.median(value).over(w))
        .withColumn("__mad", F.median(F.abs(F.col(value) - F.col("__med"))).over(w))
    )


def robust_z(df: DataFrame, by: Sequence[str], value: str, out: str = "z", floor: float = MAD_FLOOR, min_peers: int = MIN_PEERS) -> DataFrame:
    """(x - median) / max(1.4826 MAD, floor) over the non-NULL values of the group; NULL below ``min_peers``."""
    scale = F.greatest(F.col("__mad") * MAD_SCALE, F.lit(floor))
    z = F.when(F.col("__n") >= min_peers, (F.col(value) - F.col("__med")) / scale)
    return _deviation(df, by, value).withColumn(out, z).drop("__n", "__med", "__mad")


def robust_z_or_sd(df: DataFrame, by: Sequence[str], value: str, out: str = "z", min_peers: int = MIN_PEERS) -> DataFrame:
    """Without a floor: a MAD of about 0 gives way to the population SD, and that to 1."""
    w = Window.partitionBy(*by)
    near = lambda x: F.abs(x) <= 1e-8
    mad, sd = F.col("__mad") * MAD_SCALE, F.col("__sd")
    scale = F.when(~near(mad), mad).when(~near(sd), sd).otherwise(F.lit(1.0))
    staged = _deviation(df, by, value).withColumn("__sd", F.stddev_pop(value).over(w))
    z = F.when(F.col("__n") >= min_peers, (F.col(value) - F.col("__med")) / scale)
    return staged.withColumn(out, z).drop("__n", "__med", "__mad", "__sd")


def plain_z(df: DataFrame, by: Sequence[str], value: str, out: str = "z") -> DataFrame:
    """(x - mean) / sample SD; NULL where the SD is 0 or unknown."""
    w = Window.partitionBy(*by)
    sd = F.stddev_samp(value).over(w)
    return df.withColumn(out, F.when(sd > 0, (F.col(value) - F.avg(value).over(w)) / sd))


def silence_guard(df: DataFrame, stratum: Sequence[str], feature: str, entity: str, value: str, z: str, expressed: float = EXPRESSED, least: float = SILENT_SHARE) -> DataFrame:
    """NULL ``z`` of (stratum, feature) groups where under ``least`` of the stratum's entities exceed ``expressed``.

    The denominator is every entity of the stratum, those without a value of the feature included.
    """
    lines = df.groupBy(*stratum).agg(F.count_distinct(entity).alias("__lines"))
    lit_up = F.count_if(F.col(value) > expressed).over(Window.partitionBy(*stratum, feature))
    joined = df.withColumn("__lit", lit_up).join(lines, list(stratum), "left")
    return joined.withColumn(z, F.when(F.col("__lit") / F.col("__lines") >= least, F.col(z))).drop("__lit", "__lines")


@dataclass(frozen=True)
class Regimes:
    """Cuts of the detection share between parametric, ranked and undetected, and the prior weight of the scale."""

    upper: float = 0.9
    lower: float = 0.3
    prior: float = 25.0


def method_z(df: DataFrame, method: str, stratum: str | None, feature: str, entity: str, value: str, floor: str, regimes: Regimes = Regimes()) -> DataFrame:
    """Three-regime z per (method, stratum, feature), with ``det_frac``, ``status`` and ``scale_source`` (which scale the z has).

    Detection share at or above ``upper``: robust z whose scale is shrunk toward the feature's scale
    over the method with weight n / (n + prior), n being all entities of the method's stratum, and
    floored by a tenth of the latter and ``MAD_FLOOR``. From ``lower`` on: inverse-normal midranks.
    Below: no z. Strata of fewer than ``MIN_PEERS`` entities have no data. status: 0 ok, 1 ranked,
    2 below detection, 3 no data; a row without a value is 3. ``stratum`` None scores globally.
    """
    group = [method] + ([stratum] if stratum else [])
    own, overall = Window.partitionBy(*group, feature), Window.partitionBy(method, feature)
    lines = df.groupBy(*group).agg(F.count_distinct(entity).alias("__nb"))
    x = F.col(value)
    staged = (
        df.join(lines, group, "left")
        .withColumn("__med_g", F.median(value).over(overall))
        .withColumn("__mad_g", F.median(F.abs(x - F.col("__med_g"))).over(overall) * MAD_SCALE)
        .withColumn("__mad_g", F.when(F.col("__mad_g") > 1e-9, F.col("__mad_g")).otherwise(0.0))
        .withColumn("__n", F.count(value).over(own))
        .withColumn("__med", F.median(value).over(own))
        .withColumn("__mad", F.coalesce(F.median(F.abs(x - F.col("__med"))).over(own) * MAD_SCALE, F.lit(0.0)))
        .withColumn("det_frac", F.count_if(x >= F.col(floor)).over(own) / F.nullif(F.col("__n"), F.lit(0)))
    )
    ranked = normal_scores(staged, [*group, feature], value, "__mid", form="mid")
    w = F.col("__nb") / (F.col("__nb") + regimes.prior)
    scale = F.sqrt(w * F.col("__mad") ** 2 + (1 - w) * F.col("__mad_g") ** 2)
    scale = F.greatest(scale, 0.1 * F.col("__mad_g"), F.lit(MAD_FLOOR))
    det, enough = F.col("det_frac"), F.col("__nb") >= MIN_PEERS
    z = F.when(enough & (det >= regimes.upper), (x - F.col("__med")) / scale).when(
        enough & (det >= regimes.lower), F.col("__mid")
    )
    status = (
        F.when(x.isNull() | ~enough, 3).when(det >= regimes.upper, 0).when(det >= regimes.lower, 1).when(det < regimes.lower, 2).otherwise(3)
    )
    # 0 no value, 1 the stratum's own scale, 2 blended with the method's, 3 too few entities for any
    source = F.when(x.isNull(), 0).when(~enough, 3).when(w >= 0.9, 1).otherwise(2)
    kept = [c for c in ranked.columns if not c.startswith("__")]
    return ranked.withColumn("z", F.when(x.isNotNull(), z)).withColumn("status", status).withColumn("scale_source", source).select(*kept, "z", "status", "scale_source")


def standardise(df: DataFrame, feature: str, stratum: str, value: str, out: str, thin: int = 5, prior: float = 25.0, bound: float = 5.0) -> DataFrame:
    """(x - median) / SD within (feature, stratum), winsorised; strata of fewer than ``thin`` rows blend median and
    variance with the feature's by weight n / (n + prior). NULL strata form groups of their own."""
    own, overall = Window.partitionBy(feature, stratum), Window.partitionBy(feature)
    least = F.lit(1e-6)
    staged = (
        df.withColumn("__n", F.count("*").over(own))
        .withColumn("__med", F.median(value).over(own))
        .withColumn("__med_g", F.median(value).over(overall))
        .withColumn("__sd_g", F.greatest(F.coalesce(F.stddev_samp(value).over(overall), least), least))
        .withColumn("__sd", F.greatest(F.coalesce(F.stddev_samp(value).over(own), F.col("__sd_g")), least))
    )
    w = F.col("__n") / (F.col("__n") + prior)
    blended = F.sqrt(w * F.col("__sd") ** 2 + (1 - w) * F.col("__sd_g") ** 2)
    is_thin = F.col("__n") < thin
    centre = F.when(is_thin, w * F.col("__med") + (1 - w) * F.col("__med_g")).otherwise(F.col("__med"))
    spread = F.when(is_thin, blended).otherwise(F.col("__sd"))
    z: Column = (F.col(value) - centre) / spread
    return staged.withColumn(out, clip(z, -bound, bound)).drop("__n", "__med", "__med_g", "__sd_g", "__sd")


def shrunken_z(df: DataFrame, feature: str, value: str, out: str, prior: float = 25.0, bound: float = 5.0) -> DataFrame:
    """(x - median) / SD by feature, every feature's SD shrunk toward that of all values by n / (n + prior)."""
    own = Window.partitionBy(feature)
    least = F.lit(1e-6)
    everything = df.agg(F.greatest(F.coalesce(F.stddev_samp(value), least), least).alias("__sd_all"))
    n = F.count("*").over(own)
    w = n / (n + prior)
    own_sd = F.greatest(F.coalesce(F.stddev_samp(value).over(own), least), least)
    staged = df.join(F.broadcast(everything)).withColumn("__sd", F.sqrt(w * own_sd**2 + (1 - w) * F.col("__sd_all") ** 2))  # one row
    z = (F.col(value) - F.median(value).over(own)) / F.col("__sd")
    return staged.withColumn(out, clip(z, -bound, bound)).drop("__sd", "__sd_all")
