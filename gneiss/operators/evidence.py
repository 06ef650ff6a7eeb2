"""Alteration evidence, routing, tiers, states and the ledger, all as column expressions and two joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.stats import clip, correlation, hill, noisy_or, score_band
from gneiss.operators.ranks import percentile_rank

#: Ordinals of the confidence words.
CONFIDENCE = {"low": 1.0, "medium": 2.0, "high": 3.0}


def mutation_scores(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, p_mutation, max_vep_rank) from max_vep_rank, max_pathogenicity and variant_count; the greatest per pair."""
    p = (
        df.withColumn("__v", F.col("max_vep_rank").cast("double")).withColumn("__b", clip(F.col("variant_count").cast("double"), high=5.0))
        .withColumn("__p1", hill("__v", 2.5, 2)).withColumn("__p2", hill("max_pathogenicity", 0.5, 2)).withColumn("__p3", hill("__b", 3, 1.5))
        .withColumn("__p", F.least(noisy_or("__p1", "__p2", "__p3"), F.lit(1.0)))
    )
    return p.groupBy(*keys).agg(F.max("__p").alias("p_mutation"), F.coalesce(F.max("max_vep_rank"), F.lit(0)).cast("int").alias("max_vep_rank"))


def fusion_scores(df: DataFrame, keys: Sequence[str], boost: float = 0.15) -> DataFrame:
    """(keys, p_fusion) from max_confidence (word), best_ffpm, fusion_count and any_in_frame; capped at 1."""
    word = F.lit(None).cast("double")
    for k, v in CONFIDENCE.items():
        word = F.when(F.lower("max_confidence") == k, v).otherwise(word)
    p = (
        df.withColumn("__c", word).withColumn("__n", F.col("fusion_count").cast("double"))
        .withColumn("__p1", hill("__c", 2, 1.5)).withColumn("__p2", hill("best_ffpm", 0.5, 2)).withColumn("__p3", hill("__n", 2, 2))
    )
    total = noisy_or("__p1", "__p2", "__p3") + F.when(F.col("any_in_frame"), boost).otherwise(0.0)
    return p.groupBy(*keys).agg(F.max(F.least(total, F.lit(1.0))).alias("p_fusion"))


def cna_flags(df: DataFrame, keys: Sequence[str], roles: DataFrame, feature: str) -> DataFrame:
    """(keys, has_cna_alteration, has_cna_context, total_cn_mean) of unambiguous calls, gated by the feature's role."""
    sure = df.where(F.col("cna_call").isNotNull() & (F.col("is_ambiguous") == F.lit(False)))
    joined = sure.join(roles, feature, "left").withColumn("__role", F.coalesce("gene_role", F.lit("unknown")))
    amp, loss = F.col("cna_call") == "amplification", F.col("cna_call") == "deletion"
    hit = (amp & F.col("__role").isin("oncogene", "both")) | (loss & F.col("__role").isin("tsg", "both"))
    return joined.groupBy(*keys).agg(
        F.bool_or(hit).alias("has_cna_alteration"), F.bool_or((amp | loss) & ~hit).alias("has_cna_context"), F.avg("total_cn").alias("total_cn_mean")
    )


def route(scores: DataFrame, mutations: DataFrame, fusions: DataFrame, cna: DataFrame, roles: DataFrame, keys: Sequence[str], feature: str) -> DataFrame:
    """Score rows with their evidence, and evidence without a score as rows of 0 layers.

    A full outer join of the scores with the evidence, gathered first, covers both without a second pass.
    """
    proof = mutations.join(fusions, list(keys), "full_outer").join(cna, list(keys), "full_outer")
    joined = scores.join(proof, list(keys), "full_outer").join(roles, feature, "left")
    mutation, fusion = F.coalesce("p_mutation", F.lit(0.0)), F.coalesce("p_fusion", F.lit(0.0))
    copy, context = F.coalesce("has_cna_alteration", F.lit(False)), F.coalesce("has_cna_context", F.lit(False))
    driver = (mutation >= 0.5) | (fusion >= 0.5) | copy
    loss = F.coalesce(F.col("gene_role").isin("tsg", "both"), F.lit(False)) & (
        copy | ((mutation >= 0.5) & (F.coalesce("max_vep_rank", F.lit(0)) >= 3))
    )
    return joined.select(
        *keys, "core_score", F.coalesce("n_layers", F.lit(0)).alias("n_layers"), mutation.alias("p_mutation"),
        F.coalesce("max_vep_rank", F.lit(0)).alias("max_vep_rank"), fusion.alias("p_fusion"), copy.alias("has_cna_alteration"),
        driver.alias("has_driver_alteration"), ((mutation > 0) | (fusion > 0) | copy | context).alias("has_alteration"),
        loss.alias("is_lof_alteration"), "gene_role",
    )


def tiers(flags: DataFrame, feature: str, top: float = 0.80) -> DataFrame:
    """``flags`` with ``score_rank_pct`` and ``confidence_tier``.

    A driver that is a loss of function counts from the low end of the percentile, every other one (and
    all of features with role both) from the high end.
    """
    ranked = flags.withColumn("score_rank_pct", percentile_rank([feature], "core_score"))
    pct, driver = F.col("score_rank_pct"), F.col("has_driver_alteration")
    loss = F.coalesce(F.col("is_lof_alteration") & (F.coalesce("gene_role", F.lit("")) != "both"), F.lit(False))
    directed = F.when(loss, pct <= 1 - top).otherwise(pct >= top)
    tier = (
        F.when(F.col("core_score").isNull(), "NO_EVIDENCE").when(driver & directed, "HIGH").when(driver, "CONTEXT").when(pct >= top, "MEDIUM").otherwise("LOW")
    )
    return ranked.withColumn("confidence_tier", tier)


def tier_violations(df: DataFrame) -> DataFrame:
    """One row of counts that must all be 0."""
    tier, driver, score = F.col("confidence_tier"), F.col("has_driver_alteration"), F.col("core_score")
    return df.agg(
        F.count_if(tier.isNull()).alias("no_tier"),
        F.count_if(~tier.isin("HIGH", "MEDIUM", "CONTEXT", "LOW", "NO_EVIDENCE")).alias("unknown_tier"),
        F.count_if((tier == "HIGH") & ~driver).alias("high_without_driver"),
        F.count_if((tier == "NO_EVIDENCE") != score.isNull()).alias("evidence_mismatch"),
        F.count_if(tier.isin("LOW", "MEDIUM") & driver).alias("driver_without_context"),
    )


def ledger(df: DataFrame) -> DataFrame:
    """Layers present, consistency of copy number with the role, and the score band, as columns."""
    layer = lambda name, when: F.when(when, F.lit(name))
    layers = F.array_compact(
        F.array(
            layer("rna", F.col("n_layers") >= 1), layer("protein", F.col("n_layers") >= 2), layer("mutation", F.col("p_mutation") > 0),
            layer("fusion", F.col("p_fusion") > 0), layer("cna", F.col("has_cna_alteration")),
        )
    )
    role, amplified = F.coalesce("gene_role", F.lit("")), F.col("has_cna_alteration")
    return df.select(
        "*", layers.alias("layers_present"), F.size(layers).alias("n_layers_present"),
        ((role.contains("oncogene") & amplified) | (role.contains("tsg") & ~amplified)).alias("cna_role_consistent"),
        score_band(F.col("core_score")).alias("essentiality_check"),
    )


def feature_states(df: DataFrame, feature: str, value: str, expressed: float = 1.0, silent: float = 0.20, least: int = 30) -> DataFrame:
    """(feature, n_lines, expressed_share, state): NO_EVIDENCE, UNINFORMATIVE, NEAR_UNIVERSAL, TRIVIALLY_SATISFIED or OK."""
    got = df.groupBy(feature).agg(F.count(value).alias("n_lines"), F.count_if(F.col(value) > expressed).alias("n_expressed"))
    share = F.col("n_expressed") / F.nullif(F.col("n_lines"), F.lit(0))
    state = (
        F.when(F.col("n_lines") < least, "NO_EVIDENCE").when(share < silent, "UNINFORMATIVE").when(share > 0.95, "NEAR_UNIVERSAL")
        .when(F.col("n_expressed") < 10, "TRIVIALLY_SATISFIED").otherwise("OK")
    )
    return got.select(feature, "n_lines", "n_expressed", share.alias("expressed_share"), state.alias("state"))


def corroboration(a: Column, b: Column, tau: float) -> Column:
    """Whether a second source's percentile agrees."""
    return F.when(b.isNull() | a.isNull(), "not_covered").when(F.abs(a - b) <= tau, "corroborated").otherwise("contradicted")


def copy_number_vote(ratio: Column) -> Column:
    """+1 gain, -1 loss, 0 neither, by copy number over ploidy."""
    return F.when(ratio > 1.5, 1).when(ratio < 0.5, -1).when(ratio.isNotNull(), 0)


def ranking_states(scores: DataFrame, feature: str, score: str, outcome: Column, role: str, spread: float = 0.05, against: float = -0.2, least: int = 30, exempt: Sequence[str] = ("tsg",)) -> DataFrame:
    """(feature, n_scored, spread, agreement, state): whether a feature's ranking is worth acting on.

    NO_EVIDENCE under ``least`` scored entities; UNINFORMATIVE where the 90th percentile stands less than ``spread`` above the
    median; CONFLICTING where scores run against the measured ``outcome`` (correlation below ``against``), features of an
    ``exempt`` role aside; else RANKED. An outcome that does not vary tells nothing.
    """
    known = scores.where(F.col(score).isNotNull())
    r = correlation(score, outcome.cast("double"))
    got = known.groupBy(feature).agg(
        F.count("*").alias("n_scored"), (F.percentile(score, F.lit(0.9)) - F.median(score)).alias("spread"), F.when(~F.isnan(r), r).alias("agreement"), F.max(role).alias("__role")
    )
    state = (
        F.when(F.col("n_scored") < least, "NO_EVIDENCE").when(F.col("spread") < spread, "UNINFORMATIVE")
        .when((F.col("agreement") < against) & ~F.coalesce(F.col("__role").isin(*exempt), F.lit(False)), "CONFLICTING").otherwise("RANKED")
    )
    return got.select(feature, "n_scored", "spread", "agreement", state.alias("state"))


def asked_states(asked: DataFrame, query: str, states: DataFrame, feature: str) -> DataFrame:
    """``states`` of the features that were asked for, case aside; UNKNOWN_GENE for what is no feature at all."""
    known = states.select(F.lower(feature).alias("__k"), F.col(feature).alias("resolved"), *[c for c in states.columns if c != feature])
    joined = asked.select(query, F.lower(F.trim(query)).alias("__k")).join(known, "__k", "left").drop("__k")
    return joined.withColumn("state", F.coalesce("state", F.lit("UNKNOWN_GENE")))


def abstentions(df: DataFrame, feature: str, value: str, altered: Column, role: str, expressed: float, silent: float = 0.20, universal: float = 0.95, few: int = 10) -> DataFrame:
    """(feature, abstention): every reason for which a term of the feature would constrain nothing or mislead.

    SILENT_GENE, NEAR_UNIVERSAL_GENE (of NOT expressed), TRIVIALLY_SATISFIED (of NOT altered: fewer than ``few`` altered
    entities), LOSS_IS_PROTEIN_LEVEL (of NOT expressed: a suppressor's loss leaves the transcript intact).
    """
    got = df.groupBy(feature).agg(F.avg((F.col(value) > expressed).cast("double")).alias("s"), F.count_if(altered).alias("a"), F.max(role).alias("r"))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("s") < silent, "SILENT_GENE"), F.when(F.col("s") > universal, "NEAR_UNIVERSAL_GENE"), F.when(F.col("a") < few, "TRIVIALLY_SATISFIED"),
            F.when(F.col("r").isin("tsg", "both"), "LOSS_IS_PROTEIN_LEVEL"),
        )
    )
    return got.select(feature, F.explode(reasons).alias("abstention"))


def altered_or_unknown(sequenced: Column, max_rank: Column, n_rows: Column, listed: Column, high: int = 3, moderate: int = 2) -> Column:
    """Whether an entity is altered: true by a row of high impact, false where it was sequenced and nothing speaks for it, and
    NULL where it was not, or where all four hold: sequenced, no row of high impact, one of moderate impact, feature ``listed``
    as one whose moderate changes can activate."""
    found = F.coalesce(max_rank, F.lit(0))
    return F.when(~sequenced, None).when(found >= high, True).when((found == moderate) & (n_rows > 0) & listed, None).otherwise(False)


def relative_copy_number(copies: DataFrame, keys: Sequence[str], entity: str, total: str) -> DataFrame:
    """(keys, relative): mean copy number over the entity's ploidy, its mean over everything measured."""
    each = copies.where(F.col(total).isNotNull()).groupBy(*keys).agg(F.avg(total).alias("cn"))
    ploidy = copies.groupBy(entity).agg(F.avg(total).alias("ploidy"))
    return each.join(ploidy, entity).select(*keys, (F.col("cn") / F.nullif(F.col("ploidy"), F.lit(0.0))).alias("relative"))
