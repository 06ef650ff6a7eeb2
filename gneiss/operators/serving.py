"""Ranking, exclusion, grouped top-k and three-valued set queries over a score table.

Every query of N features is one scan with a pushed-down IN filter and one aggregation by entity
(conditional columns), instead of N joins. Rows: (feature, entity, score).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.stats import argmin_name, selectivity, strict_min
from gneiss.operators.running import running_sums
from gneiss.operators.similarity import nearest

DIGITS = 6


def by_feature(scores: DataFrame, features: Sequence[str], feature: str, entity: str, score: str) -> DataFrame:
    """One row per entity with a column s0, s1, .. per feature, NULL where it has no score."""
    picked = scores.where(F.col(feature).isin(*features))
    return picked.groupBy(entity).agg(*[F.max(F.when(F.col(feature) == f, F.col(score))).alias(f"s{i}") for i, f in enumerate(features)])


def rank_one(scores: DataFrame, wanted: str, feature: str, entity: str, score: str, top_n: int) -> DataFrame:
    """Best entities of one feature: score descending, then entity; NULL scores are left out."""
    rows = scores.where((F.col(feature) == wanted) & F.col(score).isNotNull())
    return rows.select(entity, F.round(score, DIGITS).alias("score")).orderBy(F.desc("score"), entity).limit(top_n)


def joint(scores: DataFrame, features: Sequence[str], feature: str, entity: str, score: str, tie_order: str = "query") -> DataFrame:
    """(entity, s0.., joint_score, limiting): weakest link of the features, entities with every score only."""
    wide = by_feature(scores, features, feature, entity, score)
    columns = {f: F.col(f"s{i}") for i, f in enumerate(features)}
    order = list(features) if tie_order == "query" else sorted(features)
    out = wide.withColumn("joint_score", strict_min(list(columns.values()))).withColumn("limiting", argmin_name(columns, order))
    return out.where(F.col("joint_score").isNotNull())


def rank_joint(scores: DataFrame, features: Sequence[str], feature: str, entity: str, score: str, floor: float = 0.5, top_n: int = 20) -> DataFrame:
    """Entities whose weakest score reaches ``floor``, with how many do (``total_passing``)."""
    passing = joint(scores, features, feature, entity, score).where(F.col("joint_score") >= floor)
    total = passing.agg(F.count("*").alias("total_passing"))
    best = passing.orderBy(F.desc("joint_score"), entity).limit(top_n)
    return best.join(F.broadcast(total))  # one row


def rank_excluding(scores: DataFrame, wanted: Sequence[str], unwanted: Sequence[str], feature: str, entity: str, score: str, floor: float | None = None, top_n: int = 20) -> DataFrame:
    """(entity, wanted_score, selectivity): min(wanted) x prod(1 - unwanted), best first.

    Entities without one of the scores cannot be told and are left out; ``floor`` bounds the wanted score.
    """
    every = [*wanted, *unwanted]
    wide = by_feature(scores, every, feature, entity, score)
    columns = [F.col(f"s{i}") for i in range(len(every))]
    least = strict_min(columns[: len(wanted)])
    scored = wide.select(entity, least.alias("wanted_score"), selectivity(least, columns[len(wanted) :]).alias("selectivity"))
    scored = scored.where(F.col("selectivity").isNotNull())
    if floor is not None:
        scored = scored.where(F.col("wanted_score") >= floor)
    return scored.orderBy(F.desc_nulls_last("selectivity"), entity).limit(top_n)


def grouped_top(metric: DataFrame, entity: str, stratum: str, value: str, groups: int = 10, per_group: int = 5) -> DataFrame:
    """The best ``per_group`` of each of the best ``groups`` strata (by their own best), with both ranks.

    ``rank_global`` shares ranks among ties and counts entities without a stratum too; those are in no group.
    """
    known = metric.where(F.col(value).isNotNull())
    # rank() over everything would put all rows into one task: ranks come from the counts of distinct values.
    levels = known.groupBy(value).agg(F.count("*").alias("__c"))
    in_stratum = known.where(F.col(stratum).isNotNull())
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(F.desc(value), F.asc(entity)))
    best = in_stratum.withColumn("rank_within", place).where(F.col("rank_within") <= per_group)
    heads = best.where(F.col("rank_within") == 1).orderBy(F.desc(value), stratum).limit(groups).select(stratum)
    kept = best.join(F.broadcast(heads), stratum, "left_semi")  # at most `groups` rows
    kept_values = kept.select(F.col(value).alias("__v")).distinct()  # groups x per_group at most
    above = levels.join(F.broadcast(kept_values), F.col(value) > F.col("__v")).groupBy("__v").agg(F.sum("__c").alias("__above"))
    return kept.join(F.broadcast(above), F.col(value) == F.col("__v"), "left").select(
        entity, stratum, value, "rank_within", (F.coalesce("__above", F.lit(0)) + 1).alias("rank_global")
    )


def detail(scores: DataFrame, wanted: str, entity_value: object, feature: str, entity: str, score: str) -> DataFrame:
    """(entity, score, rank, total) of one entity for one feature: rank is 1 + how many are higher."""
    rows = scores.where((F.col(feature) == wanted) & F.col(score).isNotNull())
    own = rows.where(F.col(entity) == entity_value).select(F.col(entity), F.col(score).alias("__s"))
    counts = rows.join(F.broadcast(own.select("__s"))).agg(F.count_if(F.col(score) > F.col("__s")).alias("__h"), F.count("*").alias("total"))  # one row
    return own.join(F.broadcast(counts)).select(entity, F.round("__s", DIGITS).alias("score"), (F.col("__h") + 1).alias("rank"), "total")


def able(scores: DataFrame, features: Sequence[str], feature: str, entity: str, score: str) -> DataFrame:
    """(entity) of those with a score for every feature of the query."""
    counted = scores.where(F.col(feature).isin(*features) & F.col(score).isNotNull()).groupBy(entity).agg(F.count_distinct(feature).alias("__f"))
    return counted.where(F.col("__f") == len(set(features))).select(entity)


def alternatives(neighbours: DataFrame, scores: DataFrame, features: Sequence[str], feature: str, entity: str, score: str, n: int = 5) -> DataFrame:
    """(entity, neighbour, rank, similarity): up to ``n`` of the given neighbours with a score for every feature of the query.

    A list that was cut before holds only the able ones of its best; ``nearest_able`` finds the nearest of all.
    """
    kept = neighbours.join(able(scores, features, feature, entity, score).withColumnRenamed(entity, "neighbour"), "neighbour", "left_semi")
    place = F.row_number().over(Window.partitionBy(entity).orderBy(F.desc("similarity"), F.asc("neighbour")))
    return kept.select(entity, "neighbour", place.alias("rank"), "similarity").where(F.col("rank") <= n)


def nearest_able(base: DataFrame, queries: DataFrame, key: str, vector: str, scores: DataFrame, features: Sequence[str], feature: str, entity: str, score: str, n: int = 5) -> DataFrame:
    """(entity, neighbour, rank, similarity): the ``n`` nearest of all rows of ``base`` with a score for every feature of the query."""
    candidates = base.join(able(scores, features, feature, entity, score).withColumnRenamed(entity, key), key, "left_semi")
    return nearest(candidates, queries, key, vector, n).select(F.col("query").alias(entity), "neighbour", "rank", "similarity")


def truth(value: Column, threshold: float, band: float = 0.0) -> Column:
    """Whether a value exceeds a threshold; NULL where it is unmeasured or within ``band`` of it."""
    return F.when(F.abs(value - threshold) > band, value > threshold) if band else value > threshold


def set_query(wide: DataFrame, entity: str, terms: dict[str, Column]) -> DataFrame:
    """(entity, terms.., verdict, bucket, blame): three-valued AND of the terms.

    Matches, Possible (some term unknown, none false) or Excluded; ``blame`` lists the terms that are
    not true. SQL's own three-valued logic gives NOT and AND over unmeasured terms.
    """
    verdict = F.lit(True)
    for t in terms.values():
        verdict = verdict & t
    blame = F.array_compact(F.array(*[F.when(~F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in terms.items()]))
    named = wide.select(F.col(entity), *[t.alias(k) for k, t in terms.items()], verdict.alias("verdict"), blame.alias("blame"))
    bucket = F.when(F.col("verdict").isNull(), "Possible").when(F.col("verdict"), "Matches").otherwise("Excluded")
    return named.withColumn("bucket", bucket)


def bucket_counts(answers: DataFrame, stratum: str) -> DataFrame:
    """(stratum, Matches, Possible, Excluded), most matches first."""
    got = answers.groupBy(stratum).agg(*[F.count_if(F.col("bucket") == b).alias(b) for b in ("Matches", "Possible", "Excluded")])
    return got.orderBy(F.desc("Matches"), stratum)


def coverage(answers: DataFrame, terms: Sequence[str]) -> DataFrame:
    """One row: entities, those with every term resolved, per-term counts and the ratio to independence."""
    known = F.lit(True)
    for t in terms:
        known = known & F.col(t).isNotNull()
    n = F.count("*")
    expected = F.lit(1.0)
    for t in terms:
        expected = expected * (F.count(t) / n)
    return answers.agg(
        n.alias("n"), F.count_if(known).alias("n_joint"), *[F.count(t).alias(f"n_{t}") for t in terms],
        ((F.count_if(known) / n) / F.nullif(expected, F.lit(0.0))).alias("independence_ratio"),
    )


def evidence_order(df: DataFrame, confirms: str, vector: Sequence[str], contradicts: str) -> DataFrame:
    """``band``: entities by confirming evidence, then the vector, then fewest contradictions; equal keys share a band."""
    keys = [F.desc(confirms), *[F.desc_nulls_last(v) for v in vector], F.asc(contradicts)]
    names = [confirms, *vector, contradicts]
    # Distinct keys may be as many as entities, so they are numbered over range-sorted pieces.
    bands = running_sums(df.select(*names).distinct(), [], keys, {"__one": F.lit(1)}).withColumnRenamed("__one_upto", "band").drop("__one_all")
    condition = F.lit(True)
    right = bands.select(*[F.col(n).alias(f"__{n}") for n in names], "band")
    for n in names:
        condition = condition & F.col(n).eqNullSafe(F.col(f"__{n}"))
    return df.join(right, condition).drop(*[f"__{n}" for n in names])


#: Bounds of a request.
MOST_FEATURES, MOST_STRATA, MOST_ROWS = 10, 5, 200


def checked_request(features: Sequence[str], strata: Sequence[str] = (), floor: float = 0.5, top_n: int = 30) -> None:
    """Raise ValueError for a request outside the service's bounds, naming what is wrong."""
    if not 1 <= len(features) <= MOST_FEATURES:
        raise ValueError(f"1 to {MOST_FEATURES} features, not {len(features)}")
    if len(strata) > MOST_STRATA:
        raise ValueError(f"at most {MOST_STRATA} strata, not {len(strata)}")
    if not 0.0 <= floor <= 1.0:
        raise ValueError(f"a floor between 0 and 1, not {floor}")
    if not 1 <= top_n <= MOST_ROWS:
        raise ValueError(f"1 to {MOST_ROWS} rows, not {top_n}")


def similar_per_axis(base: DataFrame, asked: DataFrame, entity: str, axes: dict[str, str], label: str, k: int = 10) -> DataFrame:
    """(entity, axis, covered, rank, neighbour, similarity, same_label): one list per axis, never fused; an entity that an axis
    does not measure has one row of that axis with ``covered`` false."""
    names = base.select(F.col(entity).alias("neighbour"), F.col(label).alias("__other"))
    own = base.select(F.col(entity).alias("query"), F.col(label).alias("__own"))
    out = None
    for axis, vector in axes.items():
        measured = base.where(F.col(vector).isNotNull())
        there = measured.join(asked.select(entity), entity, "left_semi")
        found = nearest(measured, there, entity, vector, k).join(names, "neighbour", "left").join(own, "query", "left")
        rows = found.select(F.col("query").alias(entity), F.lit(axis).alias("axis"), F.lit(True).alias("covered"), "rank", "neighbour", "similarity", (F.col("__own") == F.col("__other")).alias("same_label"))
        gone = asked.select(entity).join(measured.select(entity), entity, "left_anti").select(
            entity, F.lit(axis).alias("axis"), F.lit(False).alias("covered"), F.lit(None).cast("int").alias("rank"), F.lit(None).cast(base.schema[entity].dataType).alias("neighbour"),
            F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("boolean").alias("same_label"),
        )
        part = rows.unionByName(gone)
        out = part if out is None else out.unionByName(part)
    return out
