"""Wide and long forms, axes, universes and filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.operators.running import running_sums


def melt(df: DataFrame, ids: Sequence[str], features: Sequence[str], feature: str = "feature", value: str = "value") -> DataFrame:
    """Long rows of the wide columns; rows exist only where a value does (NULL and NaN do not)."""
    long = df.unpivot([F.col(c) for c in ids], [F.col(f"`{c}`") for c in features], feature, value)
    return long.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))


def pivot_first(df: DataFrame, ids: Sequence[str], key: str, values: Sequence[str], value: str, agg: str = "max") -> DataFrame:
    """One column per listed key by conditional aggregation: no pass to find the keys, partial sums before the shuffle."""
    f = {"max": F.max, "min": F.min, "avg": F.avg, "sum": F.sum, "median": F.median}[agg]
    return df.groupBy(*ids).agg(*[f(F.when(F.col(key) == v, F.col(value))).alias(str(v)) for v in values])


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key combinations that occur more than once; a strict pivot requires that there are none."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def align(axis: DataFrame, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` on the rows of ``axis``, NULL where it has none."""
    return axis.join(df, list(keys), "left")


def universe_common(sets: Sequence[DataFrame]) -> DataFrame:
    out = sets[0]
    for s in sets[1:]:
        out = out.intersect(s)
    return out


def universe_any(sets: Sequence[DataFrame], roster: DataFrame, key: str) -> DataFrame:
    out = sets[0]
    for s in sets[1:]:
        out = out.union(s)
    return out.distinct().join(roster.select(key).distinct(), key, "left_semi")


def first_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by a total order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__k", place).where(F.col("__k") == 1).drop("__k")


def contains_any(df: DataFrame, columns: Sequence[str], terms: Sequence[str], on_no_match: str = "all") -> DataFrame:
    """Rows where any column contains any term, case aside.

    Without terms all rows. Where nothing matches: all rows ("all", as the service has it) or none ("none",
    as the command line has it). The check for a match is a semi join with one row, not an action.
    """
    if not terms:
        return df
    hit = F.lit(False)
    for c in columns:
        for t in terms:
            hit = hit | F.coalesce(F.lower(c).contains(t.lower()), F.lit(False))
    if on_no_match == "none":
        return df.where(hit)
    any_hit = df.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("__any"))
    return df.join(F.broadcast(any_hit)).where(hit | ~F.col("__any")).drop("__any")  # one row


def keep_dense_features(df: DataFrame, feature: str, entity: str, value: str, most_missing: float = 0.20) -> DataFrame:
    """Rows of features that miss at most this share of all entities."""
    n = df.agg(F.count_distinct(entity).alias("__n"))
    dense = df.groupBy(feature).agg(F.count_distinct(F.when(F.col(value).isNotNull(), F.col(entity))).alias("__c")).join(F.broadcast(n))
    kept = dense.where(1 - F.col("__c") / F.col("__n") <= most_missing).select(feature)
    return df.join(kept, feature, "left_semi")


def top_variance(df: DataFrame, feature: str, value: str, n: int) -> DataFrame:
    """(feature, variance) of the ``n`` features of greatest positive variance, ties by feature."""
    v = df.groupBy(feature).agg(F.var_samp(value).alias("variance")).where(F.col("variance") > 0)
    return v.orderBy(F.desc("variance"), feature).limit(n)


def selective_features(df: DataFrame, feature: str, value: str, least_sd: float = 0.20, least_mean: float = -0.75) -> DataFrame:
    got = df.groupBy(feature).agg(F.stddev_samp(value).alias("sd"), F.avg(value).alias("mean"))
    return got.where((F.col("sd") > least_sd) & (F.col("mean") > least_mean))


def structurally_absent(df: DataFrame, score: str, linked: Column, group: Column, absent_in: Sequence[str]) -> DataFrame:
    """NULL scores of linked features in groups that cannot carry them (unknown groups count as such)."""
    cannot = F.coalesce(F.lower(group), F.lit("unknown")).isin(*absent_in)
    return df.withColumn(score, F.when(F.coalesce(linked, F.lit(False)) & cannot, None).otherwise(F.col(score)))


def exact_label(df: DataFrame, column: str, label: str) -> DataFrame:
    """Rows whose label is ``label``, case aside; NULL labels are none."""
    return df.where(F.lower(column) == label.lower())


def roster_filter(ids: DataFrame, position: str, key: Column, roster: DataFrame, roster_key: str) -> DataFrame:
    """(id, position) of the canonical ids that the roster has, each at the first position it is asked at.

    ``key`` is the canonical form of what was asked, NULL where it is no id at all.
    """
    asked = ids.select(key.alias("id"), F.col(position).alias("position")).where(F.col("id").isNotNull())
    first = asked.groupBy("id").agg(F.min("position").alias("position"))
    return first.join(roster.select(F.col(roster_key).alias("id")).distinct(), "id", "left_semi")


def first_resolved(asked: DataFrame, position: str, resolved: str) -> DataFrame:
    """(resolved, position) of the distinct answers in the order in which they first come up; unresolved ones are left out."""
    known = asked.where(F.col(resolved).isNotNull())
    return known.groupBy(resolved).agg(F.min(position).alias(position))


def top_fraction(df: DataFrame, value: str, ties: Sequence[str], fraction: float, least: int = 10) -> DataFrame:
    """The rows of the greatest values: max(least, floor(n * fraction)) of them, ties by ``ties``. NULL values are left out.

    Places are running counts over range-sorted pieces, so nothing is sorted in one task.
    """
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    ran = running_sums(known, [], [F.desc(value), *[F.asc(t) for t in ties]], {"__r": F.lit(1)})
    return ran.where(F.col("__r_upto") <= F.greatest(F.lit(least), F.floor(F.col("__r_all") * fraction))).drop("__r_upto", "__r_all")


def outer_merge(left: DataFrame, right: DataFrame, keys: Sequence[str], least_matched: int = 1) -> DataFrame:
    """Full outer join that keeps the pairs of either side; an error where fewer than ``least_matched`` pairs meet, which
    tells of keys that are spelled differently rather than of missing rows."""
    flagged = left.withColumn("in_left", F.lit(True)).join(right.withColumn("in_right", F.lit(True)), list(keys), "full_outer")
    matched = flagged.where(F.col("in_left") & F.col("in_right")).limit(least_matched).count()
    if matched < least_matched:
        raise ValueError(f"only {matched} pairs meet: are the keys spelled alike?")
    return flagged.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("in_left", "in_right")})


def snake_case(label: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(label)), r"[ /]", "_")


def vocabulary_label(label: Column, names: dict[str, str]) -> Column:
    """The label in another vocabulary, snake-cased where that has no word for it; NULL stays NULL."""
    entries = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(entries[F.trim(label)], snake_case(label))
