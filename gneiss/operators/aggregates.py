"""Aggregates that SQL engines lack or define otherwise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.operators.running import running_sums
from gneiss.operators.zscores import MAD_SCALE
from gneiss.session import cut


def replicate_median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, n_rep): exact median of the replicates, NULL where all are.

    One exchange and one sort that can spill, instead of a hash map of values per group: the middle rows
    are picked by number. NULL keys form groups.
    """
    w = Window.partitionBy(*keys)
    x, n, k = F.col(value), F.col("__n"), F.col("__k")
    placed = df.select(*keys, value).withColumn("__k", F.row_number().over(w.orderBy(x.asc_nulls_last()))).withColumn("__n", F.count(value).over(w))
    middle = (k == F.floor((n + 1) / 2)) | (k == F.ceil((n + 1) / 2))
    kept = placed.where(middle | (k == 1))
    return kept.groupBy(*keys).agg(F.avg(F.when(middle, x)).alias(value), F.max("__n").alias("n_rep"))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """(by, n, q0, q1 ..): exact quantiles with linear interpolation of groups of any size.

    Values are counted before the shuffle and range-sorted over all tasks; each piece learns how many
    values of its group lie before it from one row per (group, piece), so no task needs a whole group.
    The pieces are written once, because both passes must see the same ones. NULL and NaN values are
    missing; groups with a NULL key are left out.
    """
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    for k in by:
        known = known.where(F.col(k).isNotNull())
    counts = known.groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__c"))
    pieces = cut(counts.repartitionByRange(*by, "__v").withColumn("__p", F.spark_partition_id()))
    order = Window.partitionBy(*by).orderBy("__p")
    sums = pieces.groupBy(*by, "__p").agg(F.sum("__c").alias("__s"))
    sums = sums.select(
        *by, "__p", F.sum("__s").over(Window.partitionBy(*by)).alias("n"),
        F.coalesce(F.sum("__s").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
    )
    upto = F.col("__before") + F.sum("__c").over(Window.partitionBy(*by, "__p").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = pieces.join(sums, [*by, "__p"]).withColumn("__upto", upto)
    aggs, out = [], []
    for i, p in enumerate(probs):
        place = (F.col("n") - 1) * F.lit(float(p)) + 1
        for name, rank in ((f"__l{i}", F.floor(place)), (f"__h{i}", F.ceil(place))):
            aggs.append(F.max(F.when((F.col("__upto") - F.col("__c") < rank) & (rank <= F.col("__upto")), F.col("__v"))).alias(name))
        out.append((F.col(f"__l{i}") + (F.col(f"__h{i}") - F.col(f"__l{i}")) * (place - F.floor(place))).alias(f"q{i}"))
    return ranked.groupBy(*by).agg(F.max("n").alias("n"), *aggs).select(*by, "n", *out)


def counted_quantiles(counts: DataFrame, by: Sequence[str], value: str, picks: Mapping[str, tuple[str, float]]) -> DataFrame:
    """(by, names of ``picks``): exact quantiles with linear interpolation of values that stand once a group with their counts.

    ``picks`` names for each result the count column of its set and the probability; one order of the values serves all
    sets. NULL where a set is empty. Groups of any size, ``by`` may be empty, a NaN is the greatest value.
    """
    sets = list(dict.fromkeys(c for c, _ in picks.values()))
    ran = running_sums(counts, by, [F.col(value)], {f"__{c}": F.col(c) for c in sets})
    aggs, out = [], []
    for name, (c, p) in picks.items():
        upto, place = F.col(f"__{c}_upto"), (F.col(f"__{c}_all") - 1) * F.lit(float(p)) + 1
        for end, rank in (("low", F.floor(place)), ("high", F.ceil(place))):
            aggs.append(F.max(F.when((upto - F.col(c) < rank) & (rank <= upto), F.col(value))).alias(f"__{end}_{name}"))
        aggs.append(F.max(place - F.floor(place)).alias(f"__part_{name}"))
        low, high = F.col(f"__low_{name}"), F.col(f"__high_{name}")
        out.append((low + (high - low) * F.col(f"__part_{name}")).alias(name))
    return ran.groupBy(*by).agg(*aggs).select(*by, *out)


def group_mad(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, med, mad, mad_scaled) over non-NULL values."""
    med = F.median(value).over(Window.partitionBy(*by))
    got = df.withColumn("__med", med).groupBy(*by).agg(
        F.max("__med").alias("med"), F.median(F.abs(F.col(value) - F.col("__med"))).alias("mad")
    )
    return got.withColumn("mad_scaled", F.col("mad") * MAD_SCALE)


def spread(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, p05, p25, p50, p75, p95, iqr) by linear interpolation."""
    got = exact_quantiles(df, by, value, (0.05, 0.25, 0.5, 0.75, 0.95))
    names = dict(zip((f"q{i}" for i in range(5)), ("p05", "p25", "p50", "p75", "p95"), strict=True))
    return got.withColumnsRenamed(names).select(*by, *names.values(), (F.col("p75") - F.col("p25")).alias("iqr"))


def variation(value: str) -> list[Column]:
    """Mean, sample SD and coefficient of variation (where the mean is positive)."""
    m, s = F.avg(value), F.stddev_samp(value)
    return [m.alias("mean"), s.alias("std"), F.when(m > 0, s / m).alias("cv")]


def adjusted_skewness(value: str) -> Column:
    """Sample skewness with bias correction; NULL under three values."""
    n = F.count(value)
    return F.when(n > 2, F.skewness(value) * F.sqrt(n * (n - 1.0)) / (n - 2))


def plain_kurtosis(value: str) -> Column:
    """Fourth standardised moment, 3 for the normal distribution."""
    return F.kurtosis(value) + 3


def effective_size(n: str) -> Column:
    """Kish: (sum n)^2 / sum n^2."""
    return F.sum(n).cast("double") ** 2 / F.sum(F.col(n).cast("double") ** 2)


def tie_statistics(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Share of rows in ties, largest block and block at the least value, per group."""
    blocks = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__c"))
    return blocks.groupBy(*by).agg(
        F.sum("__c").alias("n"), F.count("*").alias("n_distinct"),
        (F.coalesce(F.sum(F.when(F.col("__c") > 1, F.col("__c"))), F.lit(0)) / F.sum("__c")).alias("tie_mass"),
        F.max("__c").alias("largest_block"), F.min_by("__c", value).alias("floor_block"), F.count_if(F.col("__c") > 1).alias("n_tie_blocks"),
    )


def cohens_d(df: DataFrame, by: Sequence[str], inside: Column, value: str) -> DataFrame:
    """(by, d, n_in, n_out): difference of means over the pooled sample SD."""
    x = F.col(value)
    a, b = F.when(inside, x), F.when(~inside, x)
    got = df.groupBy(*by).agg(
        F.count(a).alias("n_in"), F.count(b).alias("n_out"), F.avg(a).alias("__ma"), F.avg(b).alias("__mb"),
        F.var_samp(a).alias("__va"), F.var_samp(b).alias("__vb"),
    )
    pooled = F.sqrt(((F.col("n_in") - 1) * F.col("__va") + (F.col("n_out") - 1) * F.col("__vb")) / (F.col("n_in") + F.col("n_out") - 2))
    return got.select(*by, "n_in", "n_out", F.when(pooled > 0, (F.col("__ma") - F.col("__mb")) / pooled).alias("d"))


def most_common(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """(by, top, n_top, n, fraction): the commonest label of each group, ties to the least label."""
    counts = df.groupBy(*by, label).agg(F.count("*").alias("__c"))
    return counts.groupBy(*by).agg(
        F.min_by(label, F.struct(-F.col("__c"), F.col(label))).alias("top"), F.max("__c").alias("n_top"), F.sum("__c").alias("n")
    ).withColumn("fraction", F.col("n_top") / F.col("n"))


def distribution(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """(by, distribution): map of label to count, NULL labels left out."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("__c"))
    return counts.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(label, "__c")))).alias("distribution"))


def share_of_total(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n, pct) with pct of all rows; the total is the sum of the group counts."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("__t"))
    return counts.join(F.broadcast(total)).select(*by, "n", (100.0 * F.col("n") / F.col("__t")).alias("pct"))  # one row


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: rows, missing share, distinct values and whether they are unique, in one pass."""
    names = list(columns or df.columns)
    missing = {c: F.isnan(c) | F.col(c).isNull() if t in ("double", "float") else F.col(c).isNull() for c, t in df.dtypes}
    aggs = [F.count("*").alias("__rows")]
    for i, c in enumerate(names):
        aggs += [F.count_if(missing[c]).alias(f"m{i}"), F.count_distinct(F.col(f"`{c}`").cast("string")).alias(f"d{i}")]
    one = df.agg(*aggs)
    entries = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("n_missing"), F.col(f"d{i}").alias("n_distinct")) for i, c in enumerate(names)]
    )
    rows = one.select("__rows", F.explode(entries).alias("e"))
    return rows.select(
        "e.column_name", F.col("__rows").alias("n_rows"), "e.n_missing",
        (F.col("e.n_missing") / F.nullif(F.col("__rows"), F.lit(0))).alias("missing_share"), "e.n_distinct",
        ((F.col("e.n_distinct") == F.col("__rows")) & (F.col("__rows") > 0)).alias("is_unique"),
    )
