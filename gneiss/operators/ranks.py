"""Ranks, percentiles, bins and inverse-normal scores with exact tie rules.

Every window partitions by a feature (and stratum), whose rows are bounded by the number of entities.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.stats import with_phi_inverse
from gneiss.operators.running import running_sums


def average_rank(by: Sequence[str], value: str, ascending: bool = True) -> Column:
    """Rank over non-NULL values, ties share their mean rank; NULL values have none."""
    order = F.col(value).asc_nulls_last() if ascending else F.col(value).desc_nulls_last()
    first = F.rank().over(Window.partitionBy(*by).orderBy(order))
    ties = F.count("*").over(Window.partitionBy(*by, value))
    return F.when(F.col(value).isNotNull(), first + (ties - 1) / 2.0)


def percentile_rank(by: Sequence[str], value: str) -> Column:
    """Average-tie rank over the number of non-NULL values (neither percent_rank nor cume_dist)."""
    return average_rank(by, value) / F.count(value).over(Window.partitionBy(*by))


def order_rank(by: Sequence[str], value: str, tie: str) -> Column:
    """1, 2, 3 ... by value descending, then ``tie`` ascending; NULL where value or a key is NULL."""
    known = F.col(value).isNotNull()
    for k in by:
        known = known & F.col(k).isNotNull()
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last(value), F.asc(tie)))
    return F.when(known, place)


def min_rank(by: Sequence[str], value: str) -> Column:
    """1 + how many are strictly greater."""
    return F.when(F.col(value).isNotNull(), F.rank().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last(value))))


def equal_count_bin(by: Sequence[str], value: str, tie: str, bins: int = 10, ties: str = "ordinal") -> Column:
    """0-based bin of about equal counts: min(floor((ceil(r) - 1) * bins / n), bins - 1).

    ``ties``: "ordinal" breaks them by ``tie``, "average" keeps a tie block together, "drop" leaves
    tied values out (NULL) and counts only the others.
    """
    whole = Window.partitionBy(*by)
    known = F.col(value).isNotNull()
    if ties == "drop":
        known = known & (F.count("*").over(Window.partitionBy(*by, value)) == 1)
    n = F.sum(known.cast("int")).over(whole)
    if ties == "average":
        r = F.ceil(average_rank(by, value))
    else:
        r = F.row_number().over(whole.orderBy((~known).cast("int"), F.asc(value), F.asc(tie)))
    return F.when(known, F.least(F.floor((r - 1) * bins / n), F.lit(bins - 1)).cast("int"))


def normal_scores(df: DataFrame, by: Sequence[str], value: str, out: str, form: str = "min") -> DataFrame:
    """Inverse-normal scores: "min" is phi^-1(min rank / (n + 1)), "mid" is phi^-1((mean rank - 0.5) / n)."""
    n = F.count(value).over(Window.partitionBy(*by))
    if form == "min":
        share = F.rank().over(Window.partitionBy(*by).orderBy(F.asc_nulls_last(value))) / (n + 1)
    else:
        share = (average_rank(by, value) - 0.5) / n
    known = df.withColumn("__share", F.when(F.col(value).isNotNull(), share))
    return with_phi_inverse(known, "__share", out).drop("__share")


def roc_steps(df: DataFrame, by: Sequence[str], score: str, positive: str) -> DataFrame:
    """(by, score, tp, fp, tpr, fpr) at each distinct score from the highest down; equal scores make one step.

    A NULL label is a negative. Groups of any size: scores are counted first, then run up in pieces.
    """
    return _steps(df, by, score, positive).select(
        *by, score, F.col("p_upto").alias("tp"), F.col("n_upto").alias("fp"),
        (F.col("p_upto") / F.nullif(F.col("p_all"), F.lit(0))).alias("tpr"), (F.col("n_upto") / F.nullif(F.col("n_all"), F.lit(0))).alias("fpr"),
    )


def _steps(df: DataFrame, by: Sequence[str], score: str, positive: str) -> DataFrame:
    """(by, score, p, n) per distinct known score with running counts from the highest score down."""
    yes = F.coalesce(F.col(positive), F.lit(False))
    each = df.where(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(*by, score).agg(F.count_if(yes).alias("p"), F.count_if(~yes).alias("n"))
    return running_sums(each, by, [F.desc(score)], {"p": F.col("p"), "n": F.col("n")})


def auroc(df: DataFrame, by: Sequence[str], score: str, positive: str) -> DataFrame:
    """(by, n_pos, n_neg, auroc): the share of (positive, negative) pairs that the score orders rightly, ties half.

    NULL without both classes; a NULL label is a negative. Groups of any size, ``by`` may be empty.
    """
    below = F.col("n_all") - F.col("n_upto")
    wins = F.sum(F.col("p") * (below + F.col("n") / 2.0))
    got = _steps(df, by, score, positive).groupBy(*by).agg(F.coalesce(F.sum("p"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_neg"), wins.alias("__w"))
    pairs = F.nullif(F.col("n_pos").cast("double") * F.col("n_neg"), F.lit(0.0))
    return got.withColumn("auroc", F.col("__w") / pairs).drop("__w")


def auroc_of_all(df: DataFrame, score: str, positive: str) -> DataFrame:
    """(n_pos, n_neg, auroc) of the whole table, rows without a label left out."""
    return auroc(df.where(F.col(positive).isNotNull()), [], score, positive)


def partial_areas(df: DataFrame, by: Sequence[str], score: str, positive: str, regions: Mapping[str, tuple[float, float]], least: int = 2) -> DataFrame:
    """One row per group with the standardised area under the ROC curve over each region of false-positive rates.

    The curve's points are the distinct scores; every segment between two of them is cut to the region and its
    trapezoid added up, so the area is exact. It is scaled so that chance gives 0.5 and a perfect order 1:
    (1 + (area - chance) / (best - chance)) / 2. NULL without ``least`` rows of either class.
    """
    p, n = F.col("p_all").cast("double"), F.col("n_all").cast("double")
    x0, x1 = (F.col("n_upto") - F.col("n")) / F.nullif(n, F.lit(0.0)), F.col("n_upto") / F.nullif(n, F.lit(0.0))
    y0, y1 = (F.col("p_upto") - F.col("p")) / F.nullif(p, F.lit(0.0)), F.col("p_upto") / F.nullif(p, F.lit(0.0))
    points = _steps(df, by, score, positive).select(*by, "p_all", "n_all", x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"))
    x0, x1, y0, y1 = (F.col(c) for c in ("x0", "x1", "y0", "y1"))
    areas = []
    for name, (low, high) in regions.items():
        a, b = F.greatest(x0, F.lit(low)), F.least(x1, F.lit(high))
        middle = y0 + (y1 - y0) * ((a + b) / 2 - x0) / (x1 - x0)
        chance, best = (high * high - low * low) / 2, high - low
        area = F.coalesce(F.sum(F.when(b > a, (b - a) * middle)), F.lit(0.0))
        enough = (F.max("p_all") >= least) & (F.max("n_all") >= least)
        areas.append(F.when(enough, (1 + (area - chance) / (best - chance)) / 2).alias(name))
    return points.groupBy(*by).agg(*areas)
