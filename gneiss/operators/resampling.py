"""Bootstraps, sign tests and placebos whose draws come from a digest of their keys.

A draw is a function of (seed, replicate, position), so it is the same on any partitioning and in any engine, and no task
draws for a whole group: multiplicities of the clusters are a small table of replicates x clusters that is joined with sums
per cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.operators.running import running_sums


def digest(*keys: Column | str | int) -> Column:
    """48 bits of the MD5 of the keys joined by "/"."""
    parts = [(F.lit(k) if isinstance(k, int) else F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, 12), 16, 10).cast("bigint")


def sign(*keys: Column | str | int) -> Column:
    """+1 or -1 by the digest of the keys."""
    return (1 - 2 * F.pmod(digest(*keys), F.lit(2))).cast("int")


def numbered(clusters: DataFrame) -> DataFrame:
    """(cluster, number): the distinct clusters of column ``cluster`` numbered from 0 in their order. Clusters are a dimension:
    their list is ordered in one task."""
    ids = clusters.select("cluster").where(F.col("cluster").isNotNull()).distinct()
    return ids.select("cluster", (F.row_number().over(Window.orderBy("cluster")) - 1).alias("number"))


def multiplicities(df: DataFrame, cluster: str, draws: int, seed: int) -> DataFrame:
    """(cluster, b, times): how often each replicate b = 0 .. draws - 1 draws each cluster, as many draws as there are
    clusters, with replacement; rows of 0 are left out. The clusters are those of column ``cluster``, NULL being none."""
    spark = df.sparkSession
    ids = numbered(df.select(F.col(cluster).alias("cluster")))
    n = max(ids.count(), 1)
    grid = spark.range(draws).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    drawn = grid.select("b", F.pmod(digest(seed, "b", "i"), F.lit(n)).alias("number"))
    return drawn.groupBy("b", "number").agg(F.count("*").alias("times")).join(ids, "number").select("cluster", "b", "times")


def bounds(value: str | Column, low: float = 0.025, high: float = 0.975) -> list[Column]:
    return [F.percentile(value, F.lit(low)).alias("ci_low"), F.percentile(value, F.lit(high)).alias("ci_high")]


def ratio_bootstrap(df: DataFrame, by: Sequence[str], cluster: str, top: Column, bottom: Column, draws: int, seed: int = 42) -> DataFrame:
    """(by, n_clusters, estimate, ci_low, ci_high, se) of sum(top) / sum(bottom), whole clusters drawn again.

    The same clusters are drawn for every group, as one population is. Rows without a cluster take no part; a replicate
    whose bottom is 0 gives none.
    """
    # Own names inside, so callers may name their columns as they like.
    keys = [f"g{i}" for i in range(len(by))]
    rows = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)], F.col(f"`{cluster}`").alias("cluster"), top.cast("double").alias("t"), bottom.cast("double").alias("u"))
    sums = rows.where(F.col("cluster").isNotNull()).groupBy(*keys, "cluster").agg(F.sum("t").alias("t"), F.sum("u").alias("u"))
    whole = sums.groupBy(*keys).agg(F.count("*").alias("n_clusters"), (F.sum("t") / F.nullif(F.sum("u"), F.lit(0.0))).alias("estimate"))
    times = multiplicities(rows, "cluster", draws, seed)
    again = sums.join(times, "cluster").groupBy(*keys, "b").agg((F.sum(F.col("t") * F.col("times")) / F.nullif(F.sum(F.col("u") * F.col("times")), F.lit(0.0))).alias("r"))
    spread = again.groupBy(*keys).agg(*bounds("r"), F.stddev_samp("r").alias("se"))
    joined = whole.join(spread, keys, "left") if by else whole.join(spread)  # one row each
    return joined.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], "n_clusters", "estimate", "ci_low", "ci_high", "se")


def two_way_bootstrap(df: DataFrame, group: str, cluster: str, top: Column, bottom: Column, draws: int, seed: int = 42) -> DataFrame:
    """One row: the median over groups of sum(top) / sum(bottom) with its band when clusters and groups are both drawn again."""
    rows = df.select(F.col(f"`{group}`").alias("g"), F.col(f"`{cluster}`").alias("cluster"), top.cast("double").alias("t"), bottom.cast("double").alias("u"))
    sums = rows.where(F.col("cluster").isNotNull() & F.col("g").isNotNull()).groupBy("g", "cluster").agg(F.sum("t").alias("t"), F.sum("u").alias("u"))
    point = sums.groupBy("g").agg((F.sum("t") / F.nullif(F.sum("u"), F.lit(0.0))).alias("r")).agg(F.count("r").alias("n_groups"), F.median("r").alias("estimate"))
    clusters = multiplicities(rows, "cluster", draws, seed)
    groups = multiplicities(rows, "g", draws, seed + 1).select(F.col("cluster").alias("g"), "b", F.col("times").alias("weight"))
    each = sums.join(clusters, "cluster").groupBy("g", "b").agg((F.sum(F.col("t") * F.col("times")) / F.nullif(F.sum(F.col("u") * F.col("times")), F.lit(0.0))).alias("r"))
    medians = each.where(F.col("r").isNotNull()).join(groups, ["g", "b"]).groupBy("b").agg(F.percentile("r", F.lit(0.5), F.col("weight")).alias("m"))
    return point.join(medians.agg(*bounds("m"), F.stddev_samp("m").alias("se")))  # one row each


def paired_bootstrap(sums: DataFrame, cluster: str, draws: int, seed: int = 42) -> DataFrame:
    """One row: delta and lift of hits2 / n2 over hits1 / n1, clusters drawn again for both at once.

    ``sums`` has (cluster, hits1, n1, hits2, n2). A lift over a rate of 0 is NULL.
    """
    rate = lambda h, n: h / F.greatest(n, F.lit(1))
    total = sums.agg(*[F.sum(c).alias(c) for c in ("hits1", "n1", "hits2", "n2")], F.count("*").alias("n_clusters"))
    first, second = rate(F.col("hits1"), F.col("n1")), rate(F.col("hits2"), F.col("n2"))
    point = total.select("n_clusters", (second - first).alias("delta"), F.when(first > 0, second / first).alias("lift"))
    named = sums.select(F.col(f"`{cluster}`").alias("cluster"), "hits1", "n1", "hits2", "n2")
    again = named.join(multiplicities(named, "cluster", draws, seed), "cluster").groupBy("b").agg(*[F.sum(F.col(c) * F.col("times")).alias(c) for c in ("hits1", "n1", "hits2", "n2")])
    each = again.select((second - first).alias("d"), F.when(first > 0, second / first).alias("l"))
    band = each.agg(*[F.percentile(c, F.lit(p)).alias(f"{n}_{e}") for c, n in (("d", "delta"), ("l", "lift")) for e, p in (("low", 0.025), ("high", 0.975))])
    return point.join(band)


def sign_tests(deltas: DataFrame, cluster: str, delta: str, draws: int, seed: int = 42) -> DataFrame:
    """One row: the mean of the clusters' deltas, the share of random sign flips that reach it (``p_sign``), and the band of the
    wild cluster bootstrap, which flips the signs of the residuals around the mean."""
    known = deltas.where(F.col(delta).isNotNull()).select(F.col(cluster).alias("k"), F.col(delta).alias("d"))
    mean = known.agg(F.avg("d").alias("estimate"), F.count("*").alias("n"))
    # Sums per replicate: partial before the shuffle, so nothing grows with the clusters but the scan.
    flips = known.join(F.broadcast(mean)).select("estimate", "d", "k", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("b"))
    w = sign(seed, "b", "k")
    each = flips.groupBy("b").agg(F.avg(w * F.col("d")).alias("flipped"), F.avg(w * (F.col("d") - F.col("estimate"))).alias("noise"), F.first("estimate").alias("estimate"))
    got = each.agg(
        F.avg((F.abs("flipped") >= F.abs("estimate") - 1e-12).cast("double")).alias("p_sign"),
        F.percentile(F.col("estimate") + F.col("noise"), F.lit(0.025)).alias("ci_low"), F.percentile(F.col("estimate") + F.col("noise"), F.lit(0.975)).alias("ci_high"),
    )
    return mean.join(got)


def placebo_positives(df: DataFrame, by: Sequence[str], entity: str, positive: str, measured: Column, seed: int = 42) -> DataFrame:
    """``df`` with ``placebo``: as many measured rows of each group, chosen by digest, as it has positives."""
    n = df.groupBy(*by).agg(F.count_if(F.col(positive)).alias("__n"))
    order = Window.partitionBy(*by).orderBy(F.desc(measured), digest(seed, *by, entity), F.col(entity))
    placed = df.join(n, list(by)).withColumn("__k", F.row_number().over(order))
    return placed.withColumn("placebo", measured & (F.col("__k") <= F.col("__n"))).drop("__n", "__k")


def graph_against_tissue(pairs: DataFrame, fraction: float, least: int = 10) -> DataFrame:
    """One row: medians of ``distance`` over all pairs, over pairs of the same label, over the ``fraction`` of the greatest
    ``similarity`` (ties counted in), and the last less the second. ``pairs``: (similarity, distance, same, weight);
    a pair counts ``weight`` times."""
    w = F.col("weight")
    known = pairs.where(w > 0)
    # The cut is the similarity at which the pairs from the greatest down reach their number.
    ranked = running_sums(known.groupBy("similarity").agg(F.sum("weight").alias("weight")), [], [F.desc("similarity")], {"w": w})
    cut = ranked.where(F.col("w_upto") >= F.greatest(F.lit(float(least)), F.floor(F.col("w_all") * fraction))).agg(F.max("similarity").alias("cut"))
    marked = known.join(F.broadcast(cut))
    d = F.col("distance")
    return marked.agg(
        F.percentile(d, F.lit(0.5), w).alias("random"), F.percentile(F.when(F.col("same"), d), F.lit(0.5), w).alias("tissue"),
        F.percentile(F.when(F.col("similarity") >= F.col("cut"), d), F.lit(0.5), w).alias("graph"),
    ).withColumn("delta", F.col("graph") - F.col("tissue"))


#: Shares of a Poisson variable of mean 1 that are at most 0, 1, 2, ..
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)


def poisson_times(*keys: Column | str | int) -> Column:
    """How often a row is drawn in a Poisson bootstrap, by the digest of the keys; at most 7 times (beyond has a share of 1e-5)."""
    u = F.pmod(digest(*keys), F.lit(100_000_000)) / 1e8
    out = F.lit(len(POISSON))
    for times in reversed(range(len(POISSON))):
        out = F.when(u < POISSON[times], times).otherwise(out)
    return out


def pair_bootstrap(pairs: DataFrame, fraction: float, draws: int, seed: int = 42) -> DataFrame:
    """(b, delta) of ``graph_against_tissue`` with the entities of the pairs drawn again; ``pairs`` has (query, neighbour, ..).

    Entities may be many, so each is drawn by a Poisson variable of its own instead of from a numbered list. A pair
    counts the product of both. Pairs of two draws of one entity do not arise, since no entity is its own neighbour.
    The cut of a replicate is a weighted quantile over its pairs.
    """
    again = pairs.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("weight", poisson_times(seed, "b", "query") * poisson_times(seed, "b", "neighbour"))
    again = again.where(F.col("weight") > 0)
    cut = again.groupBy("b").agg(F.percentile("similarity", F.lit(1 - fraction), F.col("weight")).alias("cut"))
    d, w = F.col("distance"), F.col("weight")
    return again.join(F.broadcast(cut), "b").groupBy("b").agg(  # one row a replicate
        (F.percentile(F.when(F.col("similarity") >= F.col("cut"), d), F.lit(0.5), w) - F.percentile(F.when(F.col("same"), d), F.lit(0.5), w)).alias("delta")
    )


def label_null(df: DataFrame, row: str, label: str, draws: int, seed: int = 42) -> DataFrame:
    """``df`` once for every replicate b with ``shuffled``: a label drawn from the labels' shares by digest, so that it tells
    nothing of the row. Labels come with their shares only on the average, which spares a sort of all rows per replicate."""
    spark: SparkSession = df.sparkSession
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    ends = counts.select(F.col(label).alias("shuffled"), F.sum("n").over(Window.orderBy(label)).alias("end"), F.sum("n").over(Window.partitionBy()).alias("all"))  # one row a label
    steps = ends.agg(F.sort_array(F.collect_list(F.struct("end", "shuffled"))).alias("steps"), F.max("all").alias("all"))
    grid = df.where(F.col(label).isNotNull()).join(F.broadcast(spark.range(draws).select(F.col("id").alias("b"))))  # one row a replicate
    u = F.pmod(digest(seed, "b", row), F.col("all"))
    return grid.join(F.broadcast(steps)).withColumn("shuffled", F.filter("steps", lambda s: s["end"] > u)[0]["shuffled"]).drop("steps", "all")
