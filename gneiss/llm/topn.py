"""The N best items of every group by a hot-cold split.

Exact group counts (column-pruned, summed before the shuffle) tell which groups are heavy. Light groups
are shuffled once by group and ranked by an ordinary window. Heavy groups are range-sorted over all
tasks by (group, score, item); the sorted piece serves as salt: each piece keeps its own first N before
anything else is shuffled, and the few survivors are ranked together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: At most so many groups are called heavy, so their keys can always be broadcast.
MOST_HEAVY = 50_000


def top_items(
    df: DataFrame,
    group: dict[str, Column],
    item: Column,
    score: Column,
    n: int,
    item_name: str = "item",
    score_name: str = "score",
    rank_name: str = "rank",
    heavy_rows: int = 200_000,
) -> DataFrame:
    """The first ``n`` items of each group by score descending, then item ascending, ranks from 1.

    An item counts once per group, with its highest score. Rows with a NULL in a group column or in
    the item and rows whose score is NULL or NaN take no part. Groups with fewer items come out
    whole; an empty table gives no rows. A group is heavy from ``heavy_rows`` rows on, or from
    rows / ``MOST_HEAVY`` where that is more, which bounds the heavy keys by ``MOST_HEAVY``.
    """
    keys = [f"g{i}" for i in range(len(group))]
    base = df.select(
        *[c.alias(k) for k, c in zip(keys, group.values(), strict=True)], item.alias("item"), score.cast("double").alias("score")
    )
    for c in (*keys, "item", "score"):
        base = base.where(F.col(c).isNotNull())
    base = base.where(~F.isnan("score"))
    best = [F.desc("score"), F.asc("item")]

    counts = base.groupBy(*keys).agg(F.count("*").alias("rows"))
    total = base.count()
    least = max(heavy_rows, total // MOST_HEAVY + 1)
    found = counts.where(F.col("rows") >= least).select(*keys).collect() if total >= least else []

    def ranked(rows: DataFrame, *by: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*best))
        return rows.withColumn("rank", place).where(F.col("rank") <= n)

    cold = base
    if found:
        heavy = F.broadcast(df.sparkSession.createDataFrame(found, base.select(*keys).schema))
        cold = base.join(heavy, keys, "left_anti")
    # One shuffle by group serves the aggregation by (group, item) and the window.
    light = cold.repartition(*keys).groupBy(*keys, "item").agg(F.max("score").alias("score"))
    out = ranked(light, *keys)
    if found:
        hot = base.join(heavy, keys, "left_semi").groupBy(*keys, "item").agg(F.max("score").alias("score"))
        pieces = hot.repartitionByRange(*keys, *best).withColumn("piece", F.spark_partition_id())
        survivors = ranked(pieces, *keys, "piece").drop("rank", "piece")
        out = out.unionByName(ranked(survivors, *keys))
    return out.select(
        *[F.col(k).alias(name) for k, name in zip(keys, group, strict=True)],
        F.col("item").alias(item_name),
        F.col("score").alias(score_name),
        F.col("rank").cast("long").alias(rank_name),
    )
