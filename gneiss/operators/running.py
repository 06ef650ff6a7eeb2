"""Running sums over ordered groups of any size.

Rows are range-sorted over all tasks by group and order; a window inside a piece adds up, and a group that goes
on in a further piece gets what its earlier pieces hold from sums per (group, piece). At most one group crosses a
boundary between pieces, so those sums are bounded by the number of pieces and broadcast. No task ever needs a
whole group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.session import written


def running_sums(df: DataFrame, by: Sequence[str], order: Sequence[Column], sums: Mapping[str, Column], pieces: int | None = None) -> DataFrame:
    """``df`` with ``<name>_upto`` (sum over the group's rows up to this one in ``order``, itself included) and
    ``<name>_all`` (over the whole group) for every entry of ``sums``.

    ``order`` should be total within a group; rows that tie are added up in any order. NULLs count as 0 and NULL keys
    form groups. ``by`` may be empty. The ordered rows are written once, because two passes must see the same pieces.
    """
    xs, ks = [f"__x{i}" for i in range(len(sums))], [f"__k{i}" for i in range(len(by))]
    staged = df.withColumns({x: F.coalesce(c, F.lit(0)) for x, c in zip(xs, sums.values(), strict=True)})
    ranges = [F.col(f"`{b}`") for b in by] + list(order)
    ordered = staged.repartitionByRange(*([pieces] if pieces else []), *ranges)
    placed = written(ordered.withColumn("__piece", F.spark_partition_id()))
    keys = [F.col(f"`{b}`").alias(k) for b, k in zip(by, ks, strict=True)]
    each = placed.groupBy(*keys, F.col("__piece").alias("__at")).agg(*[F.sum(x).alias(x) for x in xs])
    one = Window.partitionBy(*ks)
    before = one.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    edges = each.select(
        *ks, "__at", F.count("*").over(one).alias("__n"),
        *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}_before") for x in xs],
        *[F.sum(x).over(one).alias(f"{x}_total") for x in xs],
    ).where("__n > 1")
    here = Window.partitionBy(*[F.col(f"`{b}`") for b in by], "__piece")
    upto = here.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.withColumns({f"{x}_upto": F.sum(x).over(upto) for x in xs} | {f"{x}_all": F.sum(x).over(here) for x in xs})
    same = F.col("__piece") == F.col("__at")
    for b, k in zip(by, ks, strict=True):
        same = same & F.col(f"`{b}`").eqNullSafe(F.col(k))
    joined = local.join(F.broadcast(edges), same, "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[(F.col(f"{x}_upto") + F.coalesce(f"{x}_before", F.lit(0))).alias(f"{n}_upto") for x, n in zip(xs, sums, strict=True)],
        *[F.coalesce(f"{x}_total", f"{x}_all").alias(f"{n}_all") for x, n in zip(xs, sums, strict=True)],
    )
