"""References to records that do not exist, from signed change deltas.

References and records both arrive as deltas (+1 / -1) of a key. The state holds one row per key with
the net count of each; a key with references and no existence is an orphan. Deltas are summed before
the shuffle, merging two states is the same sum, and a state grows with the keys, never the deltas. The same
signed counts, run up in time order, tell for every single reference whether its key existed at its time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.session import written

#: Times that stand for an unknown time of adding and of reference.
BEGIN, END = "0001-01-01 00:00:00", "9999-12-31 00:00:00"


def existence_deltas(records: DataFrame, key: Column, added: Column, removed: Column) -> DataFrame:
    """(key, at, delta) of records: +1 when added, -1 when removed. An unknown time of adding counts as always
    there, an unknown time of removal as never removed. NULL keys are no records."""
    base = records.select(key.alias("key"), added.cast("timestamp").alias("a"), removed.cast("timestamp").alias("r"))
    plus = F.struct(F.coalesce("a", F.lit(BEGIN).cast("timestamp")).alias("at"), F.lit(1).alias("delta"))
    minus = F.struct(F.col("r").alias("at"), F.lit(-1).alias("delta"))
    return (
        base.where(F.col("key").isNotNull())
        .select("key", F.explode(F.array_compact(F.array(plus, F.when(F.col("r").isNotNull(), minus)))).alias("d"))
        .select("key", "d.at", "d.delta")
    )


def reference_deltas(refs: DataFrame, key: Column, at: Column, sign: Column | None = None) -> DataFrame:
    """(key, at, delta) of references. NULL keys are no references."""
    return refs.select(
        key.alias("key"), at.cast("timestamp").alias("at"), (F.lit(1) if sign is None else sign).cast("int").alias("delta")
    ).where(F.col("key").isNotNull())


def counts_of(references: DataFrame, existence: DataFrame) -> DataFrame:
    """State (key, refs, existing) of two delta tables."""
    both = references.select("key", F.col("delta").alias("refs"), F.lit(0).alias("existing")).unionByName(
        existence.select("key", F.lit(0).alias("refs"), F.col("delta").alias("existing"))
    )
    return both.groupBy("key").agg(F.sum("refs").alias("refs"), F.sum("existing").alias("existing"))


def merge_counts(state: DataFrame, change: DataFrame) -> DataFrame:
    """``state`` after the deltas that ``change`` sums up; keys with neither count left are dropped."""
    return (
        state.unionByName(change)
        .groupBy("key")
        .agg(F.sum("refs").alias("refs"), F.sum("existing").alias("existing"))
        .where((F.col("refs") != 0) | (F.col("existing") != 0))
    )


def orphan_report(state: DataFrame) -> DataFrame:
    """Keys that are referred to now and do not exist now."""
    return state.where((F.col("refs") > 0) & (F.col("existing") <= 0)).select("key", "refs")


def _placed(references: DataFrame, existence: DataFrame, pieces: int | None = None) -> DataFrame:
    """All deltas of both sides in order of key and time, cut into pieces of about equal size: written once,
    because two passes must see the same pieces. Rows of the references travel in ``__row``."""
    others = [c for c in references.columns if c not in ("key", "at")]
    row = F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in others])
    refs = references.where(F.col("key").isNotNull()).select(
        "key", F.coalesce("at", F.lit(END).cast("timestamp")).alias("__time"), F.lit(1).alias("__refs"), F.lit(0).alias("__delta"), "at", row.alias("__row")
    )
    kind = refs.schema["__row"].dataType
    steps = existence.where(F.col("key").isNotNull()).select(
        "key", F.col("at").alias("__time"), F.lit(0).alias("__refs"), F.col("delta").cast("int").alias("__delta"),
        F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast(kind).alias("__row"),
    )
    spread = [F.col(f"__row.`{c}`") for c, t in references.dtypes if c in others and "map<" not in t]
    ordered = refs.unionByName(steps).repartitionByRange(*([pieces] if pieces else []), "key", "__time", "__refs", F.xxhash64(*spread) if spread else F.lit(0))
    return written(ordered.withColumn("__piece", F.spark_partition_id()))


def classify(references: DataFrame, existence: DataFrame, pieces: int | None = None) -> DataFrame:
    """The rows of ``references`` (columns key, at and any others) whose key does not exist at their time.

    Deltas of references and existence are put in one order of key and time, and every reference sees its
    key's signed existence count up to its time, changes at that very time included. ``kind`` is ``missing``
    if no record ever had the key, ``late`` if none had been added yet, ``deleted`` if the count is zero (or
    below) after a removal. A NULL time is the end of time, so it cannot be late; NULL keys are no references.

    The order is cut into equal pieces (``pieces`` of them, or as many as the data needs), so a hot key lies in as many pieces as its rows need. A key that goes
    on in a further piece gets what lies before and in all pieces from sums per (key, piece); only such keys
    need it, at most one a boundary, so that table is bounded by the number of pieces.
    """
    placed = _placed(references, existence, pieces)
    added = F.greatest(F.col("__delta"), F.lit(0))
    sums = placed.groupBy("key", "__piece").agg(F.sum("__delta").alias("d"), F.sum(added).alias("a"))
    one = Window.partitionBy("key")
    before = one.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    edges = sums.withColumns(
        {
            "__net_before": F.coalesce(F.sum("d").over(before), F.lit(0)), "__adds_before": F.coalesce(F.sum("a").over(before), F.lit(0)),
            "__adds_all": F.sum("a").over(one), "pieces": F.count("*").over(one),
        }
    ).where("pieces > 1").select("key", "__piece", "__net_before", "__adds_before", "__adds_all")
    here = Window.partitionBy("__piece", "key")
    upto = here.orderBy("__time", "__refs").rowsBetween(Window.unboundedPreceding, 0)
    counted = placed.withColumns({"__net": F.sum("__delta").over(upto), "__adds": F.sum(added).over(upto), "__adds_here": F.sum(added).over(here)})
    seen = counted.where("__refs = 1").join(F.broadcast(edges), ["key", "__piece"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    kind = (
        F.when(F.coalesce("__adds_all", "__adds_here") <= 0, "missing")
        .when(F.col("__adds") + zero("__adds_before") <= 0, "late")
        .when(F.col("__net") + zero("__net_before") <= 0, "deleted")
    )
    others = [c for c in references.columns if c not in ("key", "at")]
    return seen.select("key", "at", *[F.col(f"__row.`{c}`").alias(c) for c in others], kind.alias("kind")).where(F.col("kind").isNotNull())
