from __future__ import annotations

import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from gneiss.operators import orphans

D = lambda n: dt.datetime(2024, 1, n)
RECORDS = [("a", D(1), None), ("b", D(5), D(10)), ("c", None, D(3)), ("e", D(1), D(2)), ("e", D(8), None), ("g", D(1), D(4)), ("g", D(1), D(4)), (None, D(1), None)]


def existence(spark, data=RECORDS):
    t = spark.createDataFrame(data, "k string, a timestamp, r timestamp")
    return orphans.existence_deltas(t, F.col("k"), F.col("a"), F.col("r"))


def refs(spark, data):
    return spark.createDataFrame(data, "row_id long, key string, at timestamp, steps string")


def test_kinds(spark):
    data = [(1, "a", D(1), ""), (2, "b", D(4), ""), (3, "b", D(5), ""), (4, "b", D(10), ""), (5, "zz", D(4), ""), (6, "c", D(2), ""), (7, "c", D(3), ""), (8, "e", D(5), ""), (9, "e", D(9), ""), (10, "g", D(4), ""), (11, "b", None, ""), (12, "g", D(3), "")]
    got = rows(orphans.classify(refs(spark, data).drop("steps"), existence(spark)), "row_id", "kind")
    assert sorted(got) == [(2, "late"), (4, "deleted"), (5, "missing"), (7, "deleted"), (8, "deleted"), (10, "deleted"), (11, "deleted")]


def test_no_records_and_no_references(spark):
    none = existence(spark, [])
    assert rows(orphans.classify(refs(spark, [(1, "a", D(1), ""), (1, "a", D(1), "")]).drop("steps"), none), "row_id", "kind") == [(1, "missing"), (1, "missing")]
    assert rows(orphans.classify(refs(spark, []).drop("steps"), existence(spark))) == []


def test_counts_merge_in_any_order(spark):
    r = spark.createDataFrame([(i, k, D(1), s) for i, (k, s) in enumerate([("a", 1), ("b", 1), ("b", -1), ("x", 1), ("x", 1), ("y", 1)])], "row_id long, key string, at timestamp, s int")
    ref = orphans.reference_deltas(r, F.col("key"), F.col("at"), F.col("s"))
    whole = orphans.counts_of(ref, existence(spark))
    assert rows(orphans.orphan_report(whole)) == [("x", 2), ("y", 1)]
    halves = [orphans.counts_of(ref.where(c), existence(spark).where(c)) for c in (F.col("key") < "c", F.col("key") >= "c")]
    assert rows(orphans.merge_counts(halves[0], halves[1])) == rows(whole.where("refs <> 0 OR existing <> 0"))
    new = existence(spark, [("x", D(20), None)])
    assert rows(orphans.orphan_report(orphans.merge_counts(whole, orphans.counts_of(ref.limit(0), new)))) == [("y", 1)]


def test_hot_key_gives_the_same_rows(spark):
    """The hot key goes on over several pieces, some without any change of existence in them."""
    data = [(i, "hot" if i % 3 else f"k{i}", D(1 + i % 20), "") for i in range(6000)]
    recs = [("hot", D(5), D(15))] + [(f"k{i}", D(1), None) for i in range(0, 6000, 6)]
    pieces = orphans._placed(refs(spark, data).drop("steps"), existence(spark, recs), 5).where("key = 'hot'").select("__piece").distinct().count()
    assert pieces > 1
    got = rows(orphans.classify(refs(spark, data).drop("steps"), existence(spark, recs), 5), "row_id", "kind")
    have = {k: (a, r) for k, a, r in recs}
    want = []
    for i, k, at, _ in data:
        if k not in have:
            want.append((i, "missing"))
        elif have[k][0] > at:
            want.append((i, "late"))
        elif have[k][1] and have[k][1] <= at:
            want.append((i, "deleted"))
    assert sorted(got) == sorted(want)


def test_columns_that_clash_with_inner_names(spark):
    df = refs(spark, [(1, "zz", D(4), "s"), (2, None, D(4), "s")]).withColumns({"d": F.lit(5), "kind": F.lit("old"), "delta": F.map_from_arrays(F.array(F.lit("x")), F.array(F.lit(1)))})
    got = orphans.classify(df.drop("kind"), existence(spark)).collect()
    assert [(r["row_id"], r["kind"], r["d"], r["steps"], r["delta"]) for r in got] == [(1, "missing", 5, "s", {"x": 1})]
