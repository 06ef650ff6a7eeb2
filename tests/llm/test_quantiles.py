from __future__ import annotations

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from gneiss.llm import quantiles

PROBS = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]


def check(values, q, err, bound):
    own = np.sort(values)
    n = len(own)
    for p, x, e in zip(PROBS, q, err, strict=True):
        k = min(max(int(np.ceil(p * n - 1e-9)), 1), n)
        low, high = np.searchsorted(own, x, "left") + 1, np.searchsorted(own, x, "right")
        assert low <= high, "the value is one of the group's"
        assert (0 if low <= k <= high else min(abs(k - low), abs(k - high))) <= e <= max(1, bound * n)


def table(spark, data):
    return spark.createDataFrame(data, "k string, s string, x double, n int")


def test_rank_bounds_hold(spark):
    rng = np.random.default_rng(1)
    data = [("hot", f"s{i % 3}", float(np.round(rng.lognormal(), 2)), 0) for i in range(9000)] + [(f"k{i % 5}", None, float(i), 0) for i in range(100)] + [("one", "s", 4.0, 0), ("hot", "s1", None, 0), ("hot", "s1", float("nan"), 0)]
    df = table(spark, data).repartition(7)
    leaves = quantiles.summarise(df, {"k": F.col("k"), "s": F.col("s")}, F.col("x"), 64)
    got = quantiles.rollup(leaves, "k", "s", PROBS, 64).collect()
    assert {(r["k"], r["s"]) for r in got} == {(k, s) for k, s, x, _ in data if x is not None and x == x}
    for r in got:
        own = np.array([x for k, s, x, _ in data if (k, s) == (r["k"], r["s"]) and x is not None and x == x])
        every = np.array([x for k, s, x, _ in data if k == r["k"] and x is not None and x == x])
        assert (r["n"], r["all_n"]) == (len(own), len(every))
        check(own, r["q"], r["rank_error"], 2 / 64)
        check(every, r["all_q"], r["all_rank_error"], 3 / 64)


def test_small_groups_are_exact_and_loads_can_be_merged(spark):
    data = [("a", "s", float(i * 7 % 50), 0) for i in range(50)]
    days = [quantiles.summarise(table(spark, data[i::2]), {"k": F.col("k"), "s": F.col("s")}, F.col("x")) for i in (0, 1)]
    both = quantiles.merge(days[0].unionByName(days[1]), ["k", "s"])
    r = both.collect()[0]
    assert r["n"] == 50 and r["v"] == sorted(x for _, _, x, _ in data) and r["lo"] == r["hi"] == list(range(1, 51))
    assert rows(quantiles.premerge(both, ["k", "s"], 1)) == rows(both)


def test_many_leaves_are_merged_level_by_level(spark):
    rnd = np.random.default_rng(2)
    data = [("a", "s", float(x), 0) for x in rnd.normal(size=4000)]
    leaves = quantiles.summarise(table(spark, data).repartition(40), {"k": F.col("k"), "s": F.col("s")}, F.col("x"), 64)
    assert leaves.count() == 40
    fewer = quantiles.premerge(leaves, ["k", "s"], 40, 64, together=4)
    assert fewer.count() <= 4
    r = quantiles.rollup(fewer, "k", "s", PROBS, 64).collect()[0]
    own = sorted(x for _, _, x, _ in data)
    assert r["n"] == 4000
    check(np.array(own), r["q"], r["rank_error"], 5 / 64)


def test_ties_and_empty(spark):
    data = [("a", "s", 5.0, 0)] * 3000
    r = quantiles.rollup(quantiles.summarise(table(spark, data), {"k": F.col("k"), "s": F.col("s")}, F.col("x"), 16), "k", "s", PROBS, 16).collect()[0]
    assert set(r["q"]) == {5.0} and r["n"] == 3000
    assert rows(quantiles.rollup(quantiles.summarise(table(spark, []), {"k": F.col("k"), "s": F.col("s")}, F.col("x")), "k", "s", PROBS)) == []


@pytest.mark.parametrize("leaves,size", [(1, 8), (5, 8), (40, 16)])
def test_merging_in_numpy(leaves, size):
    rng = np.random.default_rng(leaves)
    values, parts = [], []
    for _ in range(leaves):
        x = np.sort(rng.integers(0, 40, rng.integers(1, 200)).astype(float))
        values.append(x)
        rank = np.arange(1, len(x) + 1)
        keep = quantiles._pick(np.array([len(x)]), rank, np.array([0]), np.array([len(x)]), size)
        parts.append((len(x), x[keep], rank[keep]))
    n = np.array([p[0] for p in parts])
    length = np.array([len(p[1]) for p in parts])
    v, r = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
    total, count, v, lo, hi = quantiles.merge_flat(np.zeros(leaves, dtype=int), n, length, v, r, r, 1, None)
    every = np.sort(np.concatenate(values))
    assert total[0] == len(every) and (lo <= hi).all()
    for x, a, b in zip(v, lo, hi, strict=True):
        low, high = np.searchsorted(every, x, "left") + 1, np.searchsorted(every, x, "right")
        assert a <= high and b >= low
