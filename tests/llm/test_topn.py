from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from gneiss.llm import topn


def top(spark, data, n=2, **kw):
    df = spark.createDataFrame(data, "g string, item string, score double, rank string, piece int")
    return rows(topn.top_items(df, {"g": F.col("g")}, F.col("item"), F.col("score"), n, **kw))


def brute(data, n):
    best = {}
    for g, i, s, *_ in data:
        if g is not None and i is not None and s is not None and s == s:
            best[g, i] = max(s, best.get((g, i), s))
    out = []
    for g in {k[0] for k in best}:
        own = sorted(((-s, i) for (h, i), s in best.items() if h == g))[:n]
        out += [(g, i, -s, k + 1) for k, (s, i) in enumerate(own)]
    return sorted(out)


def test_ties_repeats_and_missing(spark):
    data = [("a", "y", 1.0, "r", 1), ("a", "x", 1.0, None, 2), ("a", "z", 0.5, None, 3), ("a", "z", 1.0, None, 4), ("a", "w", float("nan"), None, 5), ("a", None, 9.0, None, 6), (None, "q", 9.0, None, 7), ("b", "only", -1.0, None, 8), ("c", "n", None, None, 9)]
    assert sorted(top(spark, data)) == [("a", "x", 1.0, 1), ("a", "y", 1.0, 2), ("b", "only", -1.0, 1)]
    assert top(spark, []) == []


@pytest.mark.parametrize("heavy", [1, 40, 10**6])
def test_hot_and_cold_give_the_same(spark, heavy):
    rnd = random.Random(3)
    data = [("hot" if rnd.random() < 0.4 else f"g{rnd.randrange(12)}", f"i{rnd.randrange(60)}", float(rnd.randrange(9)), None, 0) for _ in range(900)]
    assert sorted(top(spark, data, 5, heavy_rows=heavy)) == brute(data, 5)
