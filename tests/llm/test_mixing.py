from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from gneiss.llm import mixing


def mixed(spark, docs, targets, **kw):
    d = spark.createDataFrame(docs, "doc_id long, source string, tokens long, h string, size int")
    t = spark.createDataFrame(targets, "source string, share double, max_repeats int")
    sizes = mixing.sized(d, F.col("doc_id"), F.col("source"), F.col("tokens"))
    first = mixing.histogram(sizes)
    plan = mixing.budgets(first, t)
    m = mixing.mix(sizes, first, plan, **kw)
    return rows(m), {r["source"]: r for r in mixing.shares(m, plan).collect()}


def corpus(n=600):
    return [(i, "abc"[i % 3] if i % 10 else None, 5 + i * 7 % 40, None, 0) for i in range(n)]


def test_shares_repeats_and_shortfall(spark):
    docs = corpus()
    total = sum(d[2] for d in docs)
    size = {s: sum(d[2] for d in docs if d[1] == s) for s in "abc"}
    got, share = mixed(spark, docs, [("a", 0.5, 4), ("b", 0.1, 1), ("c", 0.7, 2), ("gone", 0.1, 3), ("none", None, None)])
    for s, want in (("a", 0.5), ("b", 0.1)):
        assert want * total - 45 <= share[s]["tokens"] <= want * total and share[s]["short"] is False
    assert share["c"]["short"] is True and share["c"]["tokens"] == 2 * size["c"]
    assert share["gone"]["short"] is True and share["gone"]["tokens"] == 0 and share["none"]["short"] is False
    most = {"a": 4, "b": 1, "c": 2}
    assert all(1 <= r <= most[s] for _, s, _, r in got)
    assert sum(share[s]["share_of_mix"] for s in share) == pytest.approx(1.0)
    assert share["a"]["share_of_total"] == pytest.approx(share["a"]["tokens"] / total)


def test_larger_budgets_include_smaller_ones(spark):
    few = {d for d, *_ in mixed(spark, corpus(), [("a", 0.1, 1)])[0]}
    more = {d for d, *_ in mixed(spark, corpus(), [("a", 0.2, 1)])[0]}
    assert few < more


def test_one_source_one_row_and_empty(spark):
    got, share = mixed(spark, [(1, "a", 10, None, 0)], [("a", 1.0, 3)])
    assert got == [(1, "a", 10, 1)] and share["a"]["share_of_total"] == 1.0
    got, share = mixed(spark, [], [("a", 1.0, 3)])
    assert got == [] and share["a"]["tokens"] == 0 and share["a"]["short"] is False
    assert mixed(spark, corpus(), [])[0] == []


def test_token_counts_cover_the_whole_text(spark):
    pytest.importorskip("tiktoken")
    texts = ["hello world", "", None, "слово " * 3000, "naïve\n\ntext"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["n"] for r in df.select(mixing.token_count(spark, F.col("t")).alias("n")).collect()]
    with open(f"{mixing.TOKENIZERS}/{mixing.VOCABULARY}", "rb") as f:
        encode = mixing._encoding(f.read()).encode_ordinary
    assert got == [len(encode(t)) if t else 0 for t in texts]


def test_many_sources_are_joined_by_shuffling(spark):
    targets = [("a", 0.5, 4), ("b", 0.1, 1), ("c", 0.7, 2)]
    assert mixed(spark, corpus(), targets, most_sources=2) == mixed(spark, corpus(), targets)
