"""Copies of a text share its repeats."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from gneiss.llm import mixing


def uses(spark, docs, targets):
    d = spark.createDataFrame(docs, "doc_id long, source string, tokens long, text string")
    sizes = mixing.sized(d, F.col("doc_id"), F.col("source"), F.col("tokens"), F.col("text"))
    first = mixing.histogram(sizes)
    plan = mixing.budgets(first, spark.createDataFrame(targets, "source string, share double, max_repeats int"))
    text = {i: (s, t) for i, s, _, t in docs}
    mixed = mixing.mix(sizes, first, plan)
    times = Counter()
    for r in mixed.collect():
        times[text[r["doc_id"]]] += r["repeats"]
    return times, mixed, {r["source"]: r for r in mixing.shares(mixed, plan).collect()}


def test_no_text_is_used_more_than_its_repeats(spark):
    docs = [(i, "ab"[i % 2], 10 + i // 2 % 40 % 7, f"t{i // 2 % 40}") for i in range(240)]  # 40 texts a source, three copies each
    times, mixed, share = uses(spark, docs, [("a", 0.9, 1), ("b", 0.3, 2)])
    assert {t for (s, _), t in times.items() if s == "a"} == {1} and len([k for k in times if k[0] == "a"]) == 40
    assert max(t for (s, _), t in times.items() if s == "b") <= 2
    total = sum(d[2] for d in docs)
    assert 0.3 * total - 20 <= share["b"]["tokens"] <= 0.3 * total, "the target is met by more uses of distinct texts"
    assert share["a"]["size"] == sum(d[2] for d in docs if d[1] == "a") and share["a"]["short"] is True


def test_uses_are_dealt_out_to_the_copies(spark):
    times, mixed, _ = uses(spark, [(1, "a", 10, "x"), (2, "a", 10, "x"), (3, "a", 10, "x")], [("a", 2 / 3, 2)])
    assert times == {("a", "x"): 2}
    assert sorted((r["doc_id"], r["repeats"]) for r in mixed.collect()) == [(1, 1), (2, 1)]


def test_documents_without_text_and_other_sources_stand_alone(spark):
    docs = [(1, "a", 5, None), (2, "a", 5, None), (3, "a", 5, ""), (4, "a", 5, "x"), (5, "b", 5, "x")]
    _, mixed, _ = uses(spark, docs, [("a", 0.8, 1), ("b", 0.2, 1)])
    assert sorted((r["doc_id"], r["repeats"]) for r in mixed.collect()) == [(i, 1) for i in range(1, 6)]
