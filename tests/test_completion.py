"""Operators of states, requests, sources and resampling on small tables, nulls and empty ones included."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from gneiss import cli
from gneiss.operators import audits, clusters, combine, correlate, evidence, resampling, reshape, resolve, serving
from gneiss.plans import stage as stages
from gneiss.session import clear_written, written
from gneiss.sources import readers

RULES = {
    "gcRMA by affy": "gcrma", "GC-RMA": "gcrma", "normalised by RMA": "rma", "robust multi-array average": "rma", "MAS 5.0": "mas5", "Microarray Suite 5": "mas5", "global scaling to 500": "mas5",
    "PLIER": "plier", "dChip": "dchip", "model-based expression index": "dchip", "MAS4": "mas4", "average difference": "mas4", "VSN": "vsn", "variance stabilizing": "vsn", "quantile normalised": "quantile",
    "loess": "lowess", "FPKM from RSEM": "rnaseq", "karma": "unknown", "": "unknown", None: "unknown",
}


def test_processing_rules(spark):
    df = spark.createDataFrame(list(RULES.items()), "t string, want string")
    for r in df.select("t", "want", readers.processing_family(F.col("t")).alias("got")).collect():
        assert r["got"] == r["want"], r


def test_vocabulary_and_lookups(spark):
    df = spark.createDataFrame([("Bowel",), ("Soft Tissue",), ("A/B c",), (None,)], "t string")
    assert [r[0] for r in df.select(reshape.vocabulary_label(F.col("t"), {"Bowel": "colorectal"})).collect()] == ["colorectal", "soft_tissue", "a_b_c", None]
    got = spark.createDataFrame([("ensg1.2",), ("ENSG1 ACH-000001",), ("Kept",), ("BRCA1",), (None,)], "q string").select(resolve.fast_path(F.col("q"), ["kept"])).collect()
    assert [r[0] for r in got] == ["gene_alias_lookup", "score_explainer", "dataset_info", None, None]
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "zz"), (4, None)], "id int, k string")
    a, b = spark.createDataFrame([("a", "E1"), ("a", "E0")], "k string, entry string"), spark.createDataFrame([("b", "E2"), ("a", "E9")], "k string, entry string")
    got = {r["id"]: (r["entry"], r["source"], r["degraded"]) for r in resolve.with_fallback(asked, "id", "k", {"first": a, "down": None, "last": b}).collect()}
    assert got == {1: ("E0", "first", []), 2: ("E2", "last", ["down"]), 3: (None, None, ["down"]), 4: (None, None, ["down"])}


def test_roster_order_and_fraction(spark):
    ids = spark.createDataFrame([(3, "b"), (1, "b"), (2, "a"), (4, "q"), (5, None)], "pos int, k string")
    roster = spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
    assert rows(reshape.roster_filter(ids, "pos", F.col("k"), roster, "id")) == [("a", 2), ("b", 1)]
    df = spark.createDataFrame([(i, float(i // 2)) for i in range(40)] + [(99, None), (98, float("nan"))], "i int, v double")
    assert {r["i"] for r in reshape.top_fraction(df, "v", ["i"], 0.3).collect()} == set(range(28, 40))
    assert reshape.top_fraction(df.limit(0), "v", ["i"], 0.3).count() == 0 and reshape.top_fraction(df.where("i < 4"), "v", ["i"], 0.3).count() == 4


def test_outer_merge_guards_its_keys(spark):
    a, b = spark.createDataFrame([("x", 1), ("y", 2)], "k string, u int"), spark.createDataFrame([("y", 3), ("z", 4)], "k string, w int")
    assert rows(reshape.outer_merge(a, b, ["k"]), "k", "in_left", "in_right") == [("x", True, False), ("y", True, True), ("z", False, True)]
    with pytest.raises(ValueError, match="spelled"):
        reshape.outer_merge(a, b.where("k = 'z'"), ["k"])


def test_requests_and_command_line(spark, small):
    for bad in (([], (), 0.5, 5), (["a"] * 11, (), 0.5, 5), (["a"], ("s",) * 6, 0.5, 5), (["a"], (), -0.1, 5), (["a"], (), 0.5, 0), (["a"], (), 0.5, 201)):
        with pytest.raises(ValueError, match="features|strata|floor|rows"):
            serving.checked_request(*bad)
    one = cli.answer(spark, small, "gene", ["Brand#11"], 5).collect()
    assert [r["score"] for r in one] == sorted((r["score"] for r in one), reverse=True)
    assert cli.answer(spark, small, "exclude", ["Brand#11", "Brand#22"], 5).columns == ["ent", "wanted_score", "selectivity"]


def test_stages_are_written_once(spark, small):
    stages.forget(spark)
    first = stages.stage(spark, small, "scores").inputFiles()
    assert stages.stage(spark, small, "scores").inputFiles() == first
    stages.forget(spark)
    assert stages.stage(spark, small, "scores").inputFiles() != first


def test_written_tables_can_be_cleared(spark):
    df = written(spark.range(5))
    assert df.count() == 5
    clear_written(spark)
    with pytest.raises(Exception, match="(?i)not exist|no such file|FileNotFound"):
        spark.read.parquet(df.inputFiles()[0] if df.inputFiles() else "gone").count()
    stages.forget(spark)


def test_states(spark):
    data = [("up", i, i / 100, i > 50, "oncogene") for i in range(100)] + [("down", i, i / 100, i < 50, "oncogene") for i in range(100)] + [("tsg", i, i / 100, i < 50, "tsg") for i in range(100)]
    data += [("flat", i, 0.5, i > 3, "unknown") for i in range(100)] + [("few", i, i / 10, True, "unknown") for i in range(9)] + [("none", 1, None, True, "unknown")]
    df = spark.createDataFrame(data, "f string, e int, s double, y boolean, r string")
    got = dict(rows(evidence.ranking_states(df, "f", "s", F.col("y"), "r"), "f", "state"))
    assert got == {"up": "RANKED", "down": "CONFLICTING", "tsg": "RANKED", "flat": "UNINFORMATIVE", "few": "NO_EVIDENCE"}
    four = spark.createDataFrame([(True, 3, 1, False), (True, 2, 1, True), (True, 2, 1, False), (True, None, None, True), (False, 3, 1, True)], "q boolean, r int, n int, l boolean")
    assert [x[0] for x in four.select(evidence.altered_or_unknown(F.col("q"), F.col("r"), F.col("n"), F.col("l"))).collect()] == [True, None, False, False, None]


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(f"g{i % 3}", f"c{i % 7}", i % 4) for i in range(300)] + [("g0", None, 1)], "g string, c string, v int")
    run = lambda d: rows(resampling.ratio_bootstrap(d, ["g"], "c", F.col("v"), F.lit(1), 50))
    assert run(df) == run(df.repartition(7)) and all(r[3] <= r[2] <= r[4] for r in run(df))
    times = resampling.multiplicities(df, "c", 40, 1)
    assert times.groupBy("b").agg(F.sum("times").alias("n")).where("n <> 7").count() == 0, "as many draws as clusters"
    assert resampling.multiplicities(df.limit(0), "c", 5, 1).count() == 0
    mean = spark.range(20000).select(F.avg(resampling.poisson_times(1, "id")).alias("m"), F.var_samp(resampling.poisson_times(1, "id")).alias("v")).first()
    assert mean["m"] == pytest.approx(1, abs=0.03) and mean["v"] == pytest.approx(1, abs=0.06)
    nothing = resampling.sign_tests(df.limit(0).withColumn("d", F.lit(0.0)), "c", "d", 10).collect()
    assert len(nothing) == 1 and nothing[0]["n"] == 0


def test_pair_correlations_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 4))
    x[:, 3] = 2.0
    x[rng.random(x.shape) < 0.2] = np.nan
    long = spark.createDataFrame([(f"f{j}", i, float(x[i, j])) for i in range(50) for j in range(4)] + [("f0", 999, None)], "f string, e int, v double")
    got = {(r["a"], r["b"]): (r["n"], r["r"]) for r in correlate.pair_correlations(long.repartition(5), "f", "e", "v").collect()}
    for i in range(4):
        for j in range(i + 1, 4):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            n, r = got[f"f{i}", f"f{j}"]
            assert n == both.sum() and (r is None if j == 3 else r == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1]))
    assert correlate.pair_correlations(long.limit(0), "f", "e", "v").count() == 0
    with pytest.raises(ValueError, match="more than 2"):
        correlate.pair_correlations(long, "f", "e", "v", most_features=2)


def test_small_audits(spark):
    g = spark.createDataFrame([("a", 0), ("b", 0), ("c", 10)], "k string, x int")
    r = audits.gini(g, "x").first()
    assert r["gini"] == pytest.approx(2 / 3) and r["largest_share"] == 1.0 and audits.gini(g.limit(0), "x").first()["gini"] is None
    same = spark.createDataFrame([(i, "a" if i < 5 else "b", b) for i in range(10) for b in (0, 1)], "i int, l string, b int")
    assert {r["ari"] for r in clusters.agreement_by(same.withColumn("m", F.upper("l")), ["b"], "l", "m").collect()} == {1.0}
    het = spark.createDataFrame([("f", s, v) for s, vs in (("a", (1.0, 2.0, 3.0)), ("b", (11.0, 12.0, 13.0)), ("c", (5.0,))) for v in vs], "f string, s string, v double")
    assert rows(combine.heterogeneity(het, "f", "s", "v"), "k") == [(2,)] and combine.heterogeneity(het, "f", "s", "v").first()["i2"] > 0.9
