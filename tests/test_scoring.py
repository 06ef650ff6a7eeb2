"""Semantics that a plain translation gets wrong, on hand-made frames."""

from __future__ import annotations

import math
from statistics import median

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from gneiss.operators import aggregates, audits, clusters, combine, correlate, evidence, ranks, reshape, resolve, running, serving, similarity, skew, thresholds, zscores


def frame(spark, values, feat="f", strat="s"):
    return spark.createDataFrame([(strat, feat, f"e{i:02d}", v) for i, v in enumerate(values)], "strat string, feat string, ent string, value double")


def test_peer_guard_floor_and_missing(spark):
    z = lambda v: [r[0] for r in rows(zscores.robust_z(frame(spark, v), ["strat", "feat"], "value"), "z")]
    assert z([1.0, 2.0, 3.0, 4.0]) == [None] * 4, "four peers are too few"
    assert z([2.0] * 5) == [0.0] * 5, "no spread: the floor keeps the scale"
    got = dict(rows(zscores.robust_z(frame(spark, [1.0, 2.0, 3.0, 4.0, 50.0, None]), ["strat", "feat"], "value"), "ent", "z"))
    assert got["e05"] is None and got["e04"] == pytest.approx((50 - 3) / (1.4826 * 1))


def test_second_variant_falls_back_to_the_population_sd(spark):
    got = [r[0] for r in rows(zscores.robust_z_or_sd(frame(spark, [2.0, 2.0, 2.0, 2.0, 7.0]), ["strat", "feat"], "value"), "z")]
    assert max(got) == pytest.approx(5 / np.std([2, 2, 2, 2, 7]))
    assert {r[0] for r in rows(zscores.robust_z_or_sd(frame(spark, [2.0] * 5), ["strat", "feat"], "value"), "z")} == {0.0}


def test_silence_guard_counts_entities_without_the_feature(spark):
    data = [("s", "g", f"e{i}", 2.0) for i in range(2)] + [("s", "h", f"e{i}", 0.0) for i in range(12)]
    z = spark.createDataFrame(data, "strat string, feat string, ent string, value double").withColumn("z", F.lit(1.0))
    got = dict(rows(zscores.silence_guard(z, ["strat"], "feat", "ent", "value", "z").distinct(), "feat", "z"))
    assert got["g"] is None, "2 of the stratum's 12 entities exceed the level, not 2 of 2"


def test_thin_strata_blend_toward_the_feature(spark):
    data = [("f", "1", float(v)) for v in (5, 5, 9, 10)] + [("f", "2", float(v)) for v in range(30)] + [("f", "3", 3.0)]
    got = zscores.standardise(spark.createDataFrame(data, "feat string, k string, z double"), "feat", "k", "z", "out")
    own = [5.0, 5.0, 9.0, 10.0]
    every = own + [float(v) for v in range(30)] + [3.0]
    w = 4 / 29
    sd = math.sqrt(w * np.var(own, ddof=1) + (1 - w) * np.var(every, ddof=1))
    want = (10 - (w * median(own) + (1 - w) * median(every))) / sd
    assert max(r[1] for r in rows(got, "k", "out") if r[0] == "1") == pytest.approx(want)
    assert min(r[1] for r in rows(got, "k", "out") if r[0] == "2") == pytest.approx(-14.5 / np.std(range(30), ddof=1))
    assert zscores.standardise(spark.createDataFrame([("f", "1", 1.0)], "feat string, k string, z double"), "feat", "k", "z", "out").collect()[0]["out"] == 0.0


def test_three_regimes(spark):
    data = [("m", "a", "hi", f"e{i}", float(5 + i), 1.0) for i in range(6)] + [("m", "a", "mid", f"e{i}", float(i % 3), 1.0) for i in range(6)] + [("m", "a", "lo", f"e{i}", 0.0, 1.0) for i in range(6)]
    data += [("m", "b", "hi", "x1", 7.0, 1.0), ("m", "a", "hi", "e9", None, 1.0)]
    got = zscores.method_z(spark.createDataFrame(data, "m string, s string, g string, e string, v double, f double"), "m", "s", "g", "e", "v", "f")
    by = {(r["s"], r["g"], r["e"]): r for r in got.collect()}
    assert {by["a", "hi", f"e{i}"]["status"] for i in range(6)} == {0} and {by["a", "mid", f"e{i}"]["status"] for i in range(6)} == {1}
    assert by["a", "lo", "e1"]["status"] == 2 and by["a", "lo", "e1"]["z"] is None
    assert by["b", "hi", "x1"]["status"] == 3 and by["b", "hi", "x1"]["z"] is None
    assert by["a", "hi", "e9"]["status"] == 3 and by["a", "hi", "e9"]["z"] is None
    assert by["a", "mid", "e0"]["z"] == by["a", "mid", "e3"]["z"] < 0, "ties share a midrank"


def test_ranks_ties_and_missing_strata(spark):
    df = spark.createDataFrame([("g", "s", "b", 2.0), ("g", "s", "a", 2.0), ("g", None, "c", 9.0), ("g", "s", "d", None), ("g", "s", "e", 5.0)], "g string, s string, e string, v double")
    assert dict(rows(df.select("e", ranks.order_rank(["g", "s"], "v", "e").alias("r")))) == {"a": 2, "b": 3, "c": None, "d": None, "e": 1}
    assert dict(rows(df.select("e", ranks.percentile_rank(["g"], "v").alias("r")))) == {"a": 1.5 / 4, "b": 1.5 / 4, "c": 1.0, "d": None, "e": 0.75}
    assert dict(rows(df.select("e", ranks.min_rank(["g"], "v").alias("r")))) == {"c": 1, "e": 2, "a": 3, "b": 3, "d": None}


@pytest.mark.parametrize("ties", ["ordinal", "average", "drop"])
def test_equal_count_bins(spark, ties):
    v = [float(i) for i in range(15)] + [7.5] * 8
    df = spark.createDataFrame([("g", f"e{i:02d}", x) for i, x in enumerate(v)] + [("g", "null", None)], "g string, e string, v double")
    got = dict(rows(df.select("e", ranks.equal_count_bin(["g"], "v", "e", 10, ties).alias("b"))))
    assert got.pop("null") is None
    block = {got[f"e{i:02d}"] for i in range(15, 23)}
    assert len(block) > 1 if ties == "ordinal" else block == ({None} if ties == "drop" else block) and len(block) == 1
    if ties == "ordinal":
        order = sorted(range(23), key=lambda i: (v[i], i))
        assert all(got[f"e{i:02d}"] == min(k * 10 // 23, 9) for k, i in enumerate(order))


def test_regime_three_fallback_and_holes(spark):
    rng = np.random.default_rng(0)
    first = [(f"g{g}", f"e{i}", float(rng.normal()), 2) for g in range(2) for i in range(40)] + [("g0", "lonely", 0.3, 2), ("solo", "e1", 0.4, 1), ("g1", "hole", 0.2, 2), ("g0", "hole", 0.1, 2)]
    second = [(f"g{g}", f"e{i}", float(rng.normal()), 1) for g in range(2) for i in range(40)] + [("g0", "hole", 1.0, 1)]
    schema = "feat string, ent string, z double, k int"
    a, b = spark.createDataFrame(first, schema), spark.createDataFrame(second, schema)
    got = {(r["feat"], r["ent"]): r for r in combine.core_score(a, b, "feat", "ent", "z", "k").collect()}
    assert got["g0", "lonely"]["n_layers"] == 1 and got["solo", "e1"]["combination_variant"] == "A_fallback_scaled"
    assert ("g1", "hole") not in got, "a line that has the second layer elsewhere leaves a hole"
    assert "C_regime3" in {r["combination_variant"] for r in got.values()}
    assert all(0 <= r["core_score"] <= 1 for r in got.values())
    filled = {(r["feat"], r["ent"]) for r in combine.core_score(a, b, "feat", "ent", "z", "k", fill_holes=True).collect()}
    assert filled - set(got) == {("g1", "hole")}


def test_tiers_one_row_of_each(spark):
    data = [("g", "high", 0.9, 1, 0.9, "oncogene"), ("g", "med", 0.8, 1, 0.0, "oncogene"), ("g", "ctx", 0.1, 1, 0.9, "oncogene"), ("g", "low", 0.2, 1, 0.0, "oncogene"), ("g", "none", None, 0, 0.9, "oncogene"), ("t", "lof", 0.1, 1, 0.9, "tsg")]
    # the cut is 1 - 0.8 in binary, a little under 0.2
    data += [("t", f"x{i}", 0.5 + i / 10, 1, 0.0, "tsg") for i in range(5)] + [("g", f"y{i}", 0.3 + i / 100, 1, 0.0, "oncogene") for i in range(5)]
    df = spark.createDataFrame(data, "feat string, ent string, core_score double, n_layers int, p_mutation double, gene_role string")
    df = df.withColumns({"p_fusion": F.lit(0.0), "has_cna_alteration": F.lit(False), "has_driver_alteration": F.col("p_mutation") >= 0.5, "max_vep_rank": F.lit(3), "is_lof_alteration": (F.col("gene_role") == "tsg") & (F.col("p_mutation") >= 0.5)})
    got = evidence.tiers(df, "feat")
    tier = dict(rows(got, "ent", "confidence_tier"))
    assert [tier[k] for k in ("high", "med", "ctx", "low", "none", "lof")] == ["HIGH", "MEDIUM", "CONTEXT", "LOW", "NO_EVIDENCE", "HIGH"]
    assert set(evidence.tier_violations(got).collect()[0]) == {0}
    led = {r["ent"]: r for r in evidence.ledger(got).collect()}
    assert led["none"]["essentiality_check"] == "likely_non_essential" and led["high"]["layers_present"] == ["rna", "mutation"]


def test_three_valued_logic(spark):
    values = [True, False, None]
    df = spark.createDataFrame([(f"{i}{j}", a, b) for i, a in enumerate(values) for j, b in enumerate(values)], "ent string, a boolean, b boolean")
    got = {r["ent"]: (r["verdict"], r["bucket"], r["blame"]) for r in serving.set_query(df, "ent", {"a": F.col("a"), "nb": ~F.col("b")}).collect()}
    assert got["01"] == (True, "Matches", []) and got["00"][1] == "Excluded" and got["02"] == (None, "Possible", ["nb"])
    assert got["12"][1] == "Excluded" and got["22"][1] == "Possible" and got["22"][2] == ["a", "nb"]


def test_joint_rank_needs_every_feature(spark):
    data = [("e1", "a", 0.9), ("e1", "b", 0.6), ("e2", "a", 0.7), ("e3", "a", 0.8), ("e3", "b", None), ("e4", "a", 0.6), ("e4", "b", 0.6), ("e5", "b", 0.1), ("e5", "a", 0.9)]
    s = spark.createDataFrame(data, "ent string, feat string, score double")
    got = serving.rank_joint(s, ["b", "a"], "feat", "ent", "score", floor=0.5).collect()
    assert [(r["ent"], r["joint_score"], r["limiting"], r["total_passing"]) for r in got] == [("e1", 0.6, "b", 2), ("e4", 0.6, "b", 2)]
    assert serving.rank_joint(s, ["zz", "a"], "feat", "ent", "score").collect() == []
    ex = serving.rank_excluding(s, ["a"], ["b"], "feat", "ent", "score").collect()
    assert [r["ent"] for r in ex] == ["e5", "e1", "e4"]
    alt = serving.alternatives(spark.createDataFrame([("q", "e1", 0.9), ("q", "e3", 0.95), ("q", "e4", 0.9)], "ent string, neighbour string, similarity double"), s, ["a", "b"], "feat", "ent", "score")
    assert [(r["neighbour"], r["rank"]) for r in alt.orderBy("rank").collect()] == [("e1", 1), ("e4", 2)]


def test_melt_drops_missing_and_names_stay(spark):
    df = spark.createDataFrame([(1, 1.0, float("nan")), (2, None, 4.0)], "id long, `ENSG1.2` double, b double")
    assert rows(reshape.melt(df, ["id"], ["ENSG1.2", "b"])) == [(1, "ENSG1.2", 1.0), (2, "b", 4.0)]


def test_exact_quantiles_and_medians(spark):
    rng = np.random.default_rng(4)
    data = [("hot", float(x)) for x in rng.integers(0, 50, 700)] + [("one", 3.0), ("none", None), (None, 1.0), ("two", 1.0), ("two", 2.0), ("two", float("nan"))]
    df = spark.createDataFrame(data, "k string, v double").repartition(5)
    got = {r["k"]: r for r in aggregates.exact_quantiles(df, ["k"], "v", [0.0, 0.1, 0.5, 1.0]).collect()}
    own = [x for k, x in data if k == "hot"]
    assert set(got) == {"hot", "one", "two"}
    assert [got["hot"][f"q{i}"] for i in range(4)] == pytest.approx(list(np.quantile(own, [0, 0.1, 0.5, 1])))
    assert got["two"]["q2"] == 1.5 and got["one"]["q1"] == 3.0 and got["hot"]["n"] == 700
    med = {r["k"]: (r["v"], r["n_rep"]) for r in aggregates.replicate_median(df.where("v IS NULL OR NOT isnan(v)"), ["k"], "v").collect()}
    assert med["hot"] == (median(own), 700) and med["none"] == (None, 0) and med["two"] == (1.5, 2) and med[None] == (1.0, 1)


def test_resolvers(spark):
    names = spark.createDataFrame([("E1", "x", "name", 0), ("E2", "x", "alias", 1), ("E3", "y", "alias", 1), ("E4", "y", "alias", 1)], "entity string, name string, kind string, rung int")
    asked = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, None)], "id long, q string")
    got = rows(resolve.resolve_by_rungs(asked, "id", F.col("q"), names))
    assert got == [(1, "E1", "name", False), (2, "E3", "alias", True), (2, "E4", "alias", True), (3, None, None, False), (4, None, None, False)]
    assert rows(resolve.collisions(names), "name") == [("x",), ("y",)] and rows(resolve.unambiguous(names)) == []
    assert rows(resolve.first_wins(names), "name", "entity") == [("x", "E1"), ("y", "E3")]
    first, second = spark.createDataFrame([("k", "m1", 1), ("k", "m2", 2)], "k string, m string, prio int"), spark.createDataFrame([("m1", "t1"), ("m2", "t2")], "m string, t string")
    assert rows(resolve.bridge(first, second, "k", "m", "t", "prio")) == [("k", "t2")]


def test_hot_keys(spark):
    df = spark.createDataFrame([("h",)] * 50 + [(f"k{i}",) for i in range(20)] + [(None,)] * 60, "k string")
    assert rows(skew.hot_keys(df, "k", 40)) == [("h",)]


def test_partial_area_and_auroc(spark):
    rng = np.random.default_rng(1)
    score, label = rng.random(400), rng.random(400) < 0.3
    df = spark.createDataFrame([("g", f"e{i}", float(s), bool(p), float(s)) for i, (s, p) in enumerate(zip(score, label, strict=True))], "g string, e string, s double, p boolean, x double")
    want = np.mean([(a > b) + 0.5 * (a == b) for a in score[label] for b in score[~label]])
    assert ranks.auroc(df, ["g"], "s", "p").collect()[0]["auroc"] == pytest.approx(want)
    gate = audits.gate_readout(df, "g", "e", "s", "p", "x").collect()[0]
    assert gate["auc"] == pytest.approx(want, abs=0.01) and len(gate["profile"]) == 10 and gate["n_pos"] == label.sum()
    again = audits.gate_readout(df.repartition(3), "g", "e", "s", "p", "x").collect()[0]
    assert again == gate, "partitions do not matter"
    area = lambda a, b: partial_area(score, label, a, b)
    assert [gate[k] for k in audits.REGIONS] == [pytest.approx(area(*r)) for r in audits.REGIONS.values()]
    perfect = ranks.partial_areas(df.withColumn("s", F.col("p").cast("double")), ["g"], "s", "p", {"a": (0.0, 0.1), "b": (0.8, 1.0)}).collect()[0]
    assert perfect["a"] == pytest.approx(1.0)
    assert ranks.partial_areas(df.withColumn("p", F.lit(False)), ["g"], "s", "p", {"a": (0.0, 1.0)}).collect()[0]["a"] is None
    got = spark.range(1).select(audits.hypergeometric_tail(F.lit(1), F.lit(10), F.lit(3), F.lit(4)).alias("a"), audits.hypergeometric_tail(F.lit(5), F.lit(10), F.lit(3), F.lit(4)).alias("b"), audits.hypergeometric_tail(F.lit(40), F.lit(3000), F.lit(800), F.lit(200)).alias("c")).collect()[0]
    assert got["a"] == pytest.approx((math.comb(7, 4) + 3 * math.comb(7, 3)) / math.comb(10, 4)) and got["b"] == pytest.approx(1.0)
    assert got["c"] == pytest.approx(sum(math.comb(800, k) * math.comb(2200, 200 - k) for k in range(41)) / math.comb(3000, 200))


def partial_area(score, label, low, high):
    """Fine numeric integration of the stepwise-linear curve."""
    cuts = np.unique(score)[::-1]
    x, y = (np.concatenate(([0.0], [(score[k] >= c).mean() for c in cuts])) for k in (~label, label))
    grid = np.unique(np.concatenate((np.linspace(low, high, 2001), x[(x > low) & (x < high)])))
    at = np.interp((grid[1:] + grid[:-1]) / 2, x, y)
    area, chance = float((at * np.diff(grid)).sum()), (high**2 - low**2) / 2
    return (1 + (area - chance) / (high - low - chance)) / 2


@pytest.mark.parametrize("pieces", [1, 7])
def test_running_sums_over_pieces(spark, pieces):
    rng = np.random.default_rng(3)
    data = [("hot" if i % 3 else (None if i % 5 == 0 else f"k{i % 4}"), int(i), int(v)) for i, v in enumerate(rng.integers(0, 9, 900))]
    df = spark.createDataFrame(data, "g string, i int, v int")
    got = rows(running.running_sums(df.repartition(3), ["g"], [F.asc("i")], {"v": F.col("v"), "n": F.lit(1)}, pieces))
    want, total = [], {}
    for g, i, v in data:
        a, b = total.get(g, (0, 0))
        total[g] = (a + v, b + 1)
        want.append((g, i, v, *total[g]))
    want = [(g, i, v, a, b, *total[g]) for g, i, v, a, b in want]
    assert sorted(got, key=lambda r: r[1]) == want


def test_signed_rank_and_discovery_rates(spark):
    tests = {"a": [1, 2, 3, 4, 5, 6, 7], "b": [1, -2, 3, -4, 5, -6, 7], "c": [1, 2], "d": [0, None]}
    df = spark.createDataFrame([(k, float(x) if x is not None else None) for k, v in tests.items() for x in v], "g string, x double")
    got = {r["g"]: r for r in audits.signed_rank(df, ["g"], "x").collect()}
    assert got["a"]["p_value"] < 0.05 < got["b"]["p_value"] and got["a"]["w"] == 28 and got["c"]["p_value"] is None and "d" not in got
    rng = np.random.default_rng(4)
    p = np.concatenate((rng.random(200), rng.random(40) * 1e-3, [0.5, 0.5, 1.0]))
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)] + [(999, None)], "i int, p double")
    m = len(p)
    for method, factor in (("bh", 1.0), ("by", sum(1 / i for i in range(1, m + 1))), ("storey", min(1.0, (1 + (p > 0.5).sum()) / (0.5 * m)))):
        order = np.argsort(p)
        raw = p[order] * m * factor / np.arange(1, m + 1)
        want = np.empty(m)
        want[order] = np.minimum(np.minimum.accumulate(raw[::-1])[::-1], 1)
        got = {r["i"]: r["q"] for r in audits.false_discovery(df, "p", "q", method).collect()}
        assert got.pop(999) is None and [got[i] for i in range(m)] == pytest.approx(list(want))


def test_intervals(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=60)
    data = [("g", i, "ab"[i % 2], float(z[i]), 0.2, float(z[i]) if i % 3 else None, 0.3, 0.5, 0.0, 1.0, 0.9 if i == 5 else None, 2) for i in range(60)]
    df = spark.createDataFrame(data, "f string, e int, s string, z1 double, se1 double, z2 double, se2 double, beta double, centre double, sd double, point double, n_sources int")
    run = lambda d: rows(audits.score_intervals(d, "f", "e", "s", 200, 5))
    got = run(df)
    assert len(got) == 60 and got == run(df.repartition(5)), "seeded by group"
    by = {r[1]: r for r in got}
    assert by[5][2] == 0.9 and all(r[3] <= r[2] <= r[4] and r[5] == pytest.approx(r[4] - r[3]) for r in got)
    assert {r[6] for r in got} == {1, 2} and sum(r[8] for r in got) == pytest.approx(500) and sum(r[9] for r in got) == pytest.approx(1000) and sum(r[10] for r in got) == pytest.approx(100)


def test_seeded_draws_repeat(spark):
    data = [("g", f"c{i % 6}", f"e{i}", float(i % 11), i % 3 == 0) for i in range(90)]
    df = spark.createDataFrame(data, "g string, c string, e string, v double, p boolean")
    boot = lambda d: rows(audits.cluster_bootstrap(d, "g", "c", F.col("p").cast("int"), F.lit(1), 100))
    assert boot(df) == boot(df.repartition(4)) and boot(df)[0][3] <= boot(df)[0][2] <= boot(df)[0][4]
    perm = lambda d: rows(audits.permutation_test(d, "g", "c", "e", "v", "p", 50))
    assert perm(df) == perm(df.repartition(4))


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 5))
    v[7] = v[9]
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(99, None), (None, [1.0] * 5), (98, [0.0] * 5), (97, [1.0])], "id long, v array<double>")
    got = similarity.nearest(df.repartition(6), df.where("id % 10 = 0 AND id < 90"), "id", "v", 4).collect()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(0, 60, 10):
        sims = sorted(((-round(float(unit[q] @ unit[j]), 12), j) for j in range(60) if j != q))[:4]
        assert [r["neighbour"] for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])] == [j for _, j in sims]
    assert similarity.nearest(df, df.where("id < 0"), "id", "v").collect() == []


def test_clusters(spark):
    s = np.array([[1, 0.9, 0.1, 0.0], [0.9, 1, 0.2, 0.1], [0.1, 0.2, 1, 0.8], [0.0, 0.1, 0.8, 1]])
    assert clusters.average_linkage(s, 2).tolist() == [0, 0, 1, 1]
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("x", "y", 1.0), ("c", "x", 0.1)], "a string, b string, w double")
    got = dict(rows(clusters.propagate_labels(edges)))
    assert got["a"] == got["b"] == got["c"] != got["x"] == got["y"]
    same = spark.createDataFrame([(i % 3, "abc"[i % 3]) for i in range(30)], "x int, y string")
    r = clusters.agreement(same, "x", "y").collect()[0]
    assert r["ari"] == pytest.approx(1.0) and r["nmi"] == pytest.approx(1.0)


def test_variants_collapse(spark):
    data = [("one", "p", f"e{i}", float(i)) for i in range(10)]
    data += [("good", p, f"e{i}", float(i + k)) for k, p in enumerate("pq") for i in range(10)] + [("bad", p, f"e{i}", float(i * (1 if p == "p" else -1))) for p in "pq" for i in range(10)]
    got = correlate.collapse_variants(spark.createDataFrame(data, "f string, p string, e string, v double"), "f", "p", "e", "v", 5, 0.3)
    by = {(r["f"], r["e"]): (r["value"], r["rollup"]) for r in got.collect()}
    assert by["one", "e3"] == (3.0, "single") and by["good", "e3"] == (4.0, "max") and by["bad", "e3"] == (0.0, "mean")


def test_thresholds(spark):
    assert thresholds.t_quantile(0.975, 10) == pytest.approx(2.2281388520, abs=1e-8)
    assert thresholds.t_quantile(0.975, 1) == pytest.approx(12.7062047362, abs=1e-6)
    assert thresholds.critical_rho(44) == pytest.approx(0.2973, abs=1e-3)
    assert thresholds.least_rows(0.9) == 5 and thresholds.least_rows(0.0) == 300
    rng = np.random.default_rng(0)
    base = rng.normal(size=(6, 40))
    a = [(f"f{g}", f"e{i}", float(base[g, i])) for g in range(6) for i in range(40)]
    b = [(f"f{g}", f"e{i}", float(base[g, i] + rng.normal() * 0.3)) for g in range(6) for i in range(40)]
    schema = "f string, e string, v double"
    rho = thresholds.paired_correlations(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "f", "e", "v", 5)
    r = thresholds.agreement_bounds(rho).collect()[0]
    assert (r["n_null"], r["n_matched"]) == (6, 6) and r["low"] < 0.5 < 0.8 < r["high"]
