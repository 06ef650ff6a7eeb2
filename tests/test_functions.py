from __future__ import annotations

import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from gneiss.functions import stats
from gneiss.functions.ids import ensembl_id, gene_id, lower_label, nan_to_null, upper_id


def one(spark, schema, data, **columns):
    return [r.asDict() for r in spark.createDataFrame(data, schema).select(*[c.alias(k) for k, c in columns.items()]).collect()]


def test_normal_distribution(spark):
    xs = [-40.0, -8.2, -7.0, -3.3, -1.0, -1e-9, 0.0, 0.5, 2.0, 6.5, 7.5, 38.0, None]
    for x, r in zip(xs, one(spark, "x double", [(x,) for x in xs], y=stats.phi("x")), strict=True):
        assert (r["y"] is None) == (x is None)
        if x is not None:
            assert r["y"] == pytest.approx(0.5 * math.erfc(-x / math.sqrt(2)), abs=1e-14)
    ps = [1e-12, 1e-6, 0.001, 0.07, 0.25, 0.5, 0.77, 0.95, 0.999999, 0.0, 1.0, -1.0, None]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    for p, r in zip(ps, stats.with_phi_inverse(df, "p", "z").collect(), strict=True):
        if p is not None and 0 < p < 1:
            assert r["z"] == pytest.approx(NormalDist().inv_cdf(p), rel=1e-12, abs=1e-12)
        else:
            assert r["z"] is None


def test_hill_and_noisy_or(spark):
    got = one(spark, "x double, y double", [(2.5, None), (-1.0, 0.5), (None, None)], h=stats.hill("x", 2.5, 2), n=stats.noisy_or("x", "y"))
    assert [g["h"] for g in got] == [0.5, 0.0, None]
    assert [g["n"] for g in got] == [2.5, 0.0, 0.0]
    assert got[1]["n"] == pytest.approx(1 - 2 * 0.5)


def test_null_propagation(spark):
    got = one(
        spark, "a double, b double", [(1.0, None), (3.0, 2.0), (2.0, 2.0)], low=stats.strict_min([F.col("a"), F.col("b")]), first=stats.argmin_name({"b": F.col("b"), "a": F.col("a")}, ["b", "a"]),
        alpha=stats.argmin_name({"b": F.col("b"), "a": F.col("a")}, ["a", "b"]), c=stats.clip(F.col("b"), -1.0, 1.0), s=stats.selectivity(F.col("a"), [F.col("b")]), l=stats.log2p1(F.col("b")),
    )
    assert got[0] == {"low": None, "first": None, "alpha": None, "c": None, "s": None, "l": None}
    assert got[1]["low"] == 2.0 and got[1]["first"] == "b" and got[1]["c"] == 1.0 and got[1]["s"] == -3.0
    assert got[2]["first"] == "b" and got[2]["alpha"] == "a", "ties: the first of the given order"


def test_bands_ramps_and_signs(spark):
    got = one(
        spark, "x double, y double", [(None, 1.0), (0.8, -2.0), (0.5, 0.1), (float("nan"), 2.0), (0.1, None)],
        band=stats.score_band(F.col("x")), ramp=stats.confidence_ramp(F.col("x"), 0.3, 0.7), step=stats.confidence_ramp(F.col("x"), 0.5, 0.5), opp=stats.signs_disagree(F.col("x") * 2, F.col("y")),
    )
    assert [g["band"] for g in got[:3]] == ["likely_non_essential", "likely_essential", "possibly_essential"]
    assert [g["ramp"] for g in got] == [1.0, 1.0, pytest.approx(0.5), 1.0, 0.0]
    assert [g["step"] for g in got] == [1.0, 1.0, 1.0, 1.0, 0.0]
    assert [g["opp"] for g in got] == [False, True, False, False, False]


def test_ids(spark):
    data = [("ENSG00000123456",), (" ensg00000123456.7 ",), ("ENSP00000000001",), ("junk",), ("",), (None,), ("\tAch-1 ",)]
    got = one(spark, "x string", data, e=ensembl_id(F.col("x")), g=gene_id(F.col("x")), u=upper_id(F.col("x")), l=lower_label(F.col("x")))
    assert [g["e"] for g in got] == ["ENSG00000123456"] * 2 + [None] * 5
    assert got[1]["g"] == "ENSG00000123456" and got[2]["g"] == "ENSP00000000001" and got[4]["g"] is None
    assert got[6]["u"] == "ACH-1" and got[6]["l"] == "ach-1"
    assert one(spark, "x double", [(float("nan"),), (1.0,), (None,)], y=nan_to_null(F.col("x"))) == [{"y": None}, {"y": 1.0}, {"y": None}]
