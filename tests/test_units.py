from __future__ import annotations

import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from gneiss.operators import units

NAMED = {
    "log2(TPM+1)": "log2tpm1", "Log-2 TPM+1": "log2tpm1", "log2tpm1": "log2tpm1", "lb(tpm+1)": "log2tpm1", "base-2 logarithm of TPM plus one": "log2tpm1",
    "log 2 transformed TPM, offset 1": "log2tpm1", "values on the log2 (tpm + 1) scale": "log2tpm1", "log10(TPM + 1)": "log10tpm1", "LOG10TPM1": "log10tpm1",
    "lg (TPM + 1)": "log10tpm1", "decadic logarithm of TPM plus one": "log10tpm1", "common log, base ten, of tpm + 1": "log10tpm1", "log-10 tpm+1": "log10tpm1",
    "ln(TPM+1)": "lntpm1", "ln": "lntpm1", "nat. log": "lntpm1", "natural log of tpm+1": "lntpm1", "loge of tpm+1": "lntpm1", "log1p of TPM (base e)": "lntpm1",
    "log1p(TPM)": "lntpm1", "TPM": "tpm", "tpm, linear": "tpm", "TPM, not logged": "tpm", "values are plain TPM": "tpm", "linear tpm after normalisation": "tpm",
    "reported as transcripts per million (linear scale)": "tpm", "kTPM": "ktpm", "kTPM, linear": "ktpm", "10^3 TPM": "ktpm", "TPM x 10^-3": "ktpm", "thousand TPM": "ktpm",
    "values divided by 1000 (kTPM)": "ktpm", "in thousands of TPM": "ktpm", "rep 2": None, "edge well": None, "see plate map": None, "": None, None: None,
    "signals summarised per gene": None, "background removed, then quantile normalisation": None, "processed with the standard workflow of the core facility": None,
    "arrays scaled and summarised per probe set": None, "signals summarised per gene; ln(TPM+1)": "lntpm1",
}


def test_named_units(spark):
    df = spark.createDataFrame(list(NAMED.items()), "t string, want string")
    for r in df.select("t", "want", units.unit_named(F.col("t")).alias("got")).collect():
        assert r["got"] == r["want"], r


@pytest.mark.parametrize("unit", list(units.TO_TPM))
def test_conversions(spark, unit):
    tpm = 123.0
    x = {"tpm": tpm, "ktpm": tpm / 1000, "log2tpm1": math.log2(tpm + 1), "log10tpm1": math.log10(tpm + 1), "lntpm1": math.log(tpm + 1)}[unit]
    got = spark.createDataFrame([(x, unit)], "x double, u string").select(units.to_target(F.col("x"), F.col("u")).alias("y")).collect()[0]["y"]
    assert got == pytest.approx(math.log2(tpm + 1))


def test_product_identity_finds_units_and_flags_ties(spark):
    # mass = density x volume, stated in g or kg, ml or l
    data = [("s1", 2.0 * v * d, d, v / 1000) for v, d in ((10.0, 0.5), (20.0, 0.7), (33.0, 1.3))]
    data = [("s1", m / 2, d, v) for _, m, d, v in data] + [("s2", 0.001 * v * d, d, v) for v, d in ((10.0, 0.5), (20.0, 0.7))] + [("s3", None, 1.0, 1.0)]
    df = spark.createDataFrame(data, "s string, mass double, density double, volume double")
    got = units.solve_units(
        df, ["s"], {"mass": units.scales(g=1.0, kg=1000.0), "density": units.scales(g_per_ml=1.0), "volume": units.scales(ml=1.0, l=1000.0)},
        units.product_residual({"mass": 1, "density": -1, "volume": -1}),
    )
    got = {r["s"]: r for r in got.collect()}
    assert (got["s1"]["mass_unit"], got["s1"]["volume_unit"], got["s1"]["unique"]) == ("g", "l", True)
    assert (got["s2"]["mass_unit"], got["s2"]["volume_unit"], got["s2"]["unique"]) == ("kg", "ml", True)
    assert got["s3"]["mass_unit"] is None and got["s3"]["unique"] is False
    same = units.solve_units(df.where("s = 's1'"), ["s"], {"mass": units.scales(a=1.0, b=1.0), "density": units.scales(x=1.0), "volume": units.scales(l=1000.0)}, units.product_residual({"mass": 1, "density": -1, "volume": -1}))
    assert same.collect()[0]["unique"] is False


def harmonised(spark, data):
    df = spark.createDataFrame(data, "id long, s string, f string, x double, note string, txt string, hint string, unit string, value string")
    return units.harmonise(df, "id", "s", "f", "x", [F.col("note"), F.col("txt")], F.col("hint"))


def test_precedence_and_solving(spark):
    known = [(100 + i, "k", f"g{i}", float(i + 1), "log2 TPM+1", None, None, None, None) for i in range(10)]
    tpm = [(200 + i, "t", f"g{i}", 2.0 ** (i + 1) - 1, None, "", "unknown", None, None) for i in range(10)]
    log = [(300 + i, "l", f"g{i}", float(i + 1), "rep 2", None, None, None, None) for i in range(10)]
    other = [(1, "t", "g1", 3.0, "kTPM", "ln(TPM+1)", "log", None, None), (2, "t2", "g1", 3.0, None, "ln(TPM+1)", "log", None, None), (3, "t3", "g1", 3.0, None, None, "LINEAR ", None, None), (4, "t4", "g1", None, None, None, None, None, None), (5, None, "g1", float("nan"), "tpm", None, None, None, None), (6, None, None, 5.0, None, None, None, None, None)]
    got = {r["row_id"]: r for r in harmonised(spark, known + tpm + log + other).collect()}
    assert len(got) == 36
    assert {got[200 + i]["unit"] for i in range(10)} == {"tpm"} and {got[300 + i]["unit"] for i in range(10)} == {"log2tpm1"}
    assert got[203]["value"] == pytest.approx(4.0) and got[203]["unit_from"] == "solved"
    assert [got[i]["unit"] for i in (1, 2, 3, 4)] == ["ktpm", "lntpm1", "tpm", None]
    assert got[5]["value"] is None and got[6]["unit"] is not None


def test_empty(spark):
    assert rows(harmonised(spark, [])) == []


def test_named_units_are_held_against_the_levels(spark):
    known = [(100 + i, f"k{k}", f"g{i}", float(i + 1), "log2 TPM+1", None, None, None, None) for i in range(10) for k in range(4)]
    wrong = [(200 + i, "w", f"g{i}", 2.0 ** (i + 1) - 1, "log2 TPM+1", None, None, None, None) for i in range(8)]
    right = [(300 + i, "r", f"g{i}", 2.0 ** (i + 1) - 1, "TPM", None, None, None, None) for i in range(10)]
    df = spark.createDataFrame(known + wrong + right, "id long, s string, f string, x double, note string, txt string, hint string, unit string, value string")
    got = units.harmonise(df, "id", "s", "f", "x", [F.col("note"), F.col("txt")], F.col("hint"), check=True)
    assert {(r["sample"][0], r["unit"], r["agrees"]) for r in got.collect()} == {("k", "log2tpm1", True), ("w", "log2tpm1", False), ("r", "tpm", True)}


def test_without_any_named_unit_the_typical_level_decides(spark):
    rows_ = [(i, "t", f"g{i}", 900.0 + i, None, None, None, None, None) for i in range(5)] + [(9 + i, "l", f"g{i}", 3.1, None, None, None, None, None) for i in range(5)]
    assert {(r["sample"], r["unit"]) for r in harmonised(spark, rows_).collect()} == {("t", "tpm"), ("l", "log2tpm1")}
