from __future__ import annotations

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from gneiss.operators import wide

SCHEMA = "row_id long, p string, g string, v string, at timestamp, m string, more string, e string"
T1, T2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)


def widen(spark, data, **kw):
    df = spark.createDataFrame(data, SCHEMA)
    return wide.widen(df, F.upper(F.trim("p")), F.trim("g"), F.col("v"), [F.col("at"), F.col("row_id")], {"m": F.col("m")}, {"reads": "bigint", "ok": "boolean", "day": "date"}, entity_name="p", **kw)


def test_latest_row_decides_whatever_its_text(spark):
    w = widen(spark, [
        (1, "a", "g1", "1.5", T1, "M", None, None), (2, "A ", "g1", "n.d.", T2, None, "x", "y"),
        (3, "a", "g2", "2,5", T1, "M", None, None), (4, "a", "g2", "3.5", T1, "M", None, None),
        (5, "b", "reads", "12", T1, None, None, None), (6, "b", "ok", " TRUE ", None, None, None, None), (7, "b", "day", "2024-02-30", T1, None, None, None),
        (8, None, "g1", "1", T1, "M", None, None), (9, "c", None, "1", T1, "M", None, None),
    ])
    got = {r["p"]: r for r in w.df.collect()}
    assert set(got) == {"A", "B"}
    assert got["A"]["g1"] is None and got["A"]["g2"] == 3.5 and got["A"]["m"] == "M"
    assert got["B"]["reads"] == 12 and got["B"]["ok"] is True and got["B"]["day"] is None and got["B"]["m"] is None
    assert got["A"]["cast_failures"] == {} and got["B"]["cast_failures"] == {"day": "2024-02-30"}
    assert rows(wide.filled_cells(w)) == [("A", "M", "g2"), ("B", None, "ok"), ("B", None, "reads")]


def test_number_forms(spark):
    texts = {"7": 7.0, " 7.5 ": 7.5, "7,5": 7.5, "7.1e+01": 71.0, "-3": -3.0, ".5": 0.5, "1,000.5": None, "5d": None, "NaN": None, "Infinity": None, "1e999": None, "": None, "x" * 5000: None, None: None}
    df = spark.createDataFrame(list(texts.items()), "v string, want double")
    for r in df.select("v", "want", wide.typed(F.col("v"), "double").alias("got")).collect():
        assert r["got"] == r["want"], r


def test_every_key_has_a_typed_column_in_some_block(spark):
    data = [(i, "a", f"g{i}", str(i), T1, "M", None, None) for i in range(5)] + [(9, "b", "g3", "7", T1, None, None, None), (10, "a", "reads", "6", T1, "M", None, None), (11, "b", "g4", "?x", T1, None, None, None)]
    whole, parts = widen(spark, data), widen(spark, data, block_columns=2)
    assert [list(c) for c in parts.columns] == [["reads", "ok", "day", "g0", "g1"], ["g2", "g3"], ["g4"]] and len(whole.blocks) == 1
    assert rows(wide.filled_cells(parts)) == rows(wide.filled_cells(whole)) and len(rows(wide.filled_cells(parts))) == 7
    assert all(dict(b.dtypes)[c] == "double" for b, cs in zip(parts.blocks, parts.columns) for k, c in cs.items() if k.startswith("g"))
    assert {r["p"]: r["cast_failures"] for r in parts.blocks[0].collect()} == {"A": {}, "B": {"g4": "?x"}}
    with pytest.raises(ValueError, match="3 blocks"):
        _ = parts.df


def test_integers_of_any_length(spark):
    texts = {"9223372036854775807": 2**63 - 1, "-9223372036854775808": -(2**63), "9223372036854775808": None, "000000000000000000000000012": 12, "+5": 5, "1.0": None}
    df = spark.createDataFrame(list(texts.items()), "v string, want long")
    for r in df.select("v", "want", wide.typed(F.col("v"), "bigint").alias("got")).collect():
        assert r["got"] == r["want"], r


def test_empty_table_and_clashing_names(spark):
    w = widen(spark, [])
    assert w.df.collect() == [] and {"p", "m", "reads", "ok", "day"} <= set(w.df.columns)
    w = widen(spark, [(1, "a", "more", "1", T1, "M", None, None), (2, "a", "P", "2", T1, "M", None, None)])
    assert sorted(r[2] for r in rows(wide.filled_cells(w))) == ["P", "more"]
