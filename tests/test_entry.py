"""The driver contract, and a sample of queries against their SQL on the smallest tables."""

from __future__ import annotations

import math
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__  # noqa: E402

SAMPLE = ["p1_found", "p1_profiles", "p2_found", "p3_found", "p3_by_month", "p3_current", "a01_replicate_median", "w16_method_z", "c11_core_score", "c19_confidence_tiers", "q02_joint_rank", "q19_three_valued_query", "j12_resolve_by_rungs", "g01_nearest_neighbours"]


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.8g}") + 0.0
    return v.replace(tzinfo=None) if getattr(v, "tzinfo", None) else v


def ordered(rows):
    return sorted((tuple(value(x) for x in r) for r in rows), key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def test_contract():
    queries, oracle = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracle) <= set(queries)
    assert {f"p{n}_found" for n in (1, 2, 3, 6)} <= set(queries)


def test_entry(spark, small):
    assert __spark_entry__.entry(spark).columns == ["profile_id", "model_id", "gene_id"]


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, small, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(small):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{small}/{f}')")
    df = __spark_entry__.queries()[name](spark, small)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert ordered(df.select(*columns).collect()) == ordered([tuple(r[i] for i in at) for r in want.fetchall()])
