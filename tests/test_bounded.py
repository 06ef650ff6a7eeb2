"""Queries of the 1 GB run: neighbours and reference sets hold no whole table in a task."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from gneiss.operators import audits, similarity
from gneiss.plans import roles


def searched(v, names, asked, k, batch):
    kind = pa.string() if isinstance(names[0], str) else pa.int64()
    units = similarity._unit(v[asked], False)
    shared = SimpleNamespace(value=(np.array([names[i] for i in asked], dtype=object), [units], kind, []))
    batches = [pa.RecordBatch.from_arrays([pa.array(names[i : i + batch]), pa.array(v[i : i + batch].tolist())], ["id", "v"]) for i in range(0, len(v), batch)]
    return [tuple(r.values()) for b in similarity._best(iter(batches), shared, k=k, centre=False) for r in b.to_pylist()]


@pytest.mark.parametrize(("tile", "named", "batch"), [(7, int, 50), (1024, "r{:04d}".format, 13), (16, int, 400)])
def test_a_task_holds_k_rows_a_query_whatever_ties(monkeypatch, tile, named, batch):
    monkeypatch.setattr(similarity, "TILE", tile, raising=False)
    rng = np.random.default_rng(4)
    v = np.vstack((np.tile(rng.normal(size=(10, 6)), (20, 1)), np.tile([1.0] * 6, (150, 1)), np.zeros((20, 6)), rng.normal(size=(40, 6)) + 4))
    v = np.vstack((v, [[np.nan] * 6]))
    v = v[rng.permutation(len(v))]
    names, asked, k = [named(i) for i in range(len(v))], [*range(0, len(v), 20)], 5
    got = searched(v, names, asked, k, batch)
    unit = similarity._unit(v, False)
    assert all(len([r for r in got if r[0] == names[q]]) <= k for q in asked), "ties beyond the k-th are not held"
    for q in asked:
        sims = {j: round(float(unit[q] @ unit[j]), 12) for j in range(len(v)) if j != q and np.isfinite(unit[q] @ unit[j])}
        want = [names[j] for j in sorted(sims, key=lambda j: (-sims[j], names[j]))[:k]]
        assert [r[1] for r in sorted((r for r in got if r[0] == names[q]), key=lambda r: (-round(r[2], 12), r[1]))] == want


@pytest.mark.parametrize("n", [3, 4, 7])
def test_fewer_rows_than_neighbours(n):
    v = np.random.default_rng(1).normal(size=(n, 3))
    assert sorted(r[:2] for r in searched(v, [*range(n)], [0, 1], 10, 2)) == [(q, j) for q in (0, 1) for j in range(n) if j != q]


def test_scale_guard_orders_the_values_over_all_tasks(spark):
    rng = np.random.default_rng(6)
    x, role = np.round(rng.normal(size=400), 2), rng.integers(0, 3, 400)
    x[role == 1] += 0.5
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, role, strict=True)] + [(None, 0)], "z double, role int").repartition(5)
    guard = lambda d: audits.scale_guard(d, "z", F.col("role") == 0, F.col("role") == 1, 0.05)
    got = guard(df)
    plan = got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "median(" not in plan and "percentile(" not in plan, "no map of all values in one task"
    a, b = x[role == 0], x[role == 1]
    want = (np.median(x), np.median(a), np.median(b), np.median(b) - np.median(a), np.percentile(b, 5))
    assert tuple(got.collect()[0])[:5] == pytest.approx(want, abs=1e-12) and got.collect()[0]["passed"]
    assert [tuple(r) for r in guard(df.where("role = 0")).collect()] == [(pytest.approx(np.median(a)), pytest.approx(np.median(a)), None, None, None, False)]
    assert [tuple(r) for r in guard(df.where("false")).collect()] == [(None,) * 5 + (False,)]


def test_prepare_takes_medians_of_all_values_and_means_of_cells(spark):
    long = spark.createDataFrame([(1, "f", 1.0), (1, "f", 2.0), (1, "f", 9.0), (2, "f", 5.0), (3, "g", 1.0), (3, "f", None)], "e int, f string, v double")
    got = {(r["e"], r["f"]): r["z"] for r in similarity.prepare(long, "e", "f", "v", 0.5).collect()}
    cells = np.array([4.0, 5.0, 3.5])  # mean of 1, 2 and 9; the measured 5; the median of 1, 2, 9 and 5
    assert got == {(i + 1, "f"): pytest.approx(z) for i, z in enumerate((cells - cells.mean()) / cells.std())}


def test_measurements_by_entity_are_the_measurements(spark, small):
    columns = ("src", "strat", "feat", "ent", "value", "n_rep")
    made = roles.measurements_by_entity(spark, small)
    assert rows(made, *columns) == rows(roles.measurements(spark, small), *columns)
