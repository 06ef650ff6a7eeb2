"""Statistics over all similarities, against brute force over every pair."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.operators import ranks, serving, similarity


def sample(spark, n=90, size=8, seed=3):
    v = np.random.default_rng(seed).normal(size=(n, size))
    v[7] = v[9]
    df = spark.createDataFrame([(i, [float(x) for x in row], i % 3) for i, row in enumerate(v)], "id long, v array<double>, label int")
    return v, df.repartition(5)


def cosines(v):
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    return unit @ unit.T


def pairs_of(n, every=10):
    return [(i, j) for i in range(0, n, every) for j in range(n) if i != j]


@pytest.mark.parametrize("block", [3, 2048])
def test_axis_correlation_takes_every_pair(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "QUERY_BLOCK", block)
    v, df = sample(spark)
    df = df.select("id", F.slice("v", 1, 4).alias("a"), F.slice("v", 5, 4).alias("b")).unionByName(spark.createDataFrame([(500, [1.0] * 4, None), (None, [1.0] * 4, [1.0] * 4)], "id long, a array<double>, b array<double>"))
    got = similarity.axis_correlation(df, df.where("id % 10 = 0 AND id < 90"), "id", "a", "b").collect()[0]
    a, b = cosines(v[:, :4]), cosines(v[:, 4:])
    x, y = zip(*[(a[i, j], b[i, j]) for i, j in pairs_of(90)], strict=True)
    assert got["n"] == 9 * 89 and got["r"] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-12)
    assert similarity.axis_correlation(df, df.where("id < 0"), "id", "a", "b").collect()[0]["n"] == 0


@pytest.mark.parametrize("block", [3, 2048])
def test_resolution_takes_every_pair(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "QUERY_BLOCK", block)
    v, df = sample(spark)
    got = similarity.resolution(df, df.where("id % 10 = 0"), "id", "v").collect()
    s = cosines(v)
    every = [s[i, j] for i, j in pairs_of(90)]
    gaps = [np.max(own) - np.median(own) for i in range(0, 90, 10) for own in [np.delete(s[i], i)]]
    assert [tuple(r) for r in got] == [pytest.approx((*np.percentile(every, [1, 50, 99]), np.median(gaps)), abs=1e-12)]


def test_separation_takes_every_pair(spark):
    v, df = sample(spark)
    df = df.unionByName(spark.createDataFrame([(200, [1.0] * 8, None)], "id long, v array<double>, label int"))
    got = similarity.separation(df, df.where("id % 10 = 0"), "id", "v", "label").collect()[0]
    s = cosines(v).round(12)
    same = [s[i, j] for i, j in pairs_of(90) if i % 3 == j % 3]
    other = [s[i, j] for i, j in pairs_of(90) if i % 3 != j % 3]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in same for b in other])
    assert (got["n_pos"], got["n_neg"]) == (len(same), len(other)) and got["auroc"] == pytest.approx(want, abs=1e-12)


def test_auroc_of_all_with_ties_over_pieces(spark):
    rng = np.random.default_rng(5)
    score, label = rng.integers(0, 40, 500) / 8.0, rng.random(500) < 0.4
    df = spark.createDataFrame([(float(s), bool(p)) for s, p in zip(score, label, strict=True)] + [(None, True), (1.0, None)], "s double, p boolean")
    got = ranks.auroc_of_all(df.repartition(6), "s", "p").collect()[0]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in score[label] for b in score[~label]])
    assert (got["n_pos"], got["n_neg"]) == (label.sum(), (~label).sum()) and got["auroc"] == pytest.approx(want)
    assert tuple(ranks.auroc_of_all(df.where("p"), "s", "p").collect()[0])[2] is None


def test_nearest_able_looks_beyond_the_first_neighbours(spark):
    v, df = sample(spark)
    fit = [i for i in range(90) if i % 7 == 0]
    scores = spark.createDataFrame([(i, f, 0.5) for i in fit for f in "ab"] + [(i, "a", 0.9) for i in range(90)] + [(8, "b", None)], "ent long, feat string, score double")
    got = serving.nearest_able(df, df.where("id % 10 = 0"), "id", "v", scores, ["a", "b"], "feat", "ent", "score", 5).collect()
    s = cosines(v)
    for q in range(0, 90, 10):
        want = sorted((-round(s[q, j], 12), j) for j in fit if j != q)[:5]
        assert [r["neighbour"] for r in sorted((r for r in got if r["ent"] == q), key=lambda r: r["rank"])] == [j for _, j in want]
    assert len(got) == 45


def test_prepare_fills_and_standardises(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 5))
    x[rng.random(x.shape) < 0.15] = np.nan
    x[:, 3] = 1.0
    x[5:, 4] = np.nan
    long = spark.createDataFrame([(i, f"f{j}", float(x[i, j])) for i in range(40) for j in range(5) if not np.isnan(x[i, j])] + [(77, "f0", None)], "e int, f string, v double")
    got = {(r["e"], r["f"]): r["z"] for r in similarity.prepare(long, "e", "f", "v", 0.4).collect()}
    filled = np.vstack((x[:, :3], np.full((1, 3), np.nan)))
    filled = np.where(np.isnan(filled), np.nanmedian(filled, axis=0), filled)
    want = (filled - filled.mean(axis=0)) / filled.std(axis=0)
    ids = [*range(40), 77]
    assert len(got) == 41 * 3, "neither a feature without spread nor a sparse one"
    assert all(abs(got[e, f"f{j}"] - want[i, j]) < 1e-9 for i, e in enumerate(ids) for j in range(3))
