"""Average linkage of the entities themselves, against the greedy merges of the whole matrix."""

from __future__ import annotations

import numpy as np
import pytest

from gneiss.operators import clusters
from gneiss.operators.similarity import _unit
from gneiss.plans import audits


@pytest.mark.parametrize("n_clusters", [1, 4, 17, 150])
def test_chain_against_greedy_merges(n_clusters):
    v = _unit(np.random.default_rng(4).normal(size=(150, 6)), False)
    assert clusters.average_linkage_of(v, n_clusters).tolist() == clusters.average_linkage(v @ v.T, n_clusters).tolist()


def test_chain_ends_with_equal_and_zero_vectors():
    v = np.repeat(_unit(np.array([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.2], [0.0, 0.0]]), False), 30, axis=0)
    got = clusters.average_linkage_of(v[:90], 3)
    assert got.tolist() == [0] * 30 + [1] * 30 + [2] * 30
    assert len(set(clusters.average_linkage_of(v, 5))) == 5


def test_linkage_has_no_bound_of_the_matrix(monkeypatch):
    monkeypatch.setattr(clusters, "MOST_LINKED", 10)
    v = _unit(np.random.default_rng(4).normal(size=(40, 3)), False)
    assert len(set(clusters.average_linkage_of(v, 4))) == 4


def test_every_entity_has_a_cluster(spark, small):
    got = audits.g25_average_linkage(spark, small).collect()
    ids = [r["vec_id"] for r in audits.table(spark, small, "embeddings").collect()]
    assert sorted(r["vec_id"] for r in got) == sorted(ids) and {r["cluster"] for r in got} == {0, 1, 2, 3}


def test_missing_and_odd_vectors_take_no_part(spark):
    df = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [0.0, 1.0]), ("c", None), (None, [1.0, 1.0]), ("d", [1.0])], "e string, v array<double>")
    assert sorted(map(tuple, clusters.link_entities(df, "e", "v", 2).collect())) == [("a", 0), ("b", 1)]
    assert clusters.link_entities(df.where("e = 'c'"), "e", "v", 2).collect() == []
