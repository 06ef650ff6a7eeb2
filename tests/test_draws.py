"""Queries with random draws are registered with the full numbers of draws."""

from __future__ import annotations

import pytest

from gneiss.plans import audits


@pytest.mark.parametrize(("name", "operator", "place", "draws"), [("g11_cluster_bootstrap", "cluster_bootstrap", 5, 600), ("g30_score_intervals", "score_intervals", 4, 500)])
def test_draws(spark, small, monkeypatch, name, operator, place, draws):
    seen = []
    monkeypatch.setattr(audits.audits, operator, lambda *args: seen.append(args[place]))
    audits.QUERIES[name](spark, small)
    assert seen == [draws]
