"""The row-wise minimum is of every feature."""

from __future__ import annotations

from gneiss.plans import scoring


def test_strict_min_of_every_feature(spark, small):
    wide = {(r["feat"], r["ent"]): (r["a"], r["b"], r["c"]) for r in scoring.wide_z(spark, small).collect()}
    got = {(r["feat"], r["ent"]): (r["low"], r["which"], r["opposed"]) for r in scoring.m09_strict_min_and_signs(spark, small).collect()}
    assert got.keys() == wide.keys() and len({f for f, _ in got}) > 1
    for key, (a, b, c) in wide.items():
        low, which, opposed = got[key]
        if None in (a, b, c):
            assert (low, which) == (None, None)
        else:
            assert low == round(min(a, b, c), 6) and {"a": a, "b": b, "c": c}[which] == min(a, b, c)
        assert opposed == (a is not None and b is not None and abs(a) > 1 and abs(b) > 1 and a * b < 0)
