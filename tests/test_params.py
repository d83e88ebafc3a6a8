"""Argument handling: Python slice semantics on sorted DataFrames, limit coercion."""

import random

from skillmesh.functions.params import coerce_limit, slice_sorted, strict_int


def test_slice_sorted_matches_python_slicing(spark):
    df = spark.range(23).selectExpr("id * 7 % 23 AS v").orderBy("v")
    full = [r.v for r in df.collect()]
    rnd = random.Random(3)
    cases = [(0, None), (0, 0), (5, 5), (0, 100), (30, 40)]
    cases += [(rnd.randint(-30, 30), rnd.choice([None, rnd.randint(-30, 30)])) for _ in range(30)]
    for start, stop in cases:
        assert [r.v for r in slice_sorted(df, start, stop).collect()] == full[start:stop], (start, stop)


def test_coerce_limit():
    assert coerce_limit(None) is None
    assert coerce_limit(0) is None and coerce_limit("") is None
    assert coerce_limit("7") == 7 and coerce_limit(7.9) == 7
    assert coerce_limit("abc") == 10 and coerce_limit("7.5") == 10
    assert coerce_limit(-2) == -2


def test_strict_int():
    assert strict_int("12", "limit") == 12
    try:
        strict_int("x", "limit")
    except ValueError as exc:
        assert "limit" in str(exc)
    else:
        raise AssertionError("expected ValueError")
