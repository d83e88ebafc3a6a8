"""Python-style rounding of doubles (functions.shares) against Python itself."""

import math
import random

from pyspark.sql import functions as F

from skillmesh.functions.shares import py_round_hundredths


def _values():
    vals = {f / t * 100 for t in range(1, 120) for f in range(0, t + 1)}
    rnd = random.Random(5)
    vals |= {round(rnd.uniform(-100, 200), rnd.randint(2, 7)) for _ in range(3000)}
    for j in range(1, 4001, 2):  # every odd multiple of 1/400 and its neighbours
        v = j / 400
        for step in (-2, -1, 1, 2):
            w = v
            for _ in range(abs(step)):
                w = math.nextafter(w, math.inf if step > 0 else -math.inf)
            vals.update((w, -w))
        vals.update((v, -v))
    vals |= {2.675, 1.005, 0.125, 3.125, 0.0, 1e-12, 99.995, 100.00000000000001}
    return sorted(vals)


def test_matches_python_round(spark):
    vals = _values()
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = {r.x: r.n for r in df.select("x", py_round_hundredths(F.col("x")).alias("n")).collect()}
    bad = [(v, got[v]) for v in vals if got[v] / 100.0 != round(v, 2)]
    assert not bad, bad[:5]


def test_spark_round_differs_on_binary_ties(spark):
    row = spark.range(1).select(F.round(F.lit(3.125), 2).alias("r"), F.bround(F.lit(2.675), 2).alias("b")).first()
    assert (row.r, row.b) == (3.13, 2.68)  # hence the exact rule above
    assert (round(3.125, 2), round(2.675, 2)) == (3.12, 2.67)
