"""Check the engine's rounding rule and the oracle's (DuckDB's decimal formatting) against Python.

Usage: python tools/check_rounding.py

Values: every share f/t*100 for t < 400, 20,000 random decimals, and every
odd multiple of 1/400 in (0, 100] with its two neighbouring doubles on each
side, all with both signs.  Prints the number of values and mismatches.
"""

from __future__ import annotations

import math
import os
import random
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def values() -> list[float]:
    vals = {f / t * 100 for t in range(1, 400) for f in range(0, t + 1)}
    rnd = random.Random(1)
    vals |= {round(rnd.uniform(0, 100), rnd.randint(2, 6)) for _ in range(20000)}
    vals |= {2.675, 0.125, 1.005, 100.0, 99.995, 0.005, 0.0049, 1e-9, 3.125, -3.125, -2.675, 0.0}
    for j in range(1, 40001, 2):
        v = j / 400
        for step in (-2, -1, 0, 1, 2):
            w = v
            for _ in range(abs(step)):
                w = math.nextafter(w, math.inf if step > 0 else -math.inf)
            vals.update((w, -w))
    return sorted(vals)


def main() -> None:
    import duckdb
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from skillmesh.functions.shares import py_round_hundredths

    vals = values()
    spark = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = {r.x: r.n for r in df.select("x", py_round_hundredths(F.col("x")).alias("n")).collect()}
    bad = [v for v in vals if got[v] / 100.0 != round(v, 2)]
    print(f"spark: {len(vals)} values, {len(bad)} mismatches {bad[:5]}")

    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT unnest(?::DOUBLE[]) AS x", [vals])
    rows = con.execute("SELECT x, CAST(format('{:.2f}', x) AS DOUBLE) AS r FROM t").fetchall()
    bad = [x for x, r in rows if r != round(x, 2)]
    print(f"duckdb: {len(rows)} values, {len(bad)} mismatches {bad[:5]}")


if __name__ == "__main__":
    main()
