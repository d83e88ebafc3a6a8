"""Tabulate the executed (final adaptive) plan of every registered query of the survey's operators.

Usage: python tools/plan_report.py [sf_dir] > PLANS.md

Each query is run once (collected; the test scales are small) and the
final plan is scanned for the operators that decide cost at scale.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

COUNTED = [
    ("shuffles", r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition|Exchange RoundRobin"),
    ("broadcasts", r"BroadcastExchange"),
    ("reused", r"ReusedExchange"),
    ("BHJ", r"BroadcastHashJoin"),
    ("SMJ", r"SortMergeJoin"),
    ("SHJ", r"ShuffledHashJoin"),
    ("BNLJ", r"BroadcastNestedLoopJoin|CartesianProduct"),
    ("top-k", r"TakeOrderedAndProject"),
    ("window limit", r"WindowGroupLimit"),
    ("sort agg", r"SortAggregate"),
    ("python", r"BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas|MapInArrow"),
]


def final_plan(df) -> str:
    """Runs the DataFrame's own query and returns the final part of its
    adaptive plan (the printout also repeats the initial plan)."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    from pyspark.sql import SparkSession

    from skillmesh.plans import registry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    header = ["key"] + [c for c, _ in COUNTED]
    print(f"Final adaptive plans of the registered queries at `{sf_dir}` (counts of operators).\n")
    print("| " + " | ".join(header) + " |")
    print("| " + " | ".join("---" for _ in header) + " |")
    for key, fn in registry.QUERIES.items():
        text = final_plan(fn(spark, sf_dir))
        cells = [f"`{key}`"] + [str(len(re.findall(p, text))) for _, p in COUNTED]
        print("| " + " | ".join(cells) + " |", flush=True)


if __name__ == "__main__":
    main(sys.argv)
