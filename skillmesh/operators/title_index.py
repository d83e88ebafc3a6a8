"""Trigram index for "title contains" requests (F1, F2).

``write_title_index`` stores each distinct title once, under a 64-bit key, and
for each of the three-character pieces of its lower-cased text the keys of
the titles that have it.  A request intersects the lists of its own pieces,
the shortest first, tests the titles that are left, and the postings are kept
by a semi join on the title: the substring test runs once a candidate title, never once
a posting.  Keys may collide: the test is on the text, and the join on the title.

Lists are cut into ``PARTS`` by key, so that a list of a piece that most titles have is
several rows, and intersections meet part by part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillmesh.functions.text import country_contains

PARTS, BUCKETS = 256, 64
#: Characters of a piece.
PIECE = 3


_PIECES = "piece string, part int, keys array<bigint>, bucket int"


def _bucket(piece: Column) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(BUCKETS)).cast("int")


def write_title_index(postings: DataFrame, path: str, parts: int = PARTS) -> None:
    """Writes the index of the distinct ``job_title`` values to ``path``."""
    spark = postings.sparkSession
    titles = postings.select("job_title").where(F.col("job_title").isNotNull()).distinct()
    keyed = titles.select(F.xxhash64("job_title").alias("key"), "job_title", F.lower("job_title").alias("folded"))
    keyed.withColumn("part", F.pmod("key", F.lit(parts)).cast("int")).write.parquet(f"{path}/titles")
    pieces = F.expr(
        f"CASE WHEN length(folded) >= {PIECE} THEN array_distinct(transform(sequence(1, length(folded) - {PIECE - 1}), "
        f"i -> substring(folded, i, {PIECE}))) ELSE array() END"
    )
    rows = spark.read.parquet(f"{path}/titles").select("part", "key", F.explode(pieces).alias("piece"))
    lists = rows.groupBy("piece", "part").agg(F.sort_array(F.collect_set("key")).alias("keys")).withColumn("bucket", _bucket(F.col("piece")))
    ordered = lists.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "piece", "part")
    ordered.write.partitionBy("bucket").parquet(f"{path}/pieces")


def candidate_keys(spark: SparkSession, path: str, needle: str) -> DataFrame | None:
    """``part`` and ``keys`` of the titles that have every piece of ``needle``; None if it is shorter than a piece."""
    pieces = sorted({needle[i : i + PIECE] for i in range(len(needle) - PIECE + 1)})
    if not pieces:
        return None
    table = spark.read.schema(_PIECES).parquet(f"{path}/pieces")
    own = {p: table.where((F.col("bucket") == _bucket(F.lit(p))) & (F.col("piece") == F.lit(p))).select("part", "keys") for p in pieces}
    sizes = table.where("false").select("piece", F.lit(0).alias("n"))
    for p, lists in own.items():
        sizes = sizes.unionAll(lists.select(F.lit(p), F.size("keys")))
    times = {r.piece: r.n for r in sizes.groupBy("piece").agg(F.sum("n").alias("n")).collect()}  # a row a piece of the needle
    out = None
    for p in sorted(pieces, key=lambda p: (times.get(p, 0), p)):
        if out is None:
            out = own[p]
            continue
        met = out.join(own[p].withColumnRenamed("keys", "other"), "part")
        out = met.select("part", F.array_intersect("keys", "other").alias("keys")).where(F.size("keys") > 0)
    return out


def titles_containing(spark: SparkSession, path: str, needle: str) -> DataFrame:
    """The distinct indexed titles that contain ``needle``, any case."""
    needle = needle.lower()
    titles, candidates = spark.read.parquet(f"{path}/titles"), candidate_keys(spark, path, needle)
    if candidates is not None:
        titles = titles.join(candidates.select(F.explode("keys").alias("key")), "key", "left_semi")
    return titles.where(F.col("folded").contains(F.lit(needle))).select("job_title")


def matched_postings_indexed(postings: DataFrame, path: str, title: str, country: str) -> DataFrame:
    """As ``matched_postings`` for postings whose titles are indexed at ``path``."""
    found = titles_containing(postings.sparkSession, path, title)
    return postings.where(country_contains(postings, country)).join(found, "job_title", "left_semi").select(*postings.columns)
