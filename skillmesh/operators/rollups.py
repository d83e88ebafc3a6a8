"""Summary tables built from postings.

Each is a single ``groupBy`` with map-side partial aggregation, so a hot
key (one title or country holding a third of all postings) is collapsed
before the shuffle.  The nested builders (R4, R5) sort each group's list
with ``sort_array`` after ``collect_list``; a list holds one entry per
distinct title of a country or month, never one per posting, and at most
``LIST_ROWS`` of them: a key with more titles gets several rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skillmesh.functions.text import skills_lower, split_skills


def skill_tokens(postings: DataFrame, *keep: str) -> DataFrame:
    """One row per non-blank trimmed skill token, case kept."""
    ex = postings.select(*keep, F.explode(split_skills("job_skills")).alias("skill"))
    return ex.select(*keep, F.trim("skill").alias("skill")).filter(F.col("skill") != "")


def skill_tokens_lower(postings: DataFrame, *keep: str) -> DataFrame:
    """One row per non-blank skill token, trimmed and lower-cased."""
    ex = postings.select(*keep, F.explode(skills_lower("job_skills")).alias("skill"))
    return ex.filter(F.col("skill") != "")


def build_skill_counts(postings: DataFrame) -> DataFrame:
    """``skill, count``."""
    return skill_tokens(postings).groupBy("skill").agg(F.count(F.lit(1)).alias("count"))


def build_skill_counts_by_country(postings: DataFrame) -> DataFrame:
    """``search_country, skill, count`` (R2)."""
    return (
        skill_tokens(postings, "search_country")
        .groupBy("search_country", "skill")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def build_job_counts(postings: DataFrame) -> DataFrame:
    """``job_title, count``."""
    return postings.groupBy("job_title").agg(F.count(F.lit(1)).alias("count"))


def sort_job_list(arr) -> F.Column:
    """Order an ``array<struct<job_title, count>>`` by count desc, title.

    By the natural order of (-count, title): a comparator as a lambda is
    interpreted at every comparison.
    """
    keyed = F.transform(arr, lambda j: F.struct((-j["count"]).alias("less"), j["job_title"].alias("job_title"), j["count"].alias("count")))
    return F.transform(F.sort_array(keyed), lambda j: F.struct(j["job_title"].alias("job_title"), j["count"].alias("count")))


#: Entries of a nested list at most.
LIST_ROWS = 100_000
#: Groups of a key's titles whose sizes give the running count.
GROUPS = 1024
# Stands for a NULL key inside the builder; no country or month is this text.
_NULL_KEY = "\0"


def _nested(postings: DataFrame, key: str, list_name: str, rows_per_key: int, list_rows: int | None) -> DataFrame:
    """The lists of each key, in rows of at most ``list_rows`` entries (with
    ``rows_per_key``, in so many rows by a hash of the title).

    Entries are numbered without gathering a key: inside groups of titles by
    hash, on top of the running sum of the sizes of the groups before (at most ``GROUPS`` a
    key).  The number divided by ``list_rows`` is the row of the entry.
    The hash and the order are those of the titles, so retried tasks agree.
    """
    list_rows = list_rows or LIST_ROWS
    pairs = postings.groupBy(key, "job_title").agg(F.count(F.lit(1)).alias("count"))
    entries = sort_job_list(F.collect_list(F.struct("job_title", "count"))).alias(list_name)
    if rows_per_key > 1:
        part = F.pmod(F.xxhash64("job_title"), F.lit(rows_per_key)).alias("_part")
        return pairs.groupBy(key, part).agg(entries).select(key, list_name)
    # With a text for NULL both branches below join by plain equality, across which
    # Spark carries a filter on the key (a lookup's country) from one to the other.
    keyed = F.coalesce(key, F.lit(_NULL_KEY)).alias("_key")
    grouped = pairs.select(keyed, "job_title", "count", F.pmod(F.xxhash64("job_title"), F.lit(GROUPS)).alias("_group"))
    # ``count`` closes both orders although it decides nothing: it stays alive
    # in both branches, so both read the one aggregate (ReusedExchange); so
    # does the null-safe comparison, which infers no filter on one of them.
    inside = Window.partitionBy("_key", "_group").orderBy("job_title", "count")
    numbered = grouped.withColumn("_nth", F.row_number().over(inside))
    sizes = grouped.groupBy(F.col("_key").alias("_of_key"), F.col("_group").alias("_of")).agg(F.count(F.lit(1)).alias("_size"), F.sum("count").alias("_all"))
    upto = Window.partitionBy("_of_key").orderBy("_of", "_all").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_of_key", "_of", F.coalesce(F.sum("_size").over(upto), F.lit(0)).alias("_before"))
    placed = numbered.join(before, (F.col("_key") == F.col("_of_key")) & F.col("_group").eqNullSafe(F.col("_of")))
    row = F.floor((F.col("_before") + F.col("_nth") - 1) / F.lit(list_rows)).alias("_row")
    return placed.groupBy("_key", row).agg(entries).select(F.when(F.col("_key") != _NULL_KEY, F.col("_key")).alias(key), list_name)


def build_job_counts_by_country(postings: DataFrame, rows_per_key: int = 1, list_rows: int | None = None) -> DataFrame:
    """``search_country, data: array<struct<job_title, count>>``.

    One row a country of up to ``list_rows`` (default ``LIST_ROWS``)
    distinct titles, the file format the lookups read; more rows for larger
    ones.  ``rows_per_key > 1`` asks for so many rows a country instead.  The lookups merge rows of the same country, so they read either
    form.
    """
    return _nested(postings, "search_country", "data", rows_per_key, list_rows)


def build_job_counts_by_month(postings: DataFrame, rows_per_key: int = 1, list_rows: int | None = None) -> DataFrame:
    """``month_year, jobs: array<struct<job_title, count>>`` (R5); see R4 for
    ``rows_per_key`` and ``list_rows``."""
    return _nested(postings, "month_year", "jobs", rows_per_key, list_rows)
