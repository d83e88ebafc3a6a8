"""Lookups over the summary tables (Q3-Q8).

All of them are filters and sorts on DataFrames; ``orderBy().limit()`` runs
as a distributed top-k (TakeOrderedAndProject); deep pages and those counted
from the end read their own partitions of a range-partitioned order
(``functions/paging.py``).  Ties are broken by the name column so results are
deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillmesh.fixed import DEFAULT_LOOKUP_LIMIT
from skillmesh.functions import paging
from skillmesh.functions.paging import slice_ordered
from skillmesh.functions.params import coerce_limit, coerced_limits
from skillmesh.functions.text import contains_ci, country_equals, not_blank, year_of
from skillmesh.operators.reshape import unnest_job_counts
from skillmesh.operators.rollups import sort_job_list


#: Groups in which a country's titles are ranked and counted before they meet.
SALTS = 64


def _by_count(name: str) -> list[Column]:
    return [F.desc("count"), F.asc(name)]


def global_skills(skill_counts: DataFrame, limit=None) -> DataFrame:
    """``skill, count`` by count desc (Q3); ``limit`` false → all rows,
    non-numbers → 10."""
    return slice_ordered(skill_counts.select("skill", "count"), _by_count("skill"), 0, coerce_limit(limit))


def skills_by_country(skill_counts_by_country: DataFrame, country: str, limit=None) -> DataFrame:
    """``skill, count, search_country`` of one country, any case (Q4)."""
    own = skill_counts_by_country.filter(country_equals(skill_counts_by_country, country))
    return slice_ordered(own.select("skill", "count", "search_country"), _by_count("skill"), 0, coerce_limit(limit))


def skills_by_country_requests(skill_counts_by_country: DataFrame, requests: DataFrame) -> DataFrame:
    """``request_id, rank, skill, count, search_country`` for many requests
    (``request_id, country, limit`` as texts) at once: Q4 with each request's own limit.

    Requests of one country (any case) share its ranking, which is cut to the
    largest limit asked of the country; a limit below zero counts from the end, as in a slice.
    """
    asked = requests.select("request_id", F.lower("country").alias("asked"), coerced_limits("limit").alias("most"))
    bound = F.when(F.min(F.coalesce("most", F.lit(-1))) < 0, F.lit(None)).otherwise(F.max("most"))
    wanted = asked.groupBy("asked").agg(bound.alias("bound"))
    counts = skill_counts_by_country.join(wanted, F.lower("search_country") == F.col("asked"))
    own = Window.partitionBy("asked")
    ranked = counts.withColumn("rank", F.row_number().over(own.orderBy(F.desc("count"), F.asc("skill"), "search_country")))
    ranked = ranked.withColumn("total", F.count(F.lit(1)).over(own)).where(F.col("bound").isNull() | (F.col("rank") <= F.col("bound")))
    last = F.when(F.col("most") < 0, F.col("total") + F.col("most")).otherwise(F.col("most"))
    found = asked.join(ranked.drop("bound"), "asked").where(F.col("most").isNull() | (F.col("rank") <= last))
    return found.select("request_id", "rank", "skill", "count", "search_country")


def _country_titles(job_counts_by_country: DataFrame, country: str) -> DataFrame:
    """Merged title counts of every row whose country equals ``country``."""
    rows = job_counts_by_country.filter(country_equals(job_counts_by_country, country))
    flat = unnest_job_counts(rows)
    # array_min(collect_set(..)) instead of min(..): a string min would force
    # a sort-based aggregate; the set holds only spellings of one country.
    return flat.groupBy("job_title").agg(
        F.sum("count").cast("long").alias("count"),
        F.array_min(F.collect_set("search_country")).alias("search_country"),
    )


def jobs_by_country_page(job_counts_by_country: DataFrame, country: str, limit=None, page=1) -> DataFrame:
    """Flat page of a country's titles: ``search_country, job_title, count``
    sorted by count desc, title; rows ``(page-1)*limit .. +limit`` (L4).

    ``limit`` false → every title; ``limit`` or ``page`` not a number → the
    first 10 titles; an empty country → no rows.
    """
    titles = _country_titles(job_counts_by_country, country or "").select("search_country", "job_title", "count")
    if not country:
        return titles.limit(0)
    return slice_ordered(titles, _by_count("job_title"), *_page_bounds(limit, page))


def _page_bounds(limit, page) -> tuple[int, int | None]:
    """Bounds of a page as of a Python slice."""
    if not limit:
        return 0, None
    try:
        limit, page = int(limit), int(page)
    except (TypeError, ValueError):
        return 0, DEFAULT_LOOKUP_LIMIT
    start = (page - 1) * limit
    return start, start + limit


def _titles_and_names(job_counts_by_country: DataFrame, country: str) -> DataFrame:
    """Merged title counts of the country (``name`` NULL), and a row of each spelling of it (``name``).

    Each row of the nested table adds an entry for its spelling, so that one
    aggregate of a number gives both: a text as aggregate value would sort all titles.
    """
    rows = job_counts_by_country.filter(country_equals(job_counts_by_country, country))
    entry = F.transform("data", lambda j: F.struct(j["job_title"].alias("job_title"), j["count"].alias("count"), F.lit(None).cast("string").alias("name")))
    spelling = F.struct(F.lit("").alias("job_title"), F.lit(0).cast("bigint").alias("count"), F.col("search_country").alias("name"))
    held = F.when(F.size("data") > 0, F.concat(entry, F.array(spelling)))
    flat = unnest_job_counts(rows.select("search_country", held.alias("data")), with_name=True)
    return flat.groupBy("job_title", "name").agg(F.sum("count").cast("long").alias("count"))


def jobs_by_country(job_counts_by_country: DataFrame, country: str, limit=None, page=1) -> DataFrame:
    """``search_country, data, total_jobs, showing`` (Q5): ``data`` is the page
    of titles, ``total_jobs`` the number of titles before paging and
    ``showing`` after.  No row when the country is absent, empty or None.

    One pass over the nested table gives both: the country's titles are counted and ranked in
    ``SALTS`` groups, each of which sends its count and its first rows up to
    the end of the page.  A deep page comes from the ordered table, whose partition counts
    are the total.  Without a limit the list is the whole country, as asked.
    """
    titles = _titles_and_names(job_counts_by_country, country or "")
    start, stop = _page_bounds(limit, page)
    title = F.col("name").isNull()
    if not country:
        titles = titles.limit(0)
    elif stop is not None and not paging.is_shallow(start, stop):
        # Spellings come after the titles.
        table = paging.OrderedTable(titles, [F.asc_nulls_first("name"), *_by_count("job_title")])
        names = table.rows.where(~title).agg(F.array_min(F.collect_set("name")).alias("search_country"), F.count(F.lit(1)).alias("n")).first()
        total = table.total - names.n
        start, stop, _ = slice(start, stop).indices(total)
        shown = table.slice(start, stop).agg(sort_job_list(F.collect_list(F.struct("job_title", "count"))).alias("data"))
        name = F.lit(names.search_country).cast("string").alias("search_country")
        return _country_answer(shown.select(name, "data", F.lit(total).cast("bigint").alias("total_jobs")))
    group = Window.partitionBy("salt")
    salted = titles.withColumn("salt", F.when(title, F.pmod(F.xxhash64("job_title"), F.lit(SALTS))))
    salted = salted.withColumn("n", F.count(F.lit(1)).over(group))
    ranked = salted.withColumn("rank", F.row_number().over(group.orderBy(*_by_count("job_title"))))
    if stop is not None:
        ranked = ranked.where((F.col("rank") <= max(stop, 1)) | ~title)
    found = ranked.agg(
        F.array_min(F.collect_set("name")).alias("search_country"),
        F.coalesce(F.sum(F.when(title & (F.col("rank") == 1), F.col("n"))), F.lit(0)).alias("total_jobs"),
        sort_job_list(F.collect_list(F.when(title, F.struct("job_title", "count")))).alias("data"),
    )
    if stop is not None:
        found = found.withColumn("data", F.slice("data", start + 1, max(stop - start, 0)))
    return _country_answer(found)


def _country_answer(found: DataFrame) -> DataFrame:
    return found.where("total_jobs > 0").select("search_country", "data", "total_jobs", F.size("data").cast("long").alias("showing"))


def trend_by_year(job_counts_by_month: DataFrame, year) -> DataFrame:
    """Flat ``month_year, job_title, count`` of the months of ``year``, by
    month, count desc and title (Q6)."""
    months = job_counts_by_month.filter(year_of("month_year") == F.lit(str(year)))
    return unnest_job_counts(months, "month_year", "jobs").orderBy("month_year", F.desc("count"), "job_title")


def trend_by_year_nested(job_counts_by_month: DataFrame, year) -> DataFrame:
    """``month_year, jobs`` with each list sorted by count desc, title.

    Rows of one month are merged; a missing title is ``''`` and a missing
    count 0 (P5), before the sort.
    """
    months = job_counts_by_month.filter(
        F.col("month_year").isNotNull()
        & F.col("jobs").isNotNull()
        & (year_of("month_year") == F.lit(str(year)))
    )
    filled = F.transform(
        "jobs",
        lambda j: F.struct(
            F.coalesce(j["job_title"], F.lit("")).alias("job_title"),
            F.coalesce(j["count"], F.lit(0)).cast("long").alias("count"),
        ),
    )
    merged = months.groupBy("month_year").agg(F.flatten(F.collect_list(filled)).alias("jobs"))
    return merged.select("month_year", sort_job_list("jobs").alias("jobs")).orderBy("month_year")


def list_countries(job_counts_by_country: DataFrame) -> DataFrame:
    """Distinct non-empty countries of the nested country table (Q7)."""
    return (
        job_counts_by_country.filter(F.col("data").isNotNull() & not_blank("search_country"))
        .select("search_country")
        .distinct()
        .orderBy("search_country")
    )


def search_skills(skill_counts: DataFrame, needle: str = "") -> DataFrame:
    """Skill names containing ``needle`` (any case), most frequent first (Q8)."""
    return (
        skill_counts.filter(contains_ci("skill", needle or ""))
        .orderBy(F.desc("count"), F.asc("skill"))
        .select("skill")
    )
