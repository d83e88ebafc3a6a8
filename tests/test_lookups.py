"""Lookups (Q3-Q8), rollups (R1-R5) and reshaping."""

import pytest
from pyspark.sql import functions as F

from skillmesh import schemas
from skillmesh.operators import lookups, reshape, rollups


@pytest.fixture(scope="module")
def summaries(postings):
    return {
        "sc": rollups.build_skill_counts(postings).cache(),
        "scc": rollups.build_skill_counts_by_country(postings).cache(),
        "jcc": rollups.build_job_counts_by_country(postings).cache(),
        "jcm": rollups.build_job_counts_by_month(postings).cache(),
    }


def test_r1_equals_r2_summed(summaries):
    a = sorted(tuple(r) for r in summaries["sc"].collect())
    b = sorted(tuple(r) for r in summaries["scc"].groupBy("skill").agg(F.sum("count").cast("long")).collect())
    assert a == b


def test_nest_unnest_round_trip(postings, summaries):
    flat = sorted(tuple(r) for r in reshape.unnest_job_counts(summaries["jcc"]).collect())
    direct = sorted(tuple(r) for r in postings.groupBy("search_country", "job_title").count().collect())
    assert flat == direct


def test_nested_lists_sorted(summaries):
    for r in summaries["jcm"].collect():
        keys = [(-j["count"], j["job_title"]) for j in r.jobs]
        assert keys == sorted(keys)


def _all(df):
    return [tuple(r) for r in df.collect()]


def test_limit_semantics(summaries):
    full = _all(lookups.global_skills(summaries["sc"]))
    assert len(full) == summaries["sc"].count()
    assert _all(lookups.global_skills(summaries["sc"], 0)) == full  # false → all
    assert _all(lookups.global_skills(summaries["sc"], 5)) == full[:5]
    assert _all(lookups.global_skills(summaries["sc"], "abc")) == full[:10]
    assert _all(lookups.global_skills(summaries["sc"], -3)) == full[:-3]
    assert _all(lookups.global_skills(summaries["sc"], 10_000)) == full


def test_pages_concatenate_to_full_list(summaries):
    full = _all(lookups.jobs_by_country_page(summaries["jcc"], "nation_6"))
    pages = []
    for p in range(1, 6):
        pages += _all(lookups.jobs_by_country_page(summaries["jcc"], "NATION_6", 6, p))
    assert pages == full
    assert _all(lookups.jobs_by_country_page(summaries["jcc"], "NATION_6", 6, 99)) == []


def test_jobs_by_country_counts(postings, summaries):
    titles = postings.filter("search_country = 'NATION_6'").select("job_title").distinct().count()
    r = lookups.jobs_by_country(summaries["jcc"], "nation_6", 4, 2).collect()[0]
    assert r.total_jobs == titles and r.showing == 4 and len(r.data) == 4
    assert lookups.jobs_by_country(summaries["jcc"], "atlantis", 4).count() == 0


def test_duplicate_country_rows_merge(spark):
    rows = [("X", [("a", 2), ("b", 1)]), ("x", [("a", 1)]), ("X", None)]
    df = spark.createDataFrame(rows, schemas.JOB_COUNTS_BY_COUNTRY)
    got = _all(lookups.jobs_by_country_page(df, "x"))
    assert got == [("X", "a", 3), ("X", "b", 1)]
    assert [r.search_country for r in lookups.list_countries(df).collect()] == ["X", "x"]


def test_trend_by_year(spark):
    rows = [("2024-05", [("a", 1), ("b", 3)]), (None, [("c", 1)]), ("2024-06", None), ("2023-01", [("d", 1)])]
    df = spark.createDataFrame(rows, schemas.JOB_COUNTS_BY_MONTH)
    got = lookups.trend_by_year_nested(df, 2024).collect()
    assert [(r.month_year, [j.job_title for j in r.jobs]) for r in got] == [("2024-05", ["b", "a"])]
    assert sorted(_all(lookups.trend_by_year(df, "2024"))) == [("2024-05", "a", 1), ("2024-05", "b", 3)]


def test_missing_struct_fields_default(spark):
    rows = [("X", [(None, None), ("a", 2)])]
    df = spark.createDataFrame(rows, schemas.JOB_COUNTS_BY_COUNTRY)
    assert sorted(_all(reshape.unnest_job_counts(df))) == [("X", "", 0), ("X", "a", 2)]


def test_search_skills(summaries):
    got = [r.skill for r in lookups.search_skills(summaries["sc"], "RIN").collect()]
    assert got and all("rin" in s.lower() for s in got)
    assert len([r for r in lookups.search_skills(summaries["sc"]).collect()]) == summaries["sc"].count()


def test_skills_by_country_case(summaries):
    a = _all(lookups.skills_by_country(summaries["scc"], "nation_4", 10))
    b = _all(lookups.skills_by_country(summaries["scc"], "NATION_4", 10))
    assert a == b and len(a) == 10


def test_split_nested_rows_give_same_lookups(postings, summaries):
    split = rollups.build_job_counts_by_country(postings, rows_per_key=4)
    assert split.count() > summaries["jcc"].count()
    assert _all(lookups.jobs_by_country_page(split, "NATION_6", 5, 2)) == _all(
        lookups.jobs_by_country_page(summaries["jcc"], "NATION_6", 5, 2)
    )
    a = lookups.jobs_by_country(split, "nation_6", 4, 1).collect()[0]
    b = lookups.jobs_by_country(summaries["jcc"], "nation_6", 4, 1).collect()[0]
    assert a == b
    assert _all(lookups.list_countries(split)) == _all(lookups.list_countries(summaries["jcc"]))


def test_page_argument_fallbacks(summaries):
    full = _all(lookups.jobs_by_country_page(summaries["jcc"], "NATION_6"))
    assert _all(lookups.jobs_by_country_page(summaries["jcc"], "NATION_6", "abc", 3)) == full[:10]
    assert _all(lookups.jobs_by_country_page(summaries["jcc"], "NATION_6", 3, "x")) == full[:10]
    assert _all(lookups.jobs_by_country_page(summaries["jcc"], "NATION_6", "4", "2")) == full[4:8]
    assert _all(lookups.jobs_by_country_page(summaries["jcc"], "", 5)) == []
    assert lookups.jobs_by_country(summaries["jcc"], "", 5).count() == 0
    # negative page counts from the end, as Python slicing does
    assert _all(lookups.jobs_by_country_page(summaries["jcc"], "NATION_6", 3, 0)) == full[-3:0]
    assert _all(lookups.jobs_by_country_page(summaries["jcc"], "NATION_6", 3, -1)) == full[-6:-3]


def test_country_keyed_summaries_prune_and_agree(spark, summaries):
    from skillmesh.session import scratch_path
    from skillmesh.sources import files

    p1, p2 = scratch_path(spark, "t-scc"), scratch_path(spark, "t-jcc")
    files.write_country_keyed(summaries["scc"], p1)
    files.write_country_keyed(summaries["jcc"], p2)
    scc, jcc = files.read_country_keyed(spark, p1), files.read_country_keyed(spark, p2)
    q = lookups.skills_by_country(scc, "Nation_4", 10)
    assert "PartitionFilters: [isnotnull(skillmesh_country_key" in q._jdf.queryExecution().sparkPlan().toString()
    assert _all(q) == _all(lookups.skills_by_country(summaries["scc"], "nation_4", 10))
    assert _all(lookups.jobs_by_country_page(jcc, "NATION_6", 5, 2)) == _all(
        lookups.jobs_by_country_page(summaries["jcc"], "NATION_6", 5, 2)
    )


def test_trend_merges_split_months_and_fills_before_sorting(spark):
    from skillmesh import schemas

    rows = [("2024-01", [("a", 1), ("n", None)]), ("2024-01", [("z", 5), (None, 2)]), ("2024-02", []), ("2023-01", [("x", 1)])]
    df = spark.createDataFrame(rows, schemas.JOB_COUNTS_BY_MONTH)
    got = [(r.month_year, [tuple(j) for j in r.jobs]) for r in lookups.trend_by_year_nested(df, 2024).collect()]
    assert got == [("2024-01", [("z", 5), ("", 2), ("a", 1), ("n", 0)]), ("2024-02", [])]
    flat = [tuple(r) for r in lookups.trend_by_year(df, 2024).collect()]
    assert flat == [("2024-01", "z", 5), ("2024-01", "", 2), ("2024-01", "a", 1), ("2024-01", "n", 0)]


def test_no_country_gives_no_row(spark):
    from skillmesh import schemas

    df = spark.createDataFrame([("", [("a", 1)]), (None, [("b", 2)])], schemas.JOB_COUNTS_BY_COUNTRY)
    for country in (None, ""):
        assert lookups.jobs_by_country(df, country).collect() == []
