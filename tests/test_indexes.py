"""Indexes against the plain predicates, and what their plans read."""

import pytest

from conftest import make_postings
from skillmesh.operators import skill_index, title_index
from skillmesh.operators.profile import matched_postings
from skillmesh.operators.recommend import filter_has_all_skills
from skillmesh.session import scratch_path

ROWS = [
    ("Data Engineer", "Vietnam", "Python, SQL,  Spark"),
    ("data engineer II", "vietnam", "sql, python"),
    ("Chef", "VIETNAM", "Python"),
    ("Đầu Bếp", "Laos", "python , SQL, sql,"),
    (None, "Laos", "SQL, Python, cooking"),
    ("Baker", None, "SQL, Python"),
    ("Baker", "Laos", None),
    ("", "Laos", ""),
    ("Data Engineer", "Vietnam", "Python, SQL,  Spark"),
]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def some(spark):
    return make_postings(spark, ROWS).repartition(3)


@pytest.fixture(scope="module")
def skills_path(spark, some):
    path = scratch_path(spark, "t-skill-index")
    skill_index.write_skill_index(some, path)
    return path


@pytest.fixture(scope="module")
def titles_path(spark, some):
    path = scratch_path(spark, "t-title-index")
    title_index.write_title_index(some, path, parts=4)
    return path


@pytest.mark.parametrize("skills", [["sql"], ["SQL", " python "], ["python", "sql", "spark"], ["cooking", "sql"], ["nothing"], ["sql", "nothing"]])
@pytest.mark.parametrize("country", ["laos", "Vietnam", "nowhere"])
def test_indexed_skills_equal_the_scan(spark, some, skills_path, skills, country):
    got = skill_index.postings_with_all_skills(spark, skills_path, skills, country)
    want = filter_has_all_skills(some, country, skills)
    assert got.columns == want.columns and rows(got) == rows(want)


def test_indexed_skills_of_all_countries(spark, skills_path):
    assert skill_index.postings_with_all_skills(spark, skills_path, ["SQL", "python"]).count() == 6


def test_skill_request_reads_its_own_lists(spark, skills_path):
    p = plan(skill_index.matching_rows(spark, skills_path, ["sql", "spark"]))
    scans = [line for line in p.split("\n") if "FileScan" in line]
    assert len(scans) == 2
    for line in scans:
        assert "PartitionFilters: [isnotnull(bucket" in line and "EqualTo(skill," in line
    assert "EqualTo(skill,spark)" in scans[0] and "EqualTo(skill,sql)" in scans[1]  # the rarer one first


def test_lists_stay_inside_a_chunk(spark, some, monkeypatch):
    monkeypatch.setattr(skill_index, "CHUNK_BITS", 1)
    path = scratch_path(spark, "t-chunks")
    skill_index.write_skill_index(some.coalesce(1), path)
    lists = spark.read.parquet(f"{path}/lists")
    assert lists.selectExpr("max(size(places))").first()[0] <= 2
    assert rows(skill_index.postings_with_all_skills(spark, path, ["sql", "python"], "Laos")) == rows(filter_has_all_skills(some, "Laos", ["sql", "python"]))


def test_skill_index_of_an_empty_table(spark, some):
    path = scratch_path(spark, "t-none")
    skill_index.write_skill_index(some.where("false"), path)
    assert skill_index.postings_with_all_skills(spark, path, ["sql"]).collect() == []


def test_skill_index_needs_a_skill(spark, skills_path):
    with pytest.raises(ValueError):
        skill_index.postings_with_all_skills(spark, skills_path, [" "])


@pytest.mark.parametrize("needle", ["data engineer", "ENGINEER", "a", "", "bếp", "Đầu", "ii", "engineers", "zzz"])
@pytest.mark.parametrize("country", ["", "viet", "LAO"])
def test_indexed_titles_equal_the_scan(some, titles_path, needle, country):
    got, want = title_index.matched_postings_indexed(some, titles_path, needle, country), matched_postings(some, needle, country)
    assert got.columns == want.columns and rows(got) == rows(want)


def test_title_test_runs_on_distinct_titles_only(spark, some, titles_path):
    assert spark.read.parquet(f"{titles_path}/titles").count() == len({t for t, *_ in ROWS if t is not None})
    p = plan(title_index.matched_postings_indexed(some, titles_path, "engineer", ""))
    assert "Contains(folded#" in p and "lower(job_title" not in p
    assert "LeftSemi" in p


def test_title_index_of_an_empty_table(spark, some):
    path = scratch_path(spark, "t-no-titles")
    title_index.write_title_index(some.where("false"), path)
    assert title_index.titles_containing(spark, path, "data").collect() == []
    assert title_index.titles_containing(spark, path, "").collect() == []
