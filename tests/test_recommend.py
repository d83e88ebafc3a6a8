"""Recommendation (Q2): D7-D10, ranking order, count consistency."""

import json

import pytest

from conftest import make_postings
from skillmesh.operators.recommend import filter_has_all_skills, recommend_titles
from skillmesh.sources.files import to_json_lines

ROWS = [
    ("Dev", "VN", "Python, SQL, Spark"),
    ("Dev", "vn", "python, sql,"),
    ("Dev", "VN", "PYTHON"),
    ("Dev", "VN", None),
    ("Ops", "VN", "python, bash, bash"),
    ("Ops", "VNX", "python, sql"),
    ("Data", "VN", " Python , sql , r , r "),
]


def test_subset_filter_case_and_nulls(spark):
    df = make_postings(spark, ROWS)
    got = sorted(r.job_title for r in filter_has_all_skills(df, "vn", [" PYTHON ", "sql"]).collect())
    assert got == ["Data", "Dev", "Dev"]


def test_blank_required_skills(spark):
    df = make_postings(spark, ROWS)
    with pytest.raises(ValueError):
        filter_has_all_skills(df, "vn", ["  ", ""])


def test_recommend_shape_and_order(spark):
    df = make_postings(spark, ROWS)
    got = [r.asDict(recursive=True) for r in recommend_titles(df, "VN", ["python"], top_skills=2).collect()]
    assert [g["job_title"] for g in got] == ["Dev", "Data", "Ops"]
    assert got[0]["count"] == 3
    assert got[0]["skills"] == [{"skill": "python", "weight": 3}, {"skill": "sql", "weight": 2}]
    # repeated skill in a posting counts twice; ties by name
    assert got[1]["skills"] == [{"skill": "r", "weight": 2}, {"skill": "python", "weight": 1}]
    assert got[2]["skills"] == [{"skill": "bash", "weight": 2}, {"skill": "python", "weight": 1}]


def test_recommend_counts_equal_plain_filter(spark, postings):
    rec = recommend_titles(postings, "NATION_3", ["small gear"], limit=100).collect()
    plain = filter_has_all_skills(postings, "NATION_3", ["small gear"]).groupBy("job_title").count().collect()
    assert sorted((r.job_title, r["count"]) for r in rec) == sorted((r.job_title, r["count"]) for r in plain)
    for r in rec:
        weights = [s.weight for s in r.skills]
        assert weights == sorted(weights, reverse=True)
        assert len(weights) <= 10


def test_json_rows(spark):
    df = make_postings(spark, ROWS)
    out = [json.loads(r.json) for r in to_json_lines(recommend_titles(df, "VN", ["sql"])).collect()]
    assert out[0] == {"job_title": "Dev", "skills": [{"skill": "python", "weight": 2}, {"skill": "sql", "weight": 2}, {"skill": "spark", "weight": 1}], "count": 2}
