"""Sources and sinks (S1-S6): round trips through files in the checkpoint folder."""

from skillmesh import schemas
from skillmesh.session import scratch_path
from skillmesh.sources import files


def test_csv_round_trip_keeps_spaces_and_nulls(spark):
    rows = [("a", "X", "p, q, "), ("b", "Y", None), ("c", "Z", " r ")]
    df = spark.createDataFrame(rows, "job_title string, search_country string, job_skills string")
    path = scratch_path(spark, "t-csv")
    files.write_postings_csv(df, path)
    back = sorted(tuple(r) for r in files.read_postings(spark, path).collect())
    assert back == sorted(rows)


def test_read_postings_requires_columns(spark):
    df = spark.createDataFrame([("a",)], "job_title string")
    path = scratch_path(spark, "t-csv2")
    files.write_postings_csv(df, path)
    try:
        files.read_postings(spark, path)
    except ValueError as exc:
        assert "job_skills" in str(exc)
    else:
        raise AssertionError("expected ValueError")


def test_json_declared_schema_fills_missing(spark):
    path = scratch_path(spark, "t-json")
    spark.createDataFrame([('{"skill": "a"}',), ('{"skill": "b", "count": 3}',)], "value string").write.text(path)
    got = sorted(tuple(r) for r in files.read_counts(spark, path, schemas.SKILL_COUNTS).collect())
    assert got == [("a", None), ("b", 3)]


def test_tolerant_load(spark):
    path = scratch_path(spark, "t-tol")
    lines = ['{"skill": "a", "count": 1}', '{"skill": "b", "count": ', '{"search_country": "X", "data": null}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    got = sorted((tuple(r) for r in files.load_or_empty(spark, path, schemas.SKILL_COUNTS).collect()), key=str)
    assert got == [("a", 1), (None, None)]  # the truncated line is gone
    empty = files.load_or_empty(spark, path + "-missing", schemas.SKILL_COUNTS)
    assert empty.count() == 0 and empty.schema == schemas.SKILL_COUNTS


def test_nested_json_round_trip(spark):
    rows = [("X", [("a", 2), ("b", 1)]), ("Y", None)]
    df = spark.createDataFrame(rows, schemas.JOB_COUNTS_BY_COUNTRY)
    path = scratch_path(spark, "t-nest")
    files.write_json_lines(df, path)
    back = sorted((r.search_country, None if r.data is None else [tuple(j) for j in r.data])
                  for r in files.read_counts(spark, path, schemas.JOB_COUNTS_BY_COUNTRY).collect())
    assert back == [("X", [("a", 2), ("b", 1)]), ("Y", None)]


def test_json_rows_omit_nulls(spark):
    df = spark.createDataFrame([("a", None)], "skill string, count long")
    assert [r.json for r in files.to_json_lines(df).collect()] == ['{"skill":"a"}']


def test_persist_postings_keeps_three_columns(spark, postings):
    cached = files.persist_postings(postings)
    try:
        assert cached.columns == ["job_title", "search_country", "job_skills", "month_year"]
        assert cached.count() == postings.count()
        assert cached.storageLevel.useMemory and cached.storageLevel.useDisk
    finally:
        cached.unpersist()


def test_tolerant_load_keeps_the_same_rows_for_any_columns(spark, tmp_path):
    from skillmesh import schemas
    from skillmesh.sources import files

    flat = tmp_path / "flat.json"
    flat.write_text('{"skill":"a","count":1}\n{"skill":"b","count":"many"}\n{"skill":"c","cou\n\n{"skill":"d"}\n')
    df = files.load_or_empty(spark, str(flat), schemas.SKILL_COUNTS)
    assert df.count() == 2
    assert sorted(map(tuple, df.collect())) == [("a", 1), ("d", None)]
    assert sorted(r.skill for r in df.select("skill").collect()) == ["a", "d"]
    assert files.rejected_lines(spark, str(flat), schemas.SKILL_COUNTS).count() == 2
    nested = tmp_path / "nested.json"
    nested.write_text(
        '{"search_country":"x","data":[{"job_title":"p","count":1},{"job_title":"q","count":"bad"},{"job_title":"r","count":2}]}\n'
        '{"search_country":"y","data":[{"job_title":"s"}]}\n{"search_country":"z","data":7}\n{"search_country":"w"}\n'
    )
    df = files.load_or_empty(spark, str(nested), schemas.JOB_COUNTS_BY_COUNTRY)
    assert df.schema == schemas.JOB_COUNTS_BY_COUNTRY
    rows = {r.search_country: r.data and [tuple(x) for x in r.data] for r in df.collect()}
    assert rows == {"x": [("p", 1), ("r", 2)], "y": [("s", None)], "w": None}
    assert df.count() == 3 and df.select("search_country").count() == 3
    lost = files.rejected_lines(spark, str(nested), schemas.JOB_COUNTS_BY_COUNTRY).collect()
    assert sorted(r.elements_only for r in lost) == [False, True]


def test_country_keyed_table_answers_like_the_plain_one(spark, tmp_path):
    from skillmesh.functions.text import country_contains, country_equals
    from skillmesh.sources import files

    names = ["", None, "007", "7", "Vietnam", "VIETNAM", "a/b=c", "00"]
    plain = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "search_country string, n int")
    files.write_country_keyed(plain, str(tmp_path / "keyed"))
    keyed = files.read_country_keyed(spark, str(tmp_path / "keyed"))
    for value in ("", "007", "7", "vietnam", "A/B=C", "0", "="):
        for test in (country_equals, country_contains):
            got = [sorted(r.n for r in t.filter(test(t, value)).collect()) for t in (plain, keyed)]
            assert got[0] == got[1], (test.__name__, value, got)
    own = plain.withColumn("country_key", __import__("pyspark").sql.functions.lit("other"))
    assert own.filter(country_equals(own, "vietnam")).count() == 2


def test_readme_example_on_csv(spark, tmp_path):
    import skillmesh as sm
    from skillmesh.sources import files

    rows = [("Engineer", "Vietnam", "Python, SQL", "2024-01"), ("Engineer", "Vietnam", "Python", "2024-02"), ("Clerk", "Laos", "Excel", "2023-02")]
    df = spark.createDataFrame(rows, "job_title string, search_country string, job_skills string, month_year string")
    files.write_postings_csv(df, str(tmp_path / "postings"))
    postings = sm.read_postings(spark, str(tmp_path / "postings"))
    trend = sm.trend_by_year(sm.build_job_counts_by_month(postings), 2024)
    assert [tuple(r) for r in trend.collect()] == [("2024-01", "Engineer", 1), ("2024-02", "Engineer", 1)]
    kept = files.persist_postings(postings)
    assert "month_year" in kept.columns and kept.count() == 3
    kept.unpersist()
