"""Deep pages, chunked lists, one-pass answers, observed losses, packed matches."""

import math
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from conftest import SF_SMALL
from skillmesh import schemas
from skillmesh.functions import packing, paging
from skillmesh.functions.params import coerced_limits
from skillmesh.operators import lookups, recommend, reshape, rollups, titles
from skillmesh.plans import fixtures
from skillmesh.session import scratch_path
from skillmesh.sources import files


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


BOUNDS = [(0, 5), (95, 105), (0, None), (3, None), (-7, None), (-10, -3), (50, -45), (5, 5), (9, 2), (300, 310), (-300, 4), (0, -1)]


@pytest.mark.parametrize("top_rows", [0, 10_000])
def test_slices_equal_python_slices(spark, top_rows):
    values = [(i * 37 % 101, i) for i in range(101)]
    df, full = spark.createDataFrame(values, "v int, w int").repartition(4), sorted(values)
    for start, stop in BOUNDS:
        got = paging.slice_ordered(df, [F.asc("v"), F.asc("w")], start, stop, top_rows)
        assert [tuple(r) for r in got.collect()] == full[start:stop], (start, stop)


def test_deep_page_reads_its_own_partitions(spark):
    df = spark.range(10_000).select(F.col("id").alias("v"), F.concat(F.lit("x"), "id").alias("w"))
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")  # so small a table would be one partition
    try:
        table = paging.OrderedTable(df.repartition(8), [F.asc("v")])
    finally:
        spark.conf.unset(merging)
    assert table.total == 10_000 and len(table.parts) > 1
    page = table.slice(9_000, 9_010)
    read = [part for part, before, end in table.parts if before < 9_010 and end > 9_000]
    assert len(read) <= 2 and "_page_part" in plan(page) and [r.v for r in page.collect()] == list(range(9_000, 9_010))
    assert table.slice(-3, None).count() == 3 and paging.OrderedTable(df.limit(0), [F.asc("v")]).slice(-3, None).collect() == []


@pytest.mark.parametrize("limit,page", [(3, 1), (3, 2), (3, 9), (3, 40), (3, -1), (-2, 1), (None, 1), ("x", 1), (0, 3), (20_000, 1)])
def test_country_answer_is_page_and_total(spark, postings, limit, page):
    nested = rollups.build_job_counts_by_country(postings)
    full = [(r.job_title, r["count"]) for r in lookups.jobs_by_country_page(nested, "NATION_6").collect()]
    flat = [(r.job_title, r["count"]) for r in lookups.jobs_by_country_page(nested, "nation_6", limit, page).collect()]
    got = lookups.jobs_by_country(nested, "nation_6", limit, page).collect()
    assert len(got) == 1 and got[0].search_country == "NATION_6" and got[0].total_jobs == len(full)
    assert [(j.job_title, j["count"]) for j in got[0].data] == flat and got[0].showing == len(flat)


def test_country_answer_scans_the_nested_table_once(spark, postings):
    path = scratch_path(spark, "t-nested")
    rollups.build_job_counts_by_country(postings).write.parquet(path)
    assert plan(lookups.jobs_by_country(spark.read.parquet(path), "nation_6", 10, 2)).count("FileScan") == 1


@pytest.mark.parametrize("list_rows", [1, 4, 1000])
def test_lists_hold_at_most_their_rows(postings, list_rows):
    whole, cut = rollups.build_job_counts_by_country(postings), rollups.build_job_counts_by_country(postings, list_rows=list_rows)
    sizes = {r.search_country: sorted(x.n for x in r.ns) for r in cut.groupBy("search_country").agg(F.collect_list(F.struct(F.size("data").alias("n"))).alias("ns")).collect()}
    for r in whole.collect():
        n = len(r.data)
        assert sum(sizes[r.search_country]) == n and max(sizes[r.search_country]) <= list_rows and len(sizes[r.search_country]) == math.ceil(n / list_rows)
    flat = [sorted(map(tuple, reshape.unnest_job_counts(t).collect())) for t in (whole, cut)]
    assert flat[0] == flat[1]
    assert lookups.jobs_by_country(cut, "nation_6", 5).collect() == lookups.jobs_by_country(whole, "nation_6", 5).collect()


def test_nested_builder_reads_the_postings_once(spark, postings):
    path = scratch_path(spark, "t-once")
    postings.write.parquet(path)
    df = rollups.build_job_counts_by_country(spark.read.parquet(path))
    for nested in (df, df.select("search_country")):
        nested.collect()
        final = plan(nested).split("== Initial Plan ==")[0]
        assert final.count("FileScan") == 1 and "ReusedExchange" in final


def test_nested_lists_keep_null_keys_and_titles(spark):
    rows = [(None, "X"), ("a", None), ("a", None), ("a", "X"), (None, None)]
    df = spark.createDataFrame([(t, c, None, None) for c, t in rows], schemas.POSTINGS)
    got = {r.search_country: {(j.job_title, j["count"]) for j in r.data} for r in rollups.build_job_counts_by_country(df).collect()}
    assert got == {None: {("X", 1), (None, 1)}, "a": {("X", 1), (None, 2)}}


def test_best_titles_are_computed_once(postings):
    p = plan(recommend.recommend_titles(postings, "NATION_3", ["blue bolt"]))
    assert p.count("TakeOrderedAndProject") == 2  # the best titles, and the answer


def test_requests_equal_single_ones(spark, postings):
    counts = rollups.build_skill_counts_by_country(postings)
    asked = [(1, "nation_4", "3"), (2, "NATION_4", ""), (3, "nation_4", None), (4, "Nation_7", "many"), (5, "nowhere", "3"), (6, "nation_7", "-100"), (7, "nation_9", " 2"), (8, None, "1"), (9, "nation_7", "0")]
    got = lookups.skills_by_country_requests(counts, spark.createDataFrame(asked, "request_id int, country string, limit string")).collect()
    for i, country, limit in asked:
        want = [] if country is None else [tuple(r) for r in lookups.skills_by_country(counts, country, limit).collect()]
        assert [(r.skill, r["count"], r.search_country) for r in sorted(got, key=lambda r: r.rank) if r.request_id == i] == want, i


def test_limits_as_columns(spark):
    df = spark.createDataFrame([("5",), (" 7 ",), ("0",), ("",), (None,), ("ten",), ("-3",), ("1.5",)], "t string")
    assert [r[0] for r in df.select(coerced_limits("t")).collect()] == [5, 7, 0, None, None, 10, -3, 10]


def test_losses_are_counted_during_the_load(spark, tmp_path):
    lines = [
        '{"search_country": "a", "data": [{"job_title": "x", "count": 1}, {"job_title": "y", "count": "many"}, null, 5]}',
        '{"search_country": "b", "data": 7}',
        '{"search_country": "c"',
        "",
        '{"search_country": "d", "data": []}',
    ]
    (tmp_path / "in.json").write_text("\n".join(lines))
    losses = Observation("t-losses")
    got = files.load_or_empty(spark, str(tmp_path), schemas.JOB_COUNTS_BY_COUNTRY, losses)
    assert sorted((r.search_country, len(r.data)) for r in got.collect()) == [("a", 2), ("d", 0)]
    assert losses.get == {"lines": 4, "dropped_lines": 2, "dropped_elements": 2}
    assert files.rejected_lines(spark, str(tmp_path), schemas.JOB_COUNTS_BY_COUNTRY).count() == 3


def test_persisted_postings_are_read_from_memory(spark, postings):
    kept = files.persist_postings(postings)
    try:
        for df in (rollups.build_job_counts(kept), rollups.build_skill_counts(kept)):
            assert "InMemoryTableScan" in plan(df)
    finally:
        kept.unpersist()


def test_packed_matches_order_and_decode(spark):
    rng = random.Random(1)
    scores = [2.0, 1.0, 0.7, 0.7999999999999999, math.nextafter(2, 0), math.nextafter(1, 0), math.nextafter(1, 2), 2**-28, 3e-9]
    scores += [rng.random() * 2 for _ in range(500)] + [2 * a / b for a in range(3, 20) for b in range(a, 40)] + [0.5] * 4
    rows = [(s, rng.randrange(2**31), rng.randrange(2**31)) for s in scores[:-4]]
    rows += [(0.5, 0, 0), (0.5, 0, 2**31 - 1), (0.5, 2**31 - 1, 0), (0.5, 1, 0)]
    df = spark.createDataFrame(rows, "score double, prof_pos int, kw_pos int").withColumn("kid", packing.keyword_id())
    df = df.withColumn("code", packing.match_code("score", "kid"))
    got = df.withColumn("kid_back", packing.kid_of("code")).withColumn("score_back", packing.score_of("code")).collect()
    assert all(r.score == r.score_back and r.kid == r.kid_back for r in got)
    assert sorted(got, key=lambda r: r.code) == sorted(got, key=lambda r: (r.score, -r.prof_pos, -r.kw_pos))


@pytest.mark.parametrize("small", [True, False])
def test_pairs_are_scored_once(spark, small):
    keywords = titles.merge_keywords(*fixtures.part_dictionary(spark, SF_SMALL))
    prepared = titles.prepare_keywords(keywords)
    cleaned = titles.clean_titles(fixtures.two_language_titles(spark, SF_SMALL))
    pairs = titles.candidate_pairs(cleaned, prepared, small).select("T", "kid")
    total = pairs.count()
    probes = titles.ranked_keys(prepared).select("kid", F.explode("KK").alias("key"))
    keys = titles._with_keys(cleaned.select(F.col("clean_title").alias("T")).distinct()).select("T", F.explode("TK").alias("key"))
    met = keys.join(probes, "key").select("T", "kid")
    assert total == pairs.distinct().count() == met.distinct().count() and met.count() > 1.5 * total


def test_title_plans_have_no_sort_aggregate(spark):
    keywords = titles.merge_keywords(*fixtures.part_dictionary(spark, SF_SMALL))
    rows = fixtures.two_language_titles(spark, SF_SMALL)
    for df in (
        titles.normalize_titles(rows, keywords),
        titles.normalize_titles(rows, keywords, language="english", threshold=0.5),
        titles.profession_of_title(rows, keywords),
        titles.best_match_of("small ring", keywords),
    ):
        assert "SortAggregate" not in plan(df)


@pytest.mark.parametrize("limit,page", [(2, 1), (1, -1), (None, 1), (20_000, 1)])
def test_country_answer_merges_spellings(spark, limit, page):
    rows = [("abc", [("x", 2), ("y", 1)]), ("ABC", [("x", 1), ("z", 9), (None, 1)]), ("Abc", [("z", 1)]), ("AAA", [("x", 5)]), ("ABc", []), ("ABC", None)]
    nested = spark.createDataFrame(rows, "search_country string, data array<struct<job_title string, count bigint>>")
    full = [("z", 10), ("x", 3), ("", 1), ("y", 1)]
    got = lookups.jobs_by_country(nested, "aBc", limit, page).collect()
    assert len(got) == 1 and (got[0].search_country, got[0].total_jobs) == ("ABC", 4)
    start, stop = (0, None) if limit is None else ((page - 1) * limit, page * limit)
    assert [tuple(j) for j in got[0].data] == full[start:stop]
    p = plan(lookups._titles_and_names(nested, "abc"))
    assert "HashAggregate" in p and "ObjectHashAggregate" not in p and "SortAggregate" not in p


def test_list_order_is_native(spark):
    df = spark.createDataFrame([([("b", 1), ("a", 1), ("c", 7), ("d", None)],), (None,), ([],)], "l array<struct<job_title string, count bigint>>")
    sorted_ = df.select(rollups.sort_job_list("l").alias("l"))
    assert "if (" not in plan(sorted_) and "CASE WHEN" not in plan(sorted_)
    got = [r.l and [tuple(j) for j in r.l if j["count"] is not None] for r in sorted_.collect()]
    assert got == [[("c", 7), ("a", 1), ("b", 1)], None, []] and sorted_.schema["l"].dataType.elementType.names == ["job_title", "count"]
