"""Physical-plan assertions: the shapes the design depends on."""

import pytest

from conftest import SF_SMALL
from skillmesh.operators.profile import skill_profile
from skillmesh.operators.recommend import recommend_titles
from skillmesh.operators.titles import normalize_titles
from skillmesh.plans import fixtures
from skillmesh.session import scratch_path
from skillmesh.sources import files


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "MapInArrow", "PythonUDF")
#: The numbered operators (and the pipeline of some) may run Python workers; these may not.
NATIVE = ("op9_url_filter", "op10_quality_rules")


def _registered():
    import __spark_entry__ as entry

    return sorted(entry.queries().items())


@pytest.mark.parametrize("key,fn", _registered())
def test_no_python_or_cross_join_in_registered_plans(spark, key, fn):
    p = plan(fn(spark, SF_SMALL))
    numbered = key == "pipeline" or key.startswith("op")
    assert (numbered and key not in NATIVE) or not any(n in p for n in PYTHON_NODES), key
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p, key


def test_profile_uses_distributed_top_k(spark, postings):
    p = plan(skill_profile(postings, "household", "nation_1", 15))
    assert "TakeOrderedAndProject" in p
    assert "BroadcastHashJoin" in p  # the k-row side of the tagging join


def test_recommend_limits_rows_per_title_before_sorting(spark, postings):
    p = plan(recommend_titles(postings, "NATION_3", ["blue bolt"]))
    assert "WindowGroupLimit" in p
    assert "TakeOrderedAndProject" in p


def test_country_keyed_table_prunes_partitions(spark, postings):
    path = scratch_path(spark, "t-keyed")
    files.write_country_keyed(postings, path)
    table = files.read_country_keyed(spark, path)
    rec = recommend_titles(table, "nation_3", ["blue bolt"])
    p = rec._jdf.queryExecution().sparkPlan().toString()
    assert "PartitionFilters: [isnotnull(skillmesh_country_key" in p and "nation_3" in p
    direct = recommend_titles(postings, "NATION_3", ["blue bolt"])
    assert [r.asDict(recursive=True) for r in rec.collect()] == [r.asDict(recursive=True) for r in direct.collect()]
    prof = skill_profile(table, "household", "NATION_1", 5)
    assert "Contains(substr(skillmesh_country_key#" in prof._jdf.queryExecution().sparkPlan().toString()
    assert prof.collect() == skill_profile(postings, "household", "NATION_1", 5).collect()


def test_parquet_postings_scan_reads_only_needed_columns(spark, postings):
    path = scratch_path(spark, "t-pq")
    postings.write.parquet(path)
    df = files.read_postings(spark, path, fmt="parquet")
    p = plan(skill_profile(df, "household", "nation_1", 5))
    assert "ReadSchema: struct<job_title:string,search_country:string,job_skills:string>" in p


def test_title_join_back_does_not_shuffle_input(spark):
    from skillmesh.operators.titles import normalize_titles
    from skillmesh.plans import fixtures

    def first_join(df):
        lines = plan(df).split("\n")
        i = next(i for i, line in enumerate(lines) if "Join" in line)
        return lines, i

    titles = fixtures.raw_titles(spark, SF_SMALL)
    lines, i = first_join(normalize_titles(titles, fixtures.test_taxonomy(spark)))
    assert "BroadcastHashJoin" in lines[i]
    # the streamed (input) side, up to the broadcast side, reads the file directly
    end = next(j for j in range(i + 1, len(lines)) if "BroadcastExchange" in lines[j])
    assert not any("Exchange" in line for line in lines[i + 1 : end])
    # above the bound the join-back is a shuffle join
    lines, i = first_join(normalize_titles(titles, fixtures.test_taxonomy(spark), broadcast_max_titles=10))
    assert "SortMergeJoin" in lines[i] or "ShuffledHashJoin" in lines[i]


@pytest.mark.parametrize("which", ["rows", "summary"])
def test_profile_computes_skill_aggregate_once(spark, postings, which):
    from skillmesh.operators.profile import profile_summary

    fn = skill_profile if which == "rows" else profile_summary
    df = fn(postings, "household", "nation_1", 5)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # the token explosion (and the aggregate above it) appears once: both
    # branches read one shuffle stage
    assert final.count("posexplode") == 1


def test_read_postings_keeps_partition_key(spark, postings):
    path = scratch_path(spark, "t-keyed-read")
    files.write_country_keyed(postings, path)
    df = files.read_postings(spark, path, fmt="parquet")
    assert "skillmesh_country_key" in df.columns
    rec = recommend_titles(df, "nation_3", ["blue bolt"])
    assert "PartitionFilters: [isnotnull(skillmesh_country_key" in rec._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("language", ["both", "vietnamese"])
def test_titles_are_cleaned_after_the_distinct(spark, language):
    titles = fixtures.raw_titles(spark, SF_SMALL)
    lines = plan(normalize_titles(titles, fixtures.test_taxonomy(spark), language=language)).splitlines()
    cleaning = [line for line in lines if "regexp_replace(" in line]
    assert any("_title" in line for line in cleaning)
    assert not any("p_name" in line for line in cleaning)  # an input row's own columns
    assert not any("Filter" in line and "_title" in line and "regexp_replace(" in line for line in lines)
