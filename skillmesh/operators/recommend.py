"""Titles that fit a set of skills (Q2).

Plan: country equality filter and native subset test on the lower-cased
skill array (no Python UDF); one ``posexplode``; ``groupBy(title, skill)``
with map-side partial aggregation gives each pair's weight and, through the
position-0 marker, the postings that start with it; a second aggregate over
the same pairs sums these to the title's posting count.  The ``limit`` titles
with most postings are taken first, so only their skills are ranked: a
window numbers them, with a partial WindowGroupLimit below the shuffle by
title, so a task sends at most ``top_skills`` rows a title.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skillmesh.fixed import DEFAULT_RECOMMEND_LIMIT, DEFAULT_TOP_SKILLS
from skillmesh.functions.text import country_equals, has_all, skills_lower


def required_skills(skills) -> list[str]:
    """Distinct, stripped, non-blank required skills (lower-cased later, in Spark)."""
    if isinstance(skills, str):
        skills = [skills]
    req = sorted({s.strip() for s in skills if s is not None and s.strip()})
    if not req:
        raise ValueError("at least one non-blank skill is required")
    return req


def filter_has_all_skills(postings: DataFrame, country: str, skills) -> DataFrame:
    """Postings of ``country`` (any case) listing every required skill (F3, F4),
    with their lower-cased skill array as ``skills``."""
    req = [s.lower() for s in required_skills(skills)]
    return (
        postings.filter(country_equals(postings, country))
        .withColumn("skills", skills_lower("job_skills"))
        .filter(has_all("skills", req))
    )


def skill_weight_by_title(matched: DataFrame) -> DataFrame:
    """``job_title, skill, weight, starts`` from matched postings (A6);
    ``starts`` counts postings whose first token is the skill."""
    ex = matched.select("job_title", F.posexplode("skills").alias("pos", "skill"))
    return ex.groupBy("job_title", "skill").agg(
        F.count(F.lit(1)).alias("weight"),
        F.count(F.when(F.col("pos") == 0, 1)).alias("starts"),
    )


def top_skills_per_title(weights: DataFrame, top_skills: int = DEFAULT_TOP_SKILLS) -> DataFrame:
    """``job_title, count, rank, skill, weight`` keeping the ``top_skills``
    heaviest non-blank skills of each title (W1, F9, L6); ``count`` is the
    title's posting count (A5)."""
    counts = _counts_of(weights).withColumnRenamed("job_title", "counted_title")
    top = _ranked(weights, top_skills)
    return top.join(counts, F.col("job_title").eqNullSafe(F.col("counted_title"))).select(*_TOP)


_TOP = ["job_title", "count", "rank", "skill", "weight"]


def _counts_of(weights: DataFrame) -> DataFrame:
    return weights.groupBy("job_title").agg(F.sum("starts").cast("long").alias("count"))


def _ranked(weights: DataFrame, top_skills: int) -> DataFrame:
    """The heaviest non-blank skills of each title, numbered."""
    ranked = Window.partitionBy("job_title").orderBy(
        (F.col("skill") == "").asc(), F.desc("weight"), F.asc("skill")
    )
    return weights.withColumn("rank", F.row_number().over(ranked)).filter((F.col("rank") <= top_skills) & (F.col("skill") != ""))


def recommend_titles(
    postings: DataFrame,
    country: str,
    skills,
    top_skills: int = DEFAULT_TOP_SKILLS,
    limit: int = DEFAULT_RECOMMEND_LIMIT,
) -> DataFrame:
    """``job_title, skills: array<struct<skill, weight>>, count`` for the
    ``limit`` titles with most postings that list every skill in ``skills``."""
    matched = filter_has_all_skills(postings, country, skills)
    weights = skill_weight_by_title(matched)
    best = _counts_of(weights).orderBy(F.desc("count"), F.asc("job_title")).limit(limit)
    # One join both cuts the pairs to the best titles and carries each title's
    # count beside its pairs, so the best titles are computed once.
    named = best.withColumnRenamed("job_title", "best_title")
    of_best = weights.join(named, F.col("job_title").eqNullSafe(F.col("best_title")))
    ranked = _ranked(of_best, top_skills)
    nested = ranked.groupBy("job_title").agg(
        F.max("count").alias("count"),
        F.array_sort(F.collect_list(F.struct("rank", "skill", "weight"))).alias("ranked"),
    )
    return (
        nested.select(
            "job_title",
            F.transform(
                "ranked", lambda x: F.struct(x["skill"].alias("skill"), x["weight"].alias("weight"))
            ).alias("skills"),
            "count",
        )
        .orderBy(F.desc("count"), F.asc("job_title"))
        .limit(limit)
    )


def title_counts(matched: DataFrame) -> DataFrame:
    """``job_title, count`` of matched postings (A5)."""
    return matched.groupBy("job_title").agg(F.count(F.lit(1)).alias("count"))

