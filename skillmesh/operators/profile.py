"""Skill profile of a job title in a country (Q1) and its summary.

Plan, for one (title, country) pair:

1. filter postings on case-insensitive title and country substrings;
2. explode the skill string once, trimming tokens; blank tokens stay as a
   NULL-key group only to count postings;
3. ``groupBy(skill)`` with map-side partial aggregation: frequency of each
   skill and the number of postings whose first token fell in the group;
4. top ``k`` skills by ``frequency desc, skill`` (a distributed
   TakeOrderedAndProject, ``k`` rows reach one task), numbered 1..k;
5. every skill row is tagged top / other / blank by a join against those
   ``k`` rows (broadcast when ``k`` is small) and folded by one global
   aggregate (partial per partition) into a single row: totals plus the
   list of the ``k`` top skills;
6. shares, the "Other Skills" residual and the sum-to-100 correction are
   computed on that row with higher-order functions, in the original's
   double arithmetic and Python-style rounding (see ``functions.shares``);
   ``inline`` turns the list back into rows.

No step gathers more than ``k + 1`` entries into a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillmesh.fixed import DEFAULT_PROFILE_LIMIT
from skillmesh.functions import shares
from skillmesh.functions.params import strict_int
from skillmesh.functions.text import OTHER_SKILLS_LABEL, contains_ci, country_contains, split_skills

# Broadcast the top-k side of the tagging join up to this many rows; past
# it the planner's own choice (sort-merge) is used.
TOPK_BROADCAST_ROWS = 100_000


def matched_postings(postings: DataFrame, title: str, country: str) -> DataFrame:
    """Postings whose title and country contain the needles, any case (F1, F2)."""
    return postings.filter(contains_ci("job_title", title) & country_contains(postings, country))


def skill_frequency(postings: DataFrame, title: str, country: str) -> DataFrame:
    """``skill, frequency`` for the matched postings."""
    return _frequency(matched_postings(postings, title, country)).filter(F.col("skill").isNotNull()).select(
        "skill", "frequency"
    )


def _frequency(matched: DataFrame) -> DataFrame:
    tokens = matched.select(F.posexplode_outer(split_skills("job_skills")).alias("pos", "tok"))
    tokens = tokens.select(
        "pos",
        F.when(F.trim("tok") != "", F.trim("tok")).alias("skill"),
    )
    return tokens.groupBy("skill").agg(
        F.count("skill").alias("frequency"),
        F.count(F.when(F.coalesce("pos", F.lit(0)) == 0, 1)).alias("n_posts"),
    )


def _tally(postings: DataFrame, title: str, country: str, k: int) -> DataFrame:
    """One row: ``total, n_jobs, n_unique, other_freq`` and ``tops`` (the top
    k skills as ``array<struct<rank, skill, frequency>>``, rank order)."""
    freq = _frequency(matched_postings(postings, title, country))
    # ``n_posts`` closes the order although ``skill`` is already unique: it
    # keeps that column alive in this branch, so both branches read the same
    # aggregate and Spark computes it once (ReusedExchange).
    order = [F.desc("frequency"), F.asc("skill"), F.asc("n_posts")]
    # The blank group has frequency 0 and sorts after every real skill, so
    # the first k + 1 rows hold the top k skills.  Filtering after the
    # limit (not before it) keeps this branch's aggregate identical to the
    # other branch's, for the same reason.
    top = (
        freq.orderBy(*order)
        .limit(k + 1)
        .filter(F.col("skill").isNotNull())
        # k + 1 rows at most: numbering them in one window is bounded work.
        .withColumn("rank", F.row_number().over(Window.orderBy(*order)))
        .filter(F.col("rank") <= k)
        .select("skill", "rank")
    )
    if k <= TOPK_BROADCAST_ROWS:
        top = F.broadcast(top)
    tagged = freq.join(top, "skill", "left")
    is_top = F.col("rank").isNotNull()
    is_other = F.col("rank").isNull() & F.col("skill").isNotNull()
    # A global aggregate with partial aggregation per partition; its only
    # list holds the top skills, at most k entries.
    return tagged.agg(
        F.coalesce(F.sum("frequency"), F.lit(0)).cast("long").alias("total"),
        F.coalesce(F.sum("n_posts"), F.lit(0)).cast("long").alias("n_jobs"),
        F.count("skill").alias("n_unique"),
        F.coalesce(F.sum(F.when(is_other, F.col("frequency"))), F.lit(0)).cast("long").alias("other_freq"),
        F.array_sort(
            F.collect_list(F.when(is_top, F.struct("rank", "skill", "frequency")))
        ).alias("tops"),
    )


def _fold_sum(arr) -> Column:
    """Left-to-right double sum of the ``p`` fields, like a Python loop."""
    return F.aggregate(arr, F.lit(0.0), lambda acc, t: acc + t["p"])


def _entry(rank, skill, frequency, p) -> Column:
    return F.struct(
        rank.cast("int").alias("rank"), skill.alias("skill"), frequency.alias("frequency"), p.alias("p")
    )


def _shares(tally: DataFrame) -> DataFrame:
    """Adds ``rows`` (the final ``rank, skill, frequency, p`` list) and
    ``p_total`` to the tally row.

    The original's arithmetic in its order: each top skill gets
    ``round(f / t * 100, 2)``; "Other Skills" gets ``round(100 - sum of top
    shares, 2)`` and is listed only when its frequency and share are
    positive; when the listed shares do not add up to exactly 100.0 the
    largest (first on ties) becomes ``round(p + (100 - sum), 2)``.  Sums are
    sequential double additions in rank order; rounding is Python's.
    """
    tops = F.transform(
        "tops",
        lambda t: _entry(
            t["rank"],
            t["skill"],
            t["frequency"],
            shares.share_percent(t["frequency"], F.col("total")),
        ),
    )
    t = tally.withColumn("tops", tops)
    t = t.withColumn("other_p", shares.py_round2(F.lit(100.0) - _fold_sum("tops")))
    other = _entry(F.size("tops") + 1, F.lit(OTHER_SKILLS_LABEL), F.col("other_freq"), F.col("other_p"))
    t = t.withColumn(
        "rows",
        F.when(
            (F.col("other_freq") > 0) & (F.col("other_p") > 0), F.concat("tops", F.array(other))
        ).otherwise(F.col("tops")),
    )
    t = t.withColumn("p_sum", _fold_sum("rows")).withColumn(
        "max_at", F.array_position(F.transform("rows", lambda r: r["p"]), F.array_max(F.transform("rows", lambda r: r["p"])))
    )
    fixed = F.transform(
        "rows",
        lambda r, i: F.when(
            (i + 1 == F.col("max_at")) & (F.col("p_sum") != 100.0),
            _entry(r["rank"], r["skill"], r["frequency"], shares.py_round2(r["p"] + (F.lit(100.0) - F.col("p_sum")))),
        ).otherwise(r),
    )
    t = t.withColumn("rows", fixed)
    return t.withColumn("p_total", _fold_sum("rows"))


def _limit_arg(limit) -> int:
    k = strict_int(limit, "limit")
    if k < 0:
        raise ValueError("limit must not be negative")
    return k


def skill_profile(
    postings: DataFrame,
    title: str,
    country: str,
    limit=DEFAULT_PROFILE_LIMIT,
    keywords: DataFrame | None = None,
) -> DataFrame:
    """``rank, skill, frequency, percentage`` for the top ``limit`` skills of
    postings matching ``title`` and ``country``, plus an "Other Skills" row.

    With ``keywords`` the title is first mapped to a profession name
    (falls back to the text itself when nothing matches).
    """
    k = _limit_arg(limit)
    title = _resolve(postings, title, keywords)
    # inline_outer, not inline: for a non-outer generator Spark infers a
    # ``size(rows) > 0`` filter and pushes it below the projections that
    # build ``rows``, copying that whole expression at every step.  The one
    # all-NULL row inline_outer emits for an empty list is dropped here.
    rows = _shares(_tally(postings, title, country, k)).select("n_jobs", F.inline_outer("rows"))
    # ``n_jobs > 0`` holds whenever a row exists; testing it keeps the
    # posting counts in the plan so this query shares its skill aggregate
    # between the top-k and tagging branches (see ``_tally``).
    return rows.filter(F.col("rank").isNotNull() & (F.col("n_jobs") > 0)).select(
        "rank", "skill", "frequency", F.col("p").alias("percentage")
    ).orderBy("rank")


def profile_summary(
    postings: DataFrame,
    title: str,
    country: str,
    limit=DEFAULT_PROFILE_LIMIT,
    keywords: DataFrame | None = None,
) -> DataFrame:
    """One row: ``total_jobs, total_unique_skills, total_skill_occurrences,
    total_percentage, is_100_percent`` for the same request as
    :func:`skill_profile`."""
    k = _limit_arg(limit)
    title = _resolve(postings, title, keywords)
    t = _shares(_tally(postings, title, country, k))
    return t.select(
        F.col("n_jobs").alias("total_jobs"),
        F.col("n_unique").alias("total_unique_skills"),
        F.col("total").alias("total_skill_occurrences"),
        F.col("p_total").alias("total_percentage"),
        (F.abs(F.col("p_total") - 100.0) < 0.01).alias("is_100_percent"),
    )


def _resolve(postings: DataFrame, title: str, keywords: DataFrame | None) -> str:
    if keywords is None:
        return title
    from skillmesh.operators.titles import resolve_title

    return resolve_title(postings.sparkSession, title, keywords)
