"""skillmesh: job-postings analytics on Spark DataFrames.

Every public function takes and returns DataFrames; none creates a session.
"""

from skillmesh.operators.lookups import (
    global_skills,
    jobs_by_country,
    jobs_by_country_page,
    list_countries,
    search_skills,
    skills_by_country,
    skills_by_country_requests,
    trend_by_year,
    trend_by_year_nested,
)
from skillmesh.operators.profile import profile_summary, skill_frequency, skill_profile
from skillmesh.operators.recommend import filter_has_all_skills, recommend_titles
from skillmesh.operators.rollups import (
    build_job_counts,
    build_job_counts_by_country,
    build_job_counts_by_month,
    build_skill_counts,
    build_skill_counts_by_country,
)
from skillmesh.operators.skill_index import postings_with_all_skills, write_skill_index
from skillmesh.operators.title_index import matched_postings_indexed, write_title_index
from skillmesh.operators.titles import (
    keywords_from_lists,
    clean_titles,
    merge_keywords,
    normalize_titles,
    profession_of_title,
    read_keywords,
    resolve_title,
)
from skillmesh.sources.files import (
    load_or_empty,
    persist_postings,
    read_counts,
    read_country_keyed,
    read_postings,
    rejected_lines,
    to_json_lines,
    write_country_keyed,
)

__all__ = [
    "build_job_counts",
    "build_job_counts_by_country",
    "build_job_counts_by_month",
    "build_skill_counts",
    "build_skill_counts_by_country",
    "clean_titles",
    "filter_has_all_skills",
    "global_skills",
    "jobs_by_country",
    "jobs_by_country_page",
    "keywords_from_lists",
    "list_countries",
    "load_or_empty",
    "matched_postings_indexed",
    "merge_keywords",
    "normalize_titles",
    "persist_postings",
    "postings_with_all_skills",
    "profession_of_title",
    "profile_summary",
    "read_country_keyed",
    "read_counts",
    "read_keywords",
    "read_postings",
    "recommend_titles",
    "rejected_lines",
    "resolve_title",
    "search_skills",
    "skill_frequency",
    "skill_profile",
    "skills_by_country",
    "skills_by_country_requests",
    "to_json_lines",
    "trend_by_year",
    "trend_by_year_nested",
    "write_country_keyed",
    "write_skill_index",
    "write_title_index",
]
