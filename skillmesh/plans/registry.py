"""Registered queries and their DuckDB oracle SQL.

Every query reads the driver's tables (through the fixture views of
``skillmesh.plans.fixtures``) in full; parameters are request values
(a title, a country, required skills, a report size), never row filters
chosen to make the check cheap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from skillmesh import schemas
from skillmesh.fixed import (
    BRACKETED,
    DEFAULT_THRESHOLD,
    EXACT_MATCH_FACTOR,
    HYPHEN_TAIL,
    MAX_IGNORED_KEYWORD_LENGTH,
    MIN_PARTIAL_TOKEN_LENGTH,
    MULTI_TOKEN_BONUS,
    MULTI_TOKEN_BONUS_MIN_MATCHES,
    OTHER_SKILLS_LABEL,
    PARTIAL_MATCH_SCORE,
    UNKNOWN_PROFESSION,
    VIETNAMESE_LOWER_LETTERS,
)
from skillmesh.operators import lookups, profile, recommend, reshape, rollups, skill_index, title_index, titles
from skillmesh.plans import fixtures as fx
from skillmesh.session import scratch_path
from skillmesh.sources import files

# --- request parameters of the registered queries ----------------------------------
PROFILE_TITLE, PROFILE_COUNTRY, PROFILE_LIMIT = "household", "NATION_1", 15
MATCH_TITLE, MATCH_COUNTRY = "machinery", "nation_2"
EQ_COUNTRY = "nation_1"
REC_COUNTRY, REC_SKILLS = "NATION_3", ["blue bolt"]
JSON_COUNTRY, JSON_SKILLS = "nation_5", [" Blue Bolt ", "RED ring"]
TOP_COUNTRY, TOP_SKILLS = "NATION_7", ["small gear"]
TREND_YEAR = 1997
LOOKUP_COUNTRY = "nation_4"
PAGE_COUNTRY = "nation_6"
SEARCH_NEEDLE = "RIN"
INDEX_SKILLS = [" Blue Bolt ", "RED ring"]
DEEP_LIMIT, LAST_PAGE = 1000, -1
#: Entries of a nested list, few so that every country takes several rows.
SHORT_LISTS = 7


def _postings(spark, d):
    return fx.postings(spark, d)


# --- Spark side ----------------------------------------------------------------------


def _q_skill_profile(spark, d):
    return profile.skill_profile(
        _postings(spark, d), PROFILE_TITLE, PROFILE_COUNTRY, PROFILE_LIMIT, keywords=fx.test_taxonomy(spark)
    )


def _q_profile_summary(spark, d):
    return profile.profile_summary(
        _postings(spark, d), PROFILE_TITLE, PROFILE_COUNTRY, PROFILE_LIMIT, keywords=fx.test_taxonomy(spark)
    )


def _q_skill_frequency(spark, d):
    return profile.skill_frequency(_postings(spark, d), PROFILE_TITLE, PROFILE_COUNTRY)


def _q_filter_title_contains(spark, d):
    return profile.matched_postings(_postings(spark, d), MATCH_TITLE, MATCH_COUNTRY).select(
        "posting_id", "job_title", "search_country"
    )


def _q_filter_country_eq(spark, d):
    from skillmesh.functions.text import equals_ci

    return _postings(spark, d).filter(equals_ci("search_country", EQ_COUNTRY)).select(
        "posting_id", "search_country"
    )


def _q_filter_has_all_skills(spark, d):
    return recommend.filter_has_all_skills(_postings(spark, d), JSON_COUNTRY, JSON_SKILLS).select(
        "posting_id", "job_title"
    )


def _q_tokenize_skills(spark, d):
    return rollups.skill_tokens(_postings(spark, d), "posting_id")


def _q_tokenize_skills_lower(spark, d):
    return rollups.skill_tokens_lower(_postings(spark, d), "posting_id")


def _top_matched(spark, d):
    return recommend.filter_has_all_skills(_postings(spark, d), TOP_COUNTRY, TOP_SKILLS)


def _q_skill_weight_by_title(spark, d):
    return recommend.skill_weight_by_title(_top_matched(spark, d)).select("job_title", "skill", "weight")


def _q_title_counts(spark, d):
    return recommend.title_counts(_top_matched(spark, d))


def _q_top_skills_per_title(spark, d):
    return recommend.top_skills_per_title(recommend.skill_weight_by_title(_top_matched(spark, d)), 10)


def _q_recommend_titles(spark, d):
    rec = recommend.recommend_titles(_postings(spark, d), REC_COUNTRY, REC_SKILLS, 10, 20)
    return rec.select("job_title", "count", F.posexplode("skills").alias("pos", "s")).select(
        "job_title",
        "count",
        (F.col("pos") + 1).cast("int").alias("rank"),
        "s.skill",
        "s.weight",
    )


def _q_recommend_titles_json(spark, d):
    return files.to_json_lines(recommend.recommend_titles(_postings(spark, d), JSON_COUNTRY, JSON_SKILLS, 10, 20))


def _q_build_skill_counts(spark, d):
    return rollups.build_skill_counts(_postings(spark, d))


def _q_build_skill_counts_by_country(spark, d):
    return rollups.build_skill_counts_by_country(_postings(spark, d))


def _q_build_job_counts(spark, d):
    return rollups.build_job_counts(_postings(spark, d))


def _q_build_job_counts_by_country(spark, d):
    nested = rollups.build_job_counts_by_country(_postings(spark, d))
    return reshape.flatten_positions(nested, "search_country", "data")


def _q_build_job_counts_by_month(spark, d):
    nested = rollups.build_job_counts_by_month(_postings(spark, d))
    return reshape.flatten_positions(nested, "month_year", "jobs")


def _q_unnest_job_counts(spark, d):
    return reshape.unnest_job_counts(rollups.build_job_counts_by_country(_postings(spark, d)))


def _q_trend_by_year(spark, d):
    return lookups.trend_by_year(rollups.build_job_counts_by_month(_postings(spark, d)), TREND_YEAR)


def _q_trend_by_year_nested(spark, d):
    nested = lookups.trend_by_year_nested(rollups.build_job_counts_by_month(_postings(spark, d)), TREND_YEAR)
    return reshape.flatten_positions(nested, "month_year", "jobs")


def _q_global_skills(spark, d):
    return lookups.global_skills(rollups.build_skill_counts(_postings(spark, d)), 10)


def _q_skills_by_country(spark, d):
    return lookups.skills_by_country(rollups.build_skill_counts_by_country(_postings(spark, d)), LOOKUP_COUNTRY, 10)


def _q_jobs_by_country(spark, d):
    nested = lookups.jobs_by_country(rollups.build_job_counts_by_country(_postings(spark, d)), PAGE_COUNTRY, 10, 1)
    return nested.select(
        "search_country", "total_jobs", "showing", F.posexplode("data").alias("pos", "j")
    ).select("search_country", "total_jobs", "showing", F.col("pos").cast("int").alias("pos"), "j.job_title", "j.count")


def _q_jobs_by_country_page(spark, d):
    return lookups.jobs_by_country_page(
        rollups.build_job_counts_by_country(_postings(spark, d)), PAGE_COUNTRY, 7, 2
    )


def _q_list_countries(spark, d):
    return lookups.list_countries(rollups.build_job_counts_by_country(_postings(spark, d)))


def _q_search_skills(spark, d):
    return lookups.search_skills(rollups.build_skill_counts(_postings(spark, d)), SEARCH_NEEDLE)


def _q_clean_titles(spark, d):
    return titles.clean_titles(fx.raw_titles(spark, d)).select("title_id", "clean_title")


def _q_normalize_titles(spark, d):
    return titles.normalize_titles(fx.raw_titles(spark, d), fx.test_taxonomy(spark)).select(
        "title_id", "title", "profession", "score", "matched_keyword"
    )


def _q_normalize_titles_lang(spark, d):
    return titles.normalize_titles(
        fx.raw_titles(spark, d), fx.test_taxonomy(spark), language="english", threshold=0.5
    ).select("title_id", "profession", "score", "matched_keyword")


def _q_profession_of_title(spark, d):
    return titles.profession_of_title(fx.raw_titles(spark, d), fx.test_taxonomy(spark)).select(
        "title_id", "profession"
    )


def _q_normalize_titles_dictionary(spark, d):
    """Every title against the whole dictionary of the part names, in both languages."""
    keywords = titles.merge_keywords(*fx.part_dictionary(spark, d))
    found = titles.normalize_titles(fx.two_language_titles(spark, d), keywords)
    return found.select("title_id", "title", "profession", "score", "matched_keyword")


def _q_normalize_titles_vietnamese(spark, d):
    keywords = titles.merge_keywords(*fx.accented_dictionary(spark, d))
    found = titles.normalize_titles(fx.two_language_titles(spark, d), keywords, language="vietnamese", threshold=0.5)
    return found.select("title_id", "title", "profession", "score", "matched_keyword")


def _q_merge_keywords(spark, d):
    en, vn = fx.part_dictionary(spark, d)
    return titles.merge_keywords(en, vn)


def _q_scan_postings(spark, d):
    path = scratch_path(spark, "postings-csv")
    files.write_postings_csv(_postings(spark, d), path)
    cols = ("posting_id", "job_title", "search_country", "job_skills", "month_year")
    return files.read_postings(spark, path, columns=cols)


def _q_scan_counts(spark, d):
    path = scratch_path(spark, "skill-counts-json")
    files.write_json_lines(rollups.build_skill_counts(_postings(spark, d)), path)
    return files.read_counts(spark, path, schemas.SKILL_COUNTS).select("skill", "count")


def _q_scan_nested_counts(spark, d):
    path = scratch_path(spark, "job-counts-by-country-json")
    files.write_json_lines(rollups.build_job_counts_by_country(_postings(spark, d)), path)
    nested = files.read_counts(spark, path, schemas.JOB_COUNTS_BY_COUNTRY)
    return reshape.flatten_positions(nested, "search_country", "data")


def _q_scan_tolerant(spark, d):
    path = scratch_path(spark, "skill-counts-tolerant")
    counts = rollups.build_skill_counts(_postings(spark, d))
    files.write_json_lines(counts, path)
    # A second file in the same folder holds one truncated object per skill.
    counts.select(F.concat(F.lit('{"skill": "'), "skill", F.lit('", "count": ')).alias("value")).write.mode(
        "append"
    ).text(path)
    good = files.load_or_empty(spark, path, schemas.SKILL_COUNTS)
    absent = files.load_or_empty(spark, path + "-absent", schemas.SKILL_COUNTS)
    return good.unionByName(absent)


def _q_filter_has_all_skills_index(spark, d):
    """F4 through the inverted index, in all countries."""
    path = scratch_path(spark, "skill-index")
    skill_index.write_skill_index(_postings(spark, d), path)
    return skill_index.postings_with_all_skills(spark, path, INDEX_SKILLS).select("posting_id", "job_title", "search_country")


def _q_filter_title_contains_index(spark, d):
    """F1 and F2 through the trigram index of the distinct titles."""
    path, rows = scratch_path(spark, "title-index"), _postings(spark, d)
    title_index.write_title_index(rows, path)
    return title_index.matched_postings_indexed(rows, path, MATCH_TITLE, MATCH_COUNTRY).select("posting_id", "job_title", "search_country")


def _posting_pages(spark, d):
    """A long sorted table: the tokens of all postings as one country's titles."""
    tokens = rollups.skill_tokens(_postings(spark, d), "posting_id")
    titles_ = tokens.select(F.lit("All").alias("search_country"), F.concat_ws(" ", "skill", "posting_id").alias("job_title"))
    return rollups.build_job_counts_by_country(titles_)


def _q_jobs_by_country_deep_page(spark, d):
    """A page far behind the beginning: rows 30,000 to 30,999."""
    return lookups.jobs_by_country_page(_posting_pages(spark, d), "all", DEEP_LIMIT, 31)


def _q_jobs_by_country_last_page(spark, d):
    """A page counted from the end, with the total beside it."""
    nested = lookups.jobs_by_country(_posting_pages(spark, d), "ALL", DEEP_LIMIT, LAST_PAGE)
    return nested.select("search_country", "total_jobs", "showing", F.posexplode("data").alias("pos", "j")).select(
        "search_country", "total_jobs", "showing", "pos", "j.job_title", "j.count"
    )


def _q_build_job_counts_in_rows(spark, d):
    """R4 with lists cut to ``SHORT_LISTS`` entries: rows and entries of each country, read back by a lookup's merge."""
    nested = rollups.build_job_counts_by_country(_postings(spark, d), list_rows=SHORT_LISTS)
    parts = nested.groupBy("search_country").agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size("data")).cast("long").alias("longest"))
    merged = reshape.unnest_job_counts(nested).groupBy("search_country").agg(F.count(F.lit(1)).alias("n_titles"), F.sum("count").alias("n_jobs"))
    return parts.join(merged, "search_country")


def _requests(spark, d):
    nation = fx.table(spark, d, "nation")
    key = F.col("n_nationkey")
    limit = F.when(key % 5 == 0, "ten").when(key % 5 == 1, "").when(key % 5 == 2, " 3 ").when(key % 5 == 3, "0").otherwise("-120")
    return nation.select(key.cast("long").alias("request_id"), F.lower("n_name").alias("country"), limit.alias("limit"))


def _q_skills_by_country_requests(spark, d):
    """Q4 for a table of requests whose limits are texts."""
    return lookups.skills_by_country_requests(rollups.build_skill_counts_by_country(_postings(spark, d)), _requests(spark, d))


def _q_persisted_postings(spark, d):
    """Two summaries of postings kept in memory, which are released before the result is read."""
    kept, path = files.persist_postings(_postings(spark, d)), scratch_path(spark, "persisted")
    try:
        by_title = rollups.build_job_counts(kept).select(F.lit("title").alias("kind"), F.col("job_title").alias("name"), "count")
        by_skill = rollups.build_skill_counts(kept).select(F.lit("skill").alias("kind"), F.col("skill").alias("name"), "count")
        by_title.write.parquet(path)
        by_skill.write.mode("append").parquet(path)
    finally:
        kept.unpersist()
    return spark.read.parquet(path)


def _write_damaged(spark, d, path):
    """The nested country table as JSON Lines with, for each country, a bad element added
    to its list, and a line with a list of the wrong type; and one truncated line."""
    nested = rollups.build_job_counts_by_country(_postings(spark, d))
    lines = nested.select(F.to_json(F.struct("search_country", "data")).alias("value"), "search_country")
    name = F.to_json(F.struct("search_country"))
    lines.select(F.regexp_replace("value", r"\]\}$", ', {"job_title": "bad", "count": "many"}]}').alias("value")).write.text(path)
    lines.select(F.regexp_replace(name, r"\}$", ', "data": 7}').alias("value")).write.mode("append").text(path)
    lines.select(F.expr("substring(value, 1, length(value) - 1)").alias("value")).limit(1).write.mode("append").text(path)


def _q_scan_tolerant_nested(spark, d):
    """S4 on nested records: wrong types, bad list elements and a truncated line."""
    path = scratch_path(spark, "damaged")
    _write_damaged(spark, d, path)
    return reshape.flatten_positions(files.load_or_empty(spark, path, schemas.JOB_COUNTS_BY_COUNTRY), "search_country", "data")


def _q_scan_tolerant_losses(spark, d):
    """What the load of ``scan_tolerant_nested`` lost, counted during one action on it."""
    path, losses = scratch_path(spark, "damaged"), Observation("losses")
    _write_damaged(spark, d, path)
    loaded = files.load_or_empty(spark, path, schemas.JOB_COUNTS_BY_COUNTRY, losses)
    loaded.write.parquet(scratch_path(spark, "loaded"))
    return spark.createDataFrame([losses.get], "lines long, dropped_lines long, dropped_elements long")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "skill_frequency": _q_skill_frequency,
    "skill_profile": _q_skill_profile,
    "profile_summary": _q_profile_summary,
    "filter_title_contains": _q_filter_title_contains,
    "filter_country_eq": _q_filter_country_eq,
    "filter_has_all_skills": _q_filter_has_all_skills,
    "tokenize_skills": _q_tokenize_skills,
    "tokenize_skills_lower": _q_tokenize_skills_lower,
    "skill_weight_by_title": _q_skill_weight_by_title,
    "title_counts": _q_title_counts,
    "top_skills_per_title": _q_top_skills_per_title,
    "recommend_titles": _q_recommend_titles,
    "recommend_titles_json": _q_recommend_titles_json,
    "build_skill_counts": _q_build_skill_counts,
    "build_skill_counts_by_country": _q_build_skill_counts_by_country,
    "build_job_counts": _q_build_job_counts,
    "build_job_counts_by_country": _q_build_job_counts_by_country,
    "build_job_counts_by_month": _q_build_job_counts_by_month,
    "unnest_job_counts": _q_unnest_job_counts,
    "trend_by_year": _q_trend_by_year,
    "trend_by_year_nested": _q_trend_by_year_nested,
    "global_skills": _q_global_skills,
    "skills_by_country": _q_skills_by_country,
    "jobs_by_country": _q_jobs_by_country,
    "jobs_by_country_page": _q_jobs_by_country_page,
    "list_countries": _q_list_countries,
    "search_skills": _q_search_skills,
    "clean_titles": _q_clean_titles,
    "normalize_titles": _q_normalize_titles,
    "normalize_titles_lang": _q_normalize_titles_lang,
    "profession_of_title": _q_profession_of_title,
    "normalize_titles_dictionary": _q_normalize_titles_dictionary,
    "normalize_titles_vietnamese": _q_normalize_titles_vietnamese,
    "merge_keywords": _q_merge_keywords,
    "scan_postings": _q_scan_postings,
    "scan_counts": _q_scan_counts,
    "scan_nested_counts": _q_scan_nested_counts,
    "scan_tolerant": _q_scan_tolerant,
    "scan_tolerant_nested": _q_scan_tolerant_nested,
    "scan_tolerant_losses": _q_scan_tolerant_losses,
    "persisted_postings": _q_persisted_postings,
    "filter_has_all_skills_index": _q_filter_has_all_skills_index,
    "filter_title_contains_index": _q_filter_title_contains_index,
    "jobs_by_country_deep_page": _q_jobs_by_country_deep_page,
    "jobs_by_country_last_page": _q_jobs_by_country_last_page,
    "build_job_counts_in_rows": _q_build_job_counts_in_rows,
    "skills_by_country_requests": _q_skills_by_country_requests,
}


# --- DuckDB side -----------------------------------------------------------------------

# RE2 spelling of the whitespace class used by the title rules.
_WS = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _with(*ctes: tuple[str, str], body: str) -> str:
    parts = [("postings", fx.POSTINGS_SQL)] + list(ctes)
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in parts) + "\n" + body


_TOKENS = r"""SELECT posting_id, job_title, search_country, month_year, trim(tok) AS skill
FROM (SELECT *, unnest(regexp_split_to_array(trim(job_skills), ',\s*')) AS tok FROM postings)"""

_SKILL_COUNTS = f"SELECT skill, count(*) AS count FROM ({_TOKENS}) WHERE skill <> '' GROUP BY skill"
_SKILL_COUNTS_BY_COUNTRY = (
    f"SELECT search_country, skill, count(*) AS count FROM ({_TOKENS}) WHERE skill <> '' "
    "GROUP BY search_country, skill"
)


def _nested_pos_sql(key: str) -> str:
    return (
        f"SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY count DESC, job_title) - 1 AS INTEGER) AS pos, "
        f"job_title, count FROM (SELECT {key}, job_title, count(*) AS count FROM postings GROUP BY {key}, job_title)"
    )


def _matched_profile(title: str, country: str) -> str:
    return (
        f"SELECT * FROM postings WHERE contains(lower(job_title), lower({_lit(title)})) "
        f"AND contains(lower(search_country), lower({_lit(country)}))"
    )


def _profile_rows_sql(title: str, country: str, k: int) -> list[tuple[str, str]]:
    """The profile in DuckDB: doubles, rounding by DuckDB's exact decimal
    formatting (not the engine's arithmetic), and sums as left folds in rank
    order (``list_reduce``), as the original's loop did."""

    def r2(x: str) -> str:
        return f"CAST(format('{{:.2f}}', {x}) AS DOUBLE)"

    fold = "coalesce(list_reduce(list(p ORDER BY rank), lambda a, b: a + b, 0.0::DOUBLE), 0.0::DOUBLE)"
    return [
        ("m", _matched_profile(title, country)),
        (
            "tok",
            r"SELECT trim(t) AS skill FROM (SELECT unnest(regexp_split_to_array(trim(job_skills), ',\s*')) AS t FROM m)",
        ),
        ("freq", "SELECT skill, count(*) AS frequency FROM tok WHERE skill <> '' GROUP BY skill"),
        ("tot", "SELECT CAST(coalesce(sum(frequency), 0) AS BIGINT) AS total, count(*) AS n_skills FROM freq"),
        (
            "top",
            f"SELECT skill, frequency, row_number() OVER (ORDER BY frequency DESC, skill) AS rank "
            f"FROM freq ORDER BY frequency DESC, skill LIMIT {k}",
        ),
        (
            "topp",
            f"SELECT rank, skill, frequency, "
            f"{r2('CAST(frequency AS DOUBLE) / CAST(total AS DOUBLE) * 100.0::DOUBLE')} AS p "
            "FROM top, tot",
        ),
        (
            "agg",
            f"SELECT {fold} AS top_sum, count(*) AS n_top, coalesce(sum(frequency), 0) AS top_freq FROM topp",
        ),
        (
            "oth",
            f"SELECT n_top + 1 AS rank, {_lit(OTHER_SKILLS_LABEL)} AS skill, total - top_freq AS frequency, "
            f"{r2('100.0::DOUBLE - top_sum')} AS p FROM agg, tot",
        ),
        (
            "kept",
            "SELECT rank, skill, frequency, p FROM topp UNION ALL "
            "SELECT rank, skill, frequency, p FROM oth WHERE frequency > 0 AND p > 0",
        ),
        ("ks", f"SELECT {fold} AS p_sum FROM kept"),
        ("mx", "SELECT rank AS max_rank FROM kept ORDER BY p DESC, rank LIMIT 1"),
        (
            "adj",
            f"SELECT rank, skill, frequency, CASE WHEN rank = max_rank AND p_sum <> 100.0 "
            f"THEN {r2('p + (100.0::DOUBLE - p_sum)')} ELSE p END AS p "
            "FROM kept, ks, mx",
        ),
    ]


def _profile_sql() -> str:
    return _with(
        *_profile_rows_sql(PROFILE_TITLE, PROFILE_COUNTRY, PROFILE_LIMIT),
        body="SELECT CAST(rank AS INTEGER) AS rank, skill, CAST(frequency AS BIGINT) AS frequency, "
        "p AS percentage FROM adj",
    )


def _profile_summary_sql() -> str:
    fold = "coalesce(list_reduce(list(p ORDER BY rank), lambda a, b: a + b, 0.0::DOUBLE), 0.0::DOUBLE)"
    return _with(
        *_profile_rows_sql(PROFILE_TITLE, PROFILE_COUNTRY, PROFILE_LIMIT),
        ("fs", f"SELECT {fold} AS total_percentage FROM adj"),
        body="SELECT (SELECT count(*) FROM m) AS total_jobs, tot.n_skills AS total_unique_skills, "
        "tot.total AS total_skill_occurrences, total_percentage, "
        "abs(total_percentage - 100.0) < 0.01 AS is_100_percent FROM tot, fs",
    )


def _lower_skills_matched(country: str, skills: list[str]) -> str:
    req = ", ".join(_lit(s.strip().lower()) for s in skills)
    return (
        r"SELECT * FROM (SELECT *, list_transform(regexp_split_to_array(trim(job_skills), ',\s*'), "
        r"lambda x: trim(lower(x))) AS skills FROM postings "
        f"WHERE lower(search_country) = lower({_lit(country)})) "
        f"WHERE skills IS NOT NULL AND list_has_all(skills, [{req}])"
    )


def _weights_ctes(country: str, skills: list[str]) -> list[tuple[str, str]]:
    return [
        ("m2", _lower_skills_matched(country, skills)),
        ("cnt", "SELECT job_title, count(*) AS count FROM m2 GROUP BY job_title"),
        (
            "sk",
            "SELECT job_title, s AS skill, count(*) AS weight FROM "
            "(SELECT job_title, unnest(skills) AS s FROM m2) GROUP BY job_title, s",
        ),
        (
            "rk",
            "SELECT job_title, skill, weight, row_number() OVER (PARTITION BY job_title ORDER BY weight DESC, skill) AS rank "
            "FROM sk WHERE skill <> ''",
        ),
    ]


def _recommend_flat_sql(country, skills) -> str:
    return _with(
        *_weights_ctes(country, skills),
        ("top", "SELECT job_title, count FROM cnt ORDER BY count DESC, job_title LIMIT 20"),
        body="SELECT t.job_title, t.count, CAST(r.rank AS INTEGER) AS rank, r.skill, r.weight "
        "FROM top t JOIN rk r ON t.job_title = r.job_title WHERE r.rank <= 10",
    )


def _recommend_json_sql(country, skills) -> str:
    return _with(
        *_weights_ctes(country, skills),
        ("top", "SELECT job_title, count FROM cnt ORDER BY count DESC, job_title LIMIT 20"),
        (
            "nest",
            "SELECT t.job_title, t.count, list({'skill': r.skill, 'weight': r.weight} ORDER BY r.rank) AS skills "
            "FROM top t JOIN rk r ON t.job_title = r.job_title WHERE r.rank <= 10 GROUP BY t.job_title, t.count",
        ),
        body="SELECT CAST(to_json({'job_title': job_title, 'skills': skills, 'count': count}) AS VARCHAR) AS json FROM nest",
    )


def _strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{_WS}+|{_WS}+$', '', 'g')"


def _clean_sql(expr: str) -> str:
    s = f"regexp_replace({expr}, '{BRACKETED}', '', 'g')"
    s = f"regexp_replace({s}, '{HYPHEN_TAIL}', '')"
    s = f"regexp_replace({s}, '[^a-zA-Z{VIETNAMESE_LOWER_LETTERS}{_WS[1:-1]}]', '', 'g')"
    return f"lower({_strip(s)})"


def _tokens_sql(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '{_WS}+'), lambda x: x <> '')"


def _normalize_sql(
    language: str = "both", threshold: float = DEFAULT_THRESHOLD, titles_sql: str = fx.RAW_TITLES_SQL, taxonomy_sql: str | None = None
) -> str:
    lang = {"english": "AND language = 'english'", "vietnamese": "AND language = 'vietnamese'"}.get(language, "")
    mc = (
        "list_reduce(KT, lambda acc, x: acc + CASE WHEN list_contains(TT, x) THEN 1.0::DOUBLE "
        f"WHEN length(x) >= {MIN_PARTIAL_TOKEN_LENGTH} AND len(list_filter(TT, lambda n: contains(n, x) OR contains(x, n))) > 0 "
        f"THEN {PARTIAL_MATCH_SCORE!r}::DOUBLE ELSE 0.0::DOUBLE END, 0.0::DOUBLE)"
    )
    score = (
        f"CASE WHEN contains(T, K) THEN length(K) / length(T) * {EXACT_MATCH_FACTOR} "
        f"WHEN len(KT) = 0 OR (len(KT) = 1 AND length(KT[1]) < {MIN_PARTIAL_TOKEN_LENGTH}) THEN NULL "
        f"WHEN len(KT) > 1 AND mc >= {MULTI_TOKEN_BONUS_MIN_MATCHES} THEN mc / len(KT) * {MULTI_TOKEN_BONUS!r}::DOUBLE "
        "ELSE mc / len(KT) END"
    )
    return (
        "WITH titles AS (" + titles_sql + "),\n"
        "taxonomy AS (" + (taxonomy_sql or fx.taxonomy_sql()) + "),\n"
        f"kw AS (SELECT prof_pos, kw_pos, profession, keyword, {_strip('lower(keyword)')} AS K FROM taxonomy "
        f"WHERE length({_strip('keyword')}) > {MAX_IGNORED_KEYWORD_LENGTH} {lang}),\n"
        f"kw2 AS (SELECT *, {_tokens_sql('K')} AS KT FROM kw),\n"
        f"t AS (SELECT title_id, title, {_clean_sql('title')} AS T FROM titles),\n"
        f"t2 AS (SELECT T, {_tokens_sql('T')} AS TT FROM (SELECT DISTINCT T FROM t)),\n"
        f"pairs AS (SELECT T, K, KT, prof_pos, kw_pos, profession, keyword, {mc} AS mc FROM t2, kw2),\n"
        f"scored AS (SELECT *, {score} AS score FROM pairs),\n"
        f"ok AS (SELECT * FROM scored WHERE score > 0 AND (contains(T, K) OR score >= {float(threshold)!r}::DOUBLE)),\n"
        "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY T ORDER BY score DESC, prof_pos, kw_pos) AS o FROM ok) WHERE o = 1)\n"
        f"SELECT t.title_id, t.title, coalesce(b.profession, {_lit(UNKNOWN_PROFESSION)}) AS profession, "
        "least(coalesce(b.score, 0.0::DOUBLE), 1.0::DOUBLE) AS score, b.keyword AS matched_keyword "
        "FROM t LEFT JOIN best b ON t.T = b.T"
    )


def _merge_keywords_sql(dictionary: dict[str, str] = fx.PART_DICTIONARY_SQL) -> str:
    return (
        f"WITH en AS ({dictionary['english']}), vn AS ({dictionary['vietnamese']}),\n"
        "off AS (SELECT prof_pos, profession, max(kw_pos) + 1 AS off FROM en GROUP BY prof_pos, profession),\n"
        "last_vn AS (SELECT profession, max(prof_pos) AS vp FROM vn GROUP BY profession)\n"
        "SELECT prof_pos, kw_pos, profession, 'english' AS language, keyword FROM en\n"
        "UNION ALL\n"
        "SELECT o.prof_pos, CAST(o.off + v.kw_pos AS INTEGER) AS kw_pos, o.profession, 'vietnamese' AS language, v.keyword\n"
        "FROM off o JOIN vn v ON o.profession = v.profession JOIN last_vn l ON v.profession = l.profession AND v.prof_pos = l.vp"
    )


def _country_titles_sql(country: str) -> str:
    return (
        "SELECT job_title, CAST(sum(count) AS BIGINT) AS count, min(search_country) AS search_country FROM "
        f"(SELECT search_country, job_title, count(*) AS count FROM postings GROUP BY search_country, job_title) "
        f"WHERE lower(search_country) = lower({_lit(country)}) GROUP BY job_title"
    )


def _all_titles_sql() -> list[tuple[str, str]]:
    """The rows of ``_posting_pages``, numbered by count and title from 0."""
    return [
        ("tt", f"SELECT skill || ' ' || posting_id AS job_title, count(*) AS count FROM ({_TOKENS}) WHERE skill <> '' GROUP BY 1"),
        ("pg", "SELECT *, row_number() OVER (ORDER BY count DESC, job_title) - 1 AS nth, count(*) OVER () AS total FROM tt"),
    ]


def oracle_sql() -> dict[str, str]:
    tok_lower = (
        r"SELECT posting_id, trim(lower(s)) AS skill FROM (SELECT posting_id, "
        r"unnest(regexp_split_to_array(trim(job_skills), ',\s*')) AS s FROM postings)"
    )
    trend = (
        "SELECT month_year, job_title, count(*) AS count FROM postings "
        f"WHERE month_year IS NOT NULL AND split_part(month_year, '-', 1) = '{TREND_YEAR}' GROUP BY month_year, job_title"
    )
    return {
        "skill_frequency": _with(
            *_profile_rows_sql(PROFILE_TITLE, PROFILE_COUNTRY, PROFILE_LIMIT)[:3], body="SELECT skill, frequency FROM freq"
        ),
        "skill_profile": _profile_sql(),
        "profile_summary": _profile_summary_sql(),
        "filter_title_contains": _with(
            ("m", _matched_profile(MATCH_TITLE, MATCH_COUNTRY)),
            body="SELECT posting_id, job_title, search_country FROM m",
        ),
        "filter_country_eq": _with(
            body=f"SELECT posting_id, search_country FROM postings WHERE lower(search_country) = lower({_lit(EQ_COUNTRY)})"
        ),
        "filter_has_all_skills": _with(
            ("m2", _lower_skills_matched(JSON_COUNTRY, JSON_SKILLS)), body="SELECT posting_id, job_title FROM m2"
        ),
        "tokenize_skills": _with(body=f"SELECT posting_id, skill FROM ({_TOKENS}) WHERE skill <> ''"),
        "tokenize_skills_lower": _with(body=f"SELECT posting_id, skill FROM ({tok_lower}) WHERE skill <> ''"),
        "skill_weight_by_title": _with(
            *_weights_ctes(TOP_COUNTRY, TOP_SKILLS), body="SELECT job_title, skill, weight FROM sk"
        ),
        "title_counts": _with(*_weights_ctes(TOP_COUNTRY, TOP_SKILLS), body="SELECT job_title, count FROM cnt"),
        "top_skills_per_title": _with(
            *_weights_ctes(TOP_COUNTRY, TOP_SKILLS),
            body="SELECT r.job_title, c.count, CAST(r.rank AS INTEGER) AS rank, r.skill, r.weight "
            "FROM rk r JOIN cnt c ON r.job_title = c.job_title WHERE r.rank <= 10",
        ),
        "recommend_titles": _recommend_flat_sql(REC_COUNTRY, REC_SKILLS),
        "recommend_titles_json": _recommend_json_sql(JSON_COUNTRY, JSON_SKILLS),
        "build_skill_counts": _with(body=_SKILL_COUNTS),
        "build_skill_counts_by_country": _with(body=_SKILL_COUNTS_BY_COUNTRY),
        "build_job_counts": _with(body="SELECT job_title, count(*) AS count FROM postings GROUP BY job_title"),
        "build_job_counts_by_country": _with(body=_nested_pos_sql("search_country")),
        "build_job_counts_by_month": _with(body=_nested_pos_sql("month_year")),
        "unnest_job_counts": _with(
            body="SELECT search_country, job_title, count(*) AS count FROM postings "
            "WHERE search_country IS NOT NULL GROUP BY search_country, job_title"
        ),
        "trend_by_year": _with(body=trend),
        "trend_by_year_nested": _with(
            body="SELECT month_year, CAST(row_number() OVER (PARTITION BY month_year ORDER BY count DESC, job_title) - 1 AS INTEGER) AS pos, "
            f"job_title, count FROM ({trend})"
        ),
        "global_skills": _with(body=f"SELECT skill, count FROM ({_SKILL_COUNTS}) ORDER BY count DESC, skill LIMIT 10"),
        "skills_by_country": _with(
            body=f"SELECT skill, count, search_country FROM ({_SKILL_COUNTS_BY_COUNTRY}) "
            f"WHERE lower(search_country) = lower({_lit(LOOKUP_COUNTRY)}) ORDER BY count DESC, skill LIMIT 10"
        ),
        "jobs_by_country": _with(
            ("ct", _country_titles_sql(PAGE_COUNTRY)),
            (
                "pg",
                "SELECT *, CAST(row_number() OVER (ORDER BY count DESC, job_title) - 1 AS INTEGER) AS pos FROM ct",
            ),
            body="SELECT (SELECT min(search_country) FROM ct) AS search_country, (SELECT count(*) FROM ct) AS total_jobs, "
            "(SELECT count(*) FROM pg WHERE pos < 10) AS showing, pos, job_title, count FROM pg WHERE pos < 10",
        ),
        "jobs_by_country_page": _with(
            ("ct", _country_titles_sql(PAGE_COUNTRY)),
            body="SELECT search_country, job_title, count FROM ct ORDER BY count DESC, job_title LIMIT 7 OFFSET 7",
        ),
        "list_countries": _with(
            body="SELECT DISTINCT search_country FROM postings WHERE search_country IS NOT NULL AND search_country <> ''"
        ),
        "search_skills": _with(
            body=f"SELECT skill FROM ({_SKILL_COUNTS}) WHERE contains(lower(skill), lower({_lit(SEARCH_NEEDLE)}))"
        ),
        "clean_titles": f"SELECT title_id, {_clean_sql('title')} AS clean_title FROM ({fx.RAW_TITLES_SQL})",
        "normalize_titles": _normalize_sql(),
        "normalize_titles_lang": "SELECT title_id, profession, score, matched_keyword FROM ("
        + _normalize_sql("english", 0.5)
        + ")",
        "profession_of_title": "SELECT title_id, profession FROM (" + _normalize_sql() + ")",
        "normalize_titles_dictionary": _normalize_sql(titles_sql=fx.TWO_LANGUAGE_TITLES_SQL, taxonomy_sql=_merge_keywords_sql()),
        "normalize_titles_vietnamese": _normalize_sql(
            "vietnamese", 0.5, fx.TWO_LANGUAGE_TITLES_SQL, _merge_keywords_sql(fx.ACCENTED_DICTIONARY_SQL)
        ),
        "merge_keywords": _merge_keywords_sql(),
        "scan_postings": _with(
            body="SELECT CAST(posting_id AS VARCHAR) AS posting_id, job_title, search_country, job_skills, month_year FROM postings"
        ),
        "scan_counts": _with(body=_SKILL_COUNTS),
        "scan_nested_counts": _with(body=_nested_pos_sql("search_country")),
        "scan_tolerant": _with(body=_SKILL_COUNTS),
        "scan_tolerant_nested": _with(body=_nested_pos_sql("search_country")),
        "scan_tolerant_losses": _with(
            ("c", "SELECT count(DISTINCT search_country) AS n FROM postings"),
            body="SELECT 2 * n + least(n, 1) AS lines, n + least(n, 1) AS dropped_lines, n AS dropped_elements FROM c",
        ),
        "persisted_postings": _with(
            body=f"SELECT 'title' AS kind, job_title AS name, count(*) AS count FROM postings GROUP BY job_title "
            f"UNION ALL SELECT 'skill' AS kind, skill AS name, count FROM ({_SKILL_COUNTS})"
        ),
        "filter_has_all_skills_index": _with(
            (
                "m2",
                r"SELECT *, list_transform(regexp_split_to_array(trim(job_skills), ',\s*'), lambda x: trim(lower(x))) AS skills FROM postings",
            ),
            body="SELECT posting_id, job_title, search_country FROM m2 "
            f"WHERE list_has_all(skills, [{', '.join(_lit(s.strip().lower()) for s in INDEX_SKILLS)}])",
        ),
        "filter_title_contains_index": _with(
            ("m", _matched_profile(MATCH_TITLE, MATCH_COUNTRY)), body="SELECT posting_id, job_title, search_country FROM m"
        ),
        "jobs_by_country_deep_page": _with(
            *_all_titles_sql(),
            body=f"SELECT 'All' AS search_country, job_title, count FROM pg WHERE nth >= {30 * DEEP_LIMIT} AND nth < {31 * DEEP_LIMIT}",
        ),
        "jobs_by_country_last_page": _with(
            *_all_titles_sql(),
            ("own", f"SELECT * FROM pg WHERE nth >= total - {2 * DEEP_LIMIT} AND nth < total - {DEEP_LIMIT}"),
            body="SELECT 'All' AS search_country, total AS total_jobs, (SELECT count(*) FROM own) AS showing, "
            "CAST(row_number() OVER (ORDER BY nth) - 1 AS INTEGER) AS pos, job_title, count FROM own",
        ),
        "build_job_counts_in_rows": _with(
            body="SELECT search_country, CAST(ceil(count(DISTINCT job_title) / {0}) AS BIGINT) AS n_rows, "
            "CAST(least(count(DISTINCT job_title), {0}) AS BIGINT) AS longest, count(DISTINCT job_title) AS n_titles, "
            "count(*) AS n_jobs FROM postings GROUP BY search_country".format(SHORT_LISTS)
        ),
        "skills_by_country_requests": _with(
            (
                "r",
                f"SELECT CAST(n_nationkey AS BIGINT) AS request_id, skill, count, search_country, n_nationkey % 5 AS kind, "
                "row_number() OVER (PARTITION BY n_nationkey ORDER BY count DESC, skill) AS rank, count(*) OVER (PARTITION BY n_nationkey) AS total "
                f"FROM nation JOIN ({_SKILL_COUNTS_BY_COUNTRY}) ON lower(n_name) = lower(search_country)",
            ),
            body="SELECT request_id, CAST(rank AS INTEGER) AS rank, skill, count, search_country FROM r "
            "WHERE CASE kind WHEN 0 THEN rank <= 10 WHEN 3 THEN false WHEN 2 THEN rank <= 3 WHEN 4 THEN rank <= total - 120 ELSE true END",
        ),
        "scan_postings_parquet": _with(
            body=f"SELECT posting_id, search_country FROM postings WHERE lower(search_country) = lower({_lit(EQ_COUNTRY)})"
        ),
    }


def _q_scan_postings_parquet(spark, d):
    """S1 on the columnar layout: postings written country-keyed, read back,
    then a country lookup that prunes to one partition."""
    path = scratch_path(spark, "postings-parquet")
    files.write_country_keyed(_postings(spark, d), path)
    table = files.read_country_keyed(spark, path)
    from skillmesh.functions.text import country_equals

    return table.filter(country_equals(table, EQ_COUNTRY)).select("posting_id", "search_country")


QUERIES["scan_postings_parquet"] = _q_scan_postings_parquet
