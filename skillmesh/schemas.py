"""Declared schemas for every table the library reads or builds.

Declaring schemas avoids a pass over the input for inference and makes a
missing field read as NULL instead of shifting columns.
"""

from pyspark.sql import types as T

JOB_COUNT = T.StructType(
    [
        T.StructField("job_title", T.StringType()),
        T.StructField("count", T.LongType()),
    ]
)

# Raw postings: every column is text, as in a header CSV read without inference.
POSTINGS = T.StructType(
    [
        T.StructField("job_title", T.StringType()),
        T.StructField("search_country", T.StringType()),
        T.StructField("job_skills", T.StringType()),
        T.StructField("month_year", T.StringType()),
    ]
)

SKILL_COUNTS = T.StructType(
    [
        T.StructField("skill", T.StringType()),
        T.StructField("count", T.LongType()),
    ]
)

SKILL_COUNTS_BY_COUNTRY = T.StructType(
    [
        T.StructField("search_country", T.StringType()),
        T.StructField("skill", T.StringType()),
        T.StructField("count", T.LongType()),
    ]
)

JOB_COUNTS = JOB_COUNT

JOB_COUNTS_BY_COUNTRY = T.StructType(
    [
        T.StructField("search_country", T.StringType()),
        T.StructField("data", T.ArrayType(JOB_COUNT)),
    ]
)

JOB_COUNTS_BY_MONTH = T.StructType(
    [
        T.StructField("month_year", T.StringType()),
        T.StructField("jobs", T.ArrayType(JOB_COUNT)),
    ]
)

# Long form of a profession dictionary: one row per keyword.  ``prof_pos``
# orders professions, ``kw_pos`` orders keywords inside a profession
# (English keywords before Vietnamese ones); both decide ties.
PROFESSION_KEYWORDS = T.StructType(
    [
        T.StructField("prof_pos", T.IntegerType()),
        T.StructField("kw_pos", T.IntegerType()),
        T.StructField("profession", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("keyword", T.StringType()),
    ]
)

# One language list of a dictionary before merging.
LANGUAGE_KEYWORDS = T.StructType(
    [
        T.StructField("prof_pos", T.IntegerType()),
        T.StructField("kw_pos", T.IntegerType()),
        T.StructField("profession", T.StringType()),
        T.StructField("keyword", T.StringType()),
    ]
)

PROFILE = T.StructType(
    [
        T.StructField("rank", T.IntegerType()),
        T.StructField("skill", T.StringType()),
        T.StructField("frequency", T.LongType()),
        T.StructField("percentage", T.DoubleType()),
    ]
)
