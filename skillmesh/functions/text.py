"""Column builders for skill strings and job titles.

Everything here returns a ``Column`` made of built-in Spark expressions, so
it stays inside whole-stage code generation and never starts a Python
worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skillmesh.fixed import (  # noqa: E402  (re-exported for callers)
    BRACKETED,
    HYPHEN_TAIL,
    OTHER_SKILLS_LABEL,
    SKILL_SEPARATOR,
    VIETNAMESE_LOWER_LETTERS,
    WHITESPACE_CLASS,
)

_WS = f"[{WHITESPACE_CLASS}]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- skills -----------------------------------------------------------------


def split_skills(c) -> Column:
    """``trim`` then split on the separator; trailing empties are kept."""
    return F.split(F.trim(_col(c)), SKILL_SEPARATOR)


def skills_lower(c) -> Column:
    """Skill array with every element lower-cased and trimmed."""
    return F.transform(split_skills(c), lambda x: F.trim(F.lower(x)))


def strip_ws(c) -> Column:
    """Remove leading and trailing whitespace in the wide (Unicode) sense."""
    return F.regexp_replace(_col(c), f"^{_WS}+|{_WS}+$", "")


def ws_tokens(c) -> Column:
    """Whitespace tokens without empty strings (``str.split()``)."""
    return F.filter(F.split(_col(c), f"{_WS}+"), lambda x: x != "")


# --- predicates ---------------------------------------------------------------


# Request values (needles) are lower-cased in Python, columns in Spark, as
# the original service did.


def contains_ci(c, needle: str) -> Column:
    """Case-insensitive substring test (F1/F2)."""
    return F.lower(_col(c)).contains(F.lit(needle.lower()))


def equals_ci(c, value: str) -> Column:
    """Case-insensitive equality."""
    return F.lower(_col(c)) == F.lit(value.lower())


# Partition column of country-keyed tables: a sign and the lower-cased country.
COUNTRY_KEY = "skillmesh_country_key"
COUNTRY_SIGN = "="


def country_equals(df, country: str) -> Column:
    """Case-insensitive country equality; on country-keyed tables the test
    is on the partition column, so Spark prunes partitions."""
    if COUNTRY_KEY in df.columns:
        return F.col(COUNTRY_KEY) == F.lit(COUNTRY_SIGN + country.lower())
    return equals_ci("search_country", country)


def country_contains(df, needle: str) -> Column:
    """Case-insensitive country substring test, pruning partitions when the
    table is country-keyed."""
    if COUNTRY_KEY in df.columns:
        return F.substr(F.col(COUNTRY_KEY), F.lit(len(COUNTRY_SIGN) + 1)).contains(F.lit(needle.lower()))
    return contains_ci("search_country", needle)


def has_all(arr, required: list[str]) -> Column:
    """True when every required value is an element of ``arr``.

    NULL arrays give NULL, so such rows never pass a filter.
    """
    req = F.array(*[F.lit(v) for v in required])
    return _col(arr).isNotNull() & (F.size(F.array_except(req, _col(arr))) == 0)


def year_of(c) -> Column:
    """Text before the first ``-`` of a ``YYYY-MM`` value."""
    return F.substring_index(_col(c), "-", 1)


def not_blank(c) -> Column:
    return _col(c).isNotNull() & (_col(c) != "")


# --- titles ---------------------------------------------------------------------


def clean_title(c) -> Column:
    """Normalise a free-text job title before keyword matching.

    Removes bracketed parts, cuts at the first hyphen, keeps ASCII letters,
    lower-case Vietnamese letters and whitespace, strips, lower-cases.
    ``(?d)`` limits ``.`` and ``$`` to ``\\n`` line ends.
    """
    s = F.regexp_replace(_col(c), BRACKETED, "")
    s = F.regexp_replace(s, "(?d)" + HYPHEN_TAIL, "")
    s = F.regexp_replace(s, f"[^a-zA-Z{VIETNAMESE_LOWER_LETTERS}{WHITESPACE_CLASS}]", "")
    return F.lower(strip_ws(s))
