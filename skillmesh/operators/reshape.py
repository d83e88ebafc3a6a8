"""Projections and reshaping of the nested count tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unnest_job_counts(nested: DataFrame, key: str = "search_country", list_name: str = "data", with_name: bool = False) -> DataFrame:
    """One row per ``(key, job_title, count)`` of a nested count table.

    Rows without a key or without a list are skipped (F10); a missing title
    becomes ``''`` and a missing count ``0`` (P5).  ``inline`` skips NULL
    arrays, so one bad row never empties the table.  ``with_name`` keeps the
    entries' ``name``.
    """
    flat = nested.filter(F.col(key).isNotNull() & F.col(list_name).isNotNull()).select(
        key, F.inline(list_name)
    )
    return flat.select(
        key,
        F.coalesce("job_title", F.lit("")).alias("job_title"),
        F.coalesce("count", F.lit(0)).cast("long").alias("count"),
        *(["name"] if with_name else []),
    )


def flatten_positions(nested: DataFrame, key: str, list_name: str) -> DataFrame:
    """``key, pos, <struct fields>`` keeping each element's list position."""
    return nested.select(key, F.posexplode(list_name).alias("pos", "item")).select(
        key, F.col("pos").cast("int").alias("pos"), "item.*"
    )
