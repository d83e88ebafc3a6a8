"""Argument handling shared by the lookup queries.

Limits and pages arrive as text from callers; the lookups accept anything
``int()`` accepts and fall back to the service default otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillmesh.fixed import DEFAULT_LOOKUP_LIMIT


def coerce_limit(limit, default: int = DEFAULT_LOOKUP_LIMIT):
    """``None`` or another false value → no limit; non-numbers → ``default``."""
    if not limit:
        return None
    try:
        return int(limit)
    except (TypeError, ValueError):
        return default


def strict_int(value, name: str) -> int:
    """``int()`` or a ``ValueError`` naming the argument."""
    try:
        return int(value)
    except (TypeError, ValueError) as exc:
        raise ValueError(f"{name} must be an integer, got {value!r}") from exc


def slice_sorted(df: DataFrame, start: int, stop: int | None) -> DataFrame:
    """Rows ``[start:stop]`` of an already sorted DataFrame, with Python
    slice meaning.

    Non-negative bounds become ``offset``/``limit`` on the sorted plan, which
    Spark executes as a distributed top-k.  Negative bounds count from the
    end and need the row count, so only that rare path runs a ``count()``.
    For deep pages of a large table see ``functions/paging.py``.
    """
    if start >= 0 and (stop is None or stop >= 0):
        if stop is not None:
            n = max(0, stop - start)
            df = df.limit(start + n)
        return df.offset(start) if start else df
    total = df.count()
    lo, hi, _ = slice(start, stop).indices(total)
    n = max(0, hi - lo)
    out = df.limit(lo + n)
    return out.offset(lo) if lo else out


def coerced_limits(col: str, default: int = DEFAULT_LOOKUP_LIMIT) -> Column:
    """A text column of limits as numbers: empty and NULL give NULL (no
    limit), texts that are no number give ``default`` (X12)."""
    text = F.trim(F.col(col).cast("string"))
    return F.when(text != "", F.coalesce(text.try_cast("int"), F.lit(default)))
