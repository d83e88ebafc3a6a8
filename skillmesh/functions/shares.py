"""Share arithmetic with the original's floating-point behaviour.

Shares are doubles ``f / t * 100`` rounded to two decimals the way Python's
``round(x, 2)`` does it: half-even on the *exact binary value* of ``x``
(``1 / 32 * 100`` is exactly 3.125 and becomes 3.12; ``2.675`` is stored
just below and becomes 2.67).  Spark's ``round``/``bround`` work on the
shortest decimal text of the double instead, so they differ on such values.

``py_round_hundredths`` gets the rounded value as an integer number of
hundredths.  ``y = x * 100`` in doubles is the nearest double to the exact
product, so it can only mislead when it lands exactly on a half-integer;
then the sign of the product's rounding error (computed exactly with
Dekker's error-free product, splitting ``x`` with the constant 2^27 + 1)
says which way the exact value lies, and an error of zero is a true tie,
rounded half to even.  ``N / 100.0`` is then the very double Python
returns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Veltkamp split constant for doubles: 2^27 + 1.
_SPLIT = 134217729.0


def py_round_hundredths(x: Column) -> Column:
    """``N`` (BIGINT) with ``round(x, 2) == N / 100`` in Python."""
    y = x * F.lit(100.0)
    c = x * F.lit(_SPLIT)
    hi = c - (c - x)
    lo = x - hi
    err = (hi * F.lit(100.0) - y) + lo * F.lit(100.0)
    low = F.floor(y)
    on_half = (y - low) == F.lit(0.5)
    return F.when(
        on_half,
        F.when(err > 0, low + 1).when(err < 0, low).otherwise(low + F.pmod(low, F.lit(2))),
    ).otherwise(F.rint(y).cast("long"))


def py_round2(x: Column) -> Column:
    """Python's ``round(x, 2)`` on a double column."""
    return py_round_hundredths(x) / F.lit(100.0)


def share_percent(freq, total) -> Column:
    """``round(freq / total * 100, 2)`` evaluated as the original did."""
    freq = F.col(freq) if isinstance(freq, str) else freq
    total = F.col(total) if isinstance(total, str) else total
    return py_round2(freq.cast("double") / total.cast("double") * F.lit(100.0))
