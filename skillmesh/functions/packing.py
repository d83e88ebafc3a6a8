"""A best match as one number, so that a hash aggregate can take the maximum.

A struct or text as aggregate value makes Spark sort its input; a number of
fixed width is updated in place.  The code holds, from its highest bits on, the score as
an order-preserving integer (exponent, then the 52 bits of the mantissa) and the
keyword's positions from the end, so that a greater code is a higher score or,
on equal scores, an earlier profession, then an earlier keyword.  Decoding
gives the same double back.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scores from 2**-SCALE up to 2 are exact; a match scores far more than the least of them.
SCALE = 40
_POSITIONS = 2**62
_MANTISSA = 2**52


def keyword_id(prof_pos: str = "prof_pos", kw_pos: str = "kw_pos") -> Column:
    """Both positions as one long; earlier ones are less."""
    return F.col(prof_pos).cast("long") * F.lit(2**31) + F.col(kw_pos)


def match_code(score: str, kid: str) -> Column:
    """The code of a score above zero and a ``keyword_id``."""
    scaled = f"{score} * {float(2**SCALE)!r}D"
    exponent = f"(length(bin(CAST(floor({scaled}) AS BIGINT))) - 1)"
    mantissa = f"({scaled} / CAST(shiftleft(1L, {exponent}) AS DOUBLE) - 1D) * {float(_MANTISSA)!r}D"
    bits = f"CAST({exponent} AS BIGINT) * {_MANTISSA}L + CAST({mantissa} AS BIGINT)"
    return F.expr(f"CAST(CAST({bits} AS DECIMAL(19, 0)) * {_POSITIONS}BD + CAST({_POSITIONS - 1}L - {kid} AS DECIMAL(19, 0)) AS DECIMAL(38, 0))")


def kid_of(code: str) -> Column:
    """The ``keyword_id`` in a code."""
    return F.expr(f"{_POSITIONS - 1}L - CAST({code} % {_POSITIONS}BD AS BIGINT)")


def score_of(code: str) -> Column:
    """The score in a code, the same double."""
    bits = f"({code} div {_POSITIONS}BD)"
    mantissa = f"(1D + CAST({bits} & {_MANTISSA - 1}L AS DOUBLE) / {float(_MANTISSA)!r}D)"
    power = f"CAST(shiftleft(1L, CAST(shiftright({bits}, 52) AS INT)) AS DOUBLE)"
    return F.expr(f"{mantissa} * {power} / {float(2**SCALE)!r}D")
