"""String predicates with Python's whitespace semantics.

Spark's ``trim`` removes spaces only; a "non-blank" test in the reference strips
every Unicode whitespace character, so these use a Unicode-aware regex.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WS = r"(?U)^\s+|\s+$"


def strip(col: Column) -> Column:
    return F.regexp_replace(col, _WS, "")


def is_blank(col: Column) -> Column:
    """True for null, '' and whitespace-only strings."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).rlike(r"(?U)^\s*$")


def _count(col: Column, pattern: str) -> Column:
    return F.length(col) - F.length(F.regexp_replace(col, pattern, ""))


def json_ascii_len(col: Column) -> Column:
    """Length of the string's JSON escape with non-ASCII escaped (no quotes).

    Quote, backslash and the five short control escapes take 2 characters, other
    control characters and non-ASCII BMP characters 6 (``\\uXXXX``), characters
    beyond the BMP 12 (a surrogate pair). Spark's ``length`` counts code points.
    """
    return (F.length(col)
            + _count(col, r'["\\\n\r\t\x{08}\x{0C}]')
            + 5 * _count(col, r"[\x{00}-\x{07}\x{0B}\x{0E}-\x{1F}\x{7F}]")
            + 5 * _count(col, r"[\x{80}-\x{FFFF}]")
            + 11 * _count(col, r"[\x{10000}-\x{10FFFF}]"))
