"""Small helpers shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

WHITESPACE = " \t\n\r\x0b\f"


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: ColumnOrName) -> Column:
    """Trim every kind of ASCII white space, not only blanks."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def rstrip(c: ColumnOrName) -> Column:
    return F.rtrim(col(c), F.lit(WHITESPACE))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside a lambda, where Spark does no common-subexpression elimination."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_boundary(pattern: str) -> str:
    """Make ``\\b`` an ASCII word boundary, whatever the Java version does by default."""
    return pattern.replace(r"\b", r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))")


def quote_regex(c: ColumnOrName) -> Column:
    """Escape a column so that it matches literally inside a regular expression."""
    return F.regexp_replace(col(c), r"([.*+?^${}()|\[\]\\])", r"\\$1")


def words(c: ColumnOrName) -> Column:
    return F.filter(F.split(col(c), r"\s+"), lambda w: w != "")


def first_words(c: ColumnOrName, n: int, skip: int = 0) -> Column:
    """Words ``skip + 1`` to ``skip + n``, joined by blanks; the rest of the text is not split."""
    head = F.split(F.ltrim(col(c), F.lit(WHITESPACE)), r"\s+", skip + n + 1)
    return F.array_join(F.filter(F.slice(head, skip + 1, n), lambda w: w != ""), " ")


def last_locate(needle: str, haystack: Column) -> Column:
    """Zero-based position of the last ``needle``; -1 when absent."""
    hit = F.locate(needle[::-1], F.reverse(haystack))
    return F.when(hit == 0, F.lit(-1)).otherwise(F.length(haystack) - hit - len(needle) + 1)
