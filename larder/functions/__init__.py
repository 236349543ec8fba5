"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def filled(c: str | Column) -> Column:
    """Not null and not blank."""
    return col(c).isNotNull() & (F.trim(col(c).cast("string")) != "")


def blank_to_null(c: str | Column) -> Column:
    t = F.trim(col(c).cast("string"))
    return F.when(t != "", t)


def domain(url: str | Column) -> Column:
    """Host (and port) of a URL in lower case without a leading `www.`; null where there is none."""
    return F.regexp_replace(F.lower(F.try_parse_url(col(url), F.lit("AUTHORITY"))), r"^www\.", "")


def any_term(c: str | Column, terms: list[str]) -> Column:
    """Whether the text contains one of the terms, whatever the case."""
    escaped = "|".join(escape(t.lower()) for t in terms)
    return F.lower(col(c)).rlike(escaped) if terms else F.lit(False)


def escape(term: str) -> str:
    """The term as a pattern that matches it literally."""
    return "".join("\\" + ch if ch in r"\.[]{}()*+?^$|-" else ch for ch in term)


def share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def grade(score: Column, cuts: tuple[float, ...] = (90, 80, 70, 60)) -> Column:
    """A, B, C, D or F by falling cut-offs."""
    out = F.when(score >= cuts[0], "A")
    for cut, name in zip(cuts[1:], "BCD", strict=True):
        out = out.when(score >= cut, name)
    return out.otherwise("F")


def first_hit(pairs: list[tuple[Column, object]], default: object = None) -> Column:
    """Value of the first true condition."""
    out = F.when(pairs[0][0], pairs[0][1])
    for condition, value in pairs[1:]:
        out = out.when(condition, value)
    return out.otherwise(default)
