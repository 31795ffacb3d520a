"""Dates as printed. An ambiguous date is never guessed, but where a reader's own policy says so."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats under which two printed values are compared.
FORMATS = [
    "dd-MM-yyyy", "dd/MM/yyyy", "dd.MM.yyyy", "yyyy-MM-dd", "dd-MMM-yyyy", "dd MMM yyyy", "dd-MM-yy", "dd/MM/yy", "MMMM d, yyyy", "MMM d, yyyy",
    "d MMMM yyyy", "d-MMMM-yyyy", "MMMM d yyyy",
]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def day(value: Column) -> Column:
    """The date that the first ten characters spell in ISO form."""
    return F.substring(value, 1, 10).try_cast("date")


def ambiguous(printed: Column) -> Column:
    """True for n/n/yyyy with two different parts of at most 12."""
    pattern = r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{2,4})$"
    own = F.trim(printed)
    a, b = (F.regexp_extract(own, pattern, i).try_cast("int") for i in (1, 2))
    return F.coalesce(own.rlike(pattern) & (a <= 12) & (b <= 12) & (a != b), F.lit(False))


def _month(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(F.lower(name), 1, 3))


def _date(year: Column, month: Column, day_of_month: Column) -> Column:
    return F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day_of_month.cast("int")).try_cast("date")


def _full_year(text: Column) -> Column:
    number = text.try_cast("int")
    return F.when(F.length(text) == 2, number + 2000).otherwise(number)


def parse(value: Column) -> Column:
    """d-Mon-y, ISO, or numeric where only one order of day and month is possible; else null."""
    own = F.trim(value)
    iso, named, numeric = r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{1,2})[\s/.-]+([A-Za-z]{3,9})[\s/.,-]+(\d{2}|\d{4})$", r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{2}|\d{4})$"
    a, b, year = F.regexp_extract(own, numeric, 1).try_cast("int"), F.regexp_extract(own, numeric, 2).try_cast("int"), _full_year(F.regexp_extract(own, numeric, 3))
    return (
        F.when(own.rlike(iso), _date(*(F.regexp_extract(own, iso, i) for i in (1, 2, 3))))
        .when(own.rlike(named), F.when(_month(F.regexp_extract(own, named, 2)) > 0, _date(_full_year(F.regexp_extract(own, named, 3)), _month(F.regexp_extract(own, named, 2)), F.regexp_extract(own, named, 1))))
        .when(own.rlike(numeric), F.when((a > 12) | (a == b), _date(year, b, a)).when(b > 12, _date(year, a, b)))
    )


def table_date(value: Column) -> Column:
    """A table reader's policy: ISO text as it is, dotted dates day first, then as ``parse``; as text."""
    own = F.trim(value)
    dotted = r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$"
    parts = [F.regexp_extract(own, dotted, i) for i in (3, 2, 1)]
    return F.when(own.rlike(r"^\d{4}-\d{2}-\d{2}$"), own).when(own.rlike(dotted), _date(*parts).cast("string")).otherwise(parse(own).cast("string"))


def long_date(value: Column) -> Column:
    """``March 3, 2031`` and the like."""
    pattern = r"^([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4})$"
    own = F.trim(value)
    month = _month(F.regexp_extract(own, pattern, 1))
    return F.when(own.rlike(pattern) & (month > 0), _date(F.regexp_extract(own, pattern, 3), month, F.regexp_extract(own, pattern, 2)))


def same_date(value: Column, printed: Column) -> Column:
    """True if the printed text spells the ISO date under any of the formats; ordinals count as plain days."""
    own = F.regexp_replace(F.trim(printed), r"(?i)\b(\d{1,2})(st|nd|rd|th)\b", "$1")
    wanted = value.try_cast("date")
    return F.coalesce(F.array_contains(F.array(*[F.try_to_timestamp(own, F.lit(f)).cast("date") for f in FORMATS]), wanted), F.lit(False))
