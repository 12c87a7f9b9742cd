"""Dates in text: three notations, calendar checks, labelled dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .matching import and_then, capture, find_all, first, group, typed


def year_of(text: Column) -> Column:
    y = text.try_cast("int")
    return F.when(y <= 50, y + 2000).when(y <= 99, y + 1900).otherwise(y)


def month_of(name: Column) -> Column:
    """Number of a month in the genitive, 0 for other words."""
    return F.greatest(F.lit(0), F.array_position(F.array(*map(F.lit, P.MONTHS)), name).cast("int"))


def calendar(y: Column, m: Column, d: Column) -> Column:
    """The date, or null when the calendar has no such day."""
    return F.format_string("%04d-%02d-%02d", y, m, d).try_cast("date")


def dates(text: Column) -> Column:
    """All of day-month-year, then new year-month-day, then new long dates, in the order of the notations."""
    number = lambda h, i: group(h, i).try_cast("int")
    dmy = typed(find_all(text, P.DATE_DMY, 3), lambda h: calendar(year_of(group(h, 3)), number(h, 2), number(h, 1)), 0.9)
    ymd = typed(find_all(text, P.DATE_YMD, 3), lambda h: calendar(number(h, 1), number(h, 2), number(h, 3)), 0.9)
    long = typed(find_all(text, P.DATE_LONG, 3), lambda h: calendar(number(h, 3), month_of(group(h, 2)), number(h, 1)), 0.95)
    return and_then(and_then(dmy, ymd), long)


def iso_date(text: Column) -> Column:
    """The first date of a text as yyyy-MM-dd."""
    return F.date_format(first(dates(text)), "yyyy-MM-dd")


def labelled(text: Column) -> dict[str, Column]:
    """issue, sale and due date behind their labels; the issue date falls back on the first date of the text."""
    at = lambda p: first(dates(capture(text, p)))
    return {"issue_date": F.coalesce(at(P.ISSUE_DATE), first(dates(text))), "sale_date": at(P.SALE_DATE), "due_date": at(P.DUE_DATE)}
