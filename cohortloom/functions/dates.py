"""Column expressions over dates; all stay inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, functions as F

DAYS_PER_YEAR = 365.25


def dob(yob: Column, mob: Column) -> Column:
    """First day of the birth month; a missing month counts as January.

    An impossible month or year gives NULL. The guard matters: ``make_date``
    raises on bad input under ANSI mode, and CASE evaluates it only if valid.
    """
    month = F.coalesce(mob, F.lit(1))
    valid = month.between(1, 12) & yob.between(1, 9999)
    return F.when(valid, F.make_date(yob, month, F.lit(1)))


def after_birth_year(when: Column, yob: Column) -> Column:
    """An event is plausible only in a calendar year after the birth year."""
    return F.year(when) > yob


def has_age(when: Column, born: Column, years: float) -> Column:
    return F.datediff(when, born) >= F.lit(years * DAYS_PER_YEAR)


def age_years(born: Column, as_of: date | Column) -> Column:
    at = F.lit(as_of) if isinstance(as_of, date) else as_of
    return F.datediff(at, born) / F.lit(DAYS_PER_YEAR)


def earliest(dates: Iterable[Column], study_end: date) -> Column:
    """Row minimum of ``dates`` and ``study_end``; a missing date counts as study end."""
    end = F.lit(study_end)
    return F.least(end, *[F.coalesce(d, end) for d in dates])
