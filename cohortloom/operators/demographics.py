"""Date of birth, age and follow-up."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from cohortloom.functions import dates as D


def with_dob(df: DataFrame, yob: str = "yob", mob: str = "mob") -> DataFrame:
    return df.withColumn("dob", D.dob(F.col(yob), F.col(mob)))


def min_age_at(df: DataFrame, when: str, years: float, dob: str = "dob") -> DataFrame:
    return df.where(D.has_age(F.col(when), F.col(dob), years))


def reached_age(
    df: DataFrame,
    study_end: date,
    years: float,
    leaving: tuple[str, ...] = ("regenddate", "emis_ddate"),
    null_dates: str = "study_end",
    dob: str = "dob",
) -> DataFrame:
    """Patients who reached the age before the study end and before every leaving date.

    A missing leaving date counts as study end, or drops the patient with
    ``null_dates='drop'``.
    """
    if null_dates not in ("study_end", "drop"):
        raise ValueError(f"null_dates must be 'study_end' or 'drop', not {null_dates!r}")
    born, end = F.col(dob), F.lit(study_end)
    kept = D.has_age(end, born, years)
    for column in leaving:
        left = F.col(column) if null_dates == "drop" else F.coalesce(F.col(column), end)
        kept = kept & D.has_age(left, born, years)
    return df.where(kept)


def follow_up_end(
    df: DataFrame,
    study_end: date,
    columns: tuple[str, ...] = ("regenddate", "emis_ddate", "lcd"),
) -> DataFrame:
    """Add ``end_date``: the earliest of leaving, death, last collection and study end."""
    return df.withColumn("end_date", D.earliest([F.col(c) for c in columns], study_end))


def with_age(df: DataFrame, as_of: date, dob: str = "dob") -> DataFrame:
    return df.withColumn("age", D.age_years(F.col(dob), as_of))


def age_by_year(df: DataFrame, as_of_year: int, years: int, yob: str = "yob") -> DataFrame:
    """Draft age rule on calendar years; the year is a parameter, not the clock."""
    return df.where(F.lit(as_of_year) - F.col(yob) >= years)


def recode(df: DataFrame, column: str, mapping: dict, default) -> DataFrame:
    """Replace values by the mapping, everything else (NULL too) by ``default``."""
    if not mapping:
        return df.withColumn(column, F.lit(default))
    coded = None
    for old, new in mapping.items():
        test = F.col(column) == F.lit(old)
        coded = F.when(test, F.lit(new)) if coded is None else coded.when(test, F.lit(new))
    return df.withColumn(column, coded.otherwise(F.lit(default)))
