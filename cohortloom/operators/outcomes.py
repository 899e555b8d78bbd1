"""Outcome dates and flags around an index date."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortloom.functions.dates import after_birth_year
from cohortloom.operators.events import acceptable

TWELVE_MONTHS = 365


def event_days(events: DataFrame, date: str = "obsdate") -> DataFrame:
    """One row per patient and dated day; undated events are ignored.

    Combining on the map side bounds one patient's rows by the calendar,
    whatever their number of events.
    """
    return events.where(F.col(date).isNotNull()).select("patid", date).distinct()


def with_first_outcome(cohort: DataFrame, first: DataFrame, how: str = "left") -> DataFrame:
    """Add the first outcome date; ``how='inner'`` keeps outcome-positive members only."""
    if how not in ("left", "inner"):
        raise ValueError(f"how must be 'left' or 'inner', not {how!r}")
    return cohort.join(first.select("patid", "first_outcome"), "patid", how)


def outcome_before(df: DataFrame, index: str = "new_index_date", name: str = "outcome") -> DataFrame:
    """Add ``*_beforeindexdate``: the earliest outcome as text, if before the index."""
    first = F.col("first_outcome")
    return df.withColumn(
        f"{name}_beforeindexdate", F.when(first < F.col(index), F.date_format(first, "yyyy-MM-dd"))
    )


def outcome_after(
    cohort: DataFrame,
    events: DataFrame,
    index: str = "new_index_date",
    date: str = "obsdate",
    name: str = "outcome",
    censor: str | None = None,
) -> DataFrame:
    """Per member, the first outcome strictly after the index and whether any is on or after it.

    Events after the follow-up end count, unless ``censor`` names its column.
    """
    keys = ["patid", index] + ([censor] if censor else [])
    joined = cohort.select(*keys).join(event_days(events, date), "patid", "left")
    when, start = F.col(date), F.col(index)
    counted = F.lit(True) if censor is None else when <= F.col(censor)
    return joined.groupBy("patid", index).agg(
        F.min(F.when((when > start) & counted, when)).alias(f"{name}_afterindexdate"),
        F.max(F.when((when >= start) & counted, 1).otherwise(0)).alias("_on_or_after"),
    )


def outcome_flags(df: DataFrame, index: str = "new_index_date", name: str = "outcome") -> DataFrame:
    """Add the 0/1 flags: before the index, within 12 months after it, any time after it.

    An event on the index day alone sets only the last flag.
    """
    start, after = F.col(index), F.col(f"{name}_afterindexdate")

    def flag(test):
        return F.when(test, 1).otherwise(0)

    return (
        df.withColumn(f"{name}_beforeindex", flag(F.col("first_outcome") < start))
        .withColumn(f"{name}_in12monthsafterindex", flag(F.datediff(after, start) <= TWELVE_MONTHS))
        .withColumn(f"{name}_anyafterindex", flag(F.col("_on_or_after") == 1))
        .drop("_on_or_after")
    )


def outcome_table(
    cohort: DataFrame,
    patients: DataFrame,
    events: DataFrame,
    index: str = "new_index_date",
    date: str = "obsdate",
    name: str = "outcome",
    censor: str | None = None,
) -> DataFrame:
    """Cohort with first outcome, dates before and after the index, and flags.

    The steps above in one pass: the outcome events are read once, and the joins
    and the grouping share one partitioning by patient. The first outcome counts
    plausible events of acceptable patients, the others any dated event.
    """
    birth = acceptable(patients).select("patid", F.col("yob").alias("_yob"))
    joined = cohort.join(birth, "patid", "left").join(event_days(events, date), "patid", "left")
    when, start = F.col(date), F.col(index)
    counted = F.lit(True) if censor is None else when <= F.col(censor)
    found = joined.groupBy(*cohort.columns).agg(
        F.min(F.when(after_birth_year(when, F.col("_yob")), when)).alias("first_outcome"),
        F.min(F.when((when > start) & counted, when)).alias(f"{name}_afterindexdate"),
        F.max(F.when((when >= start) & counted, 1).otherwise(0)).alias("_on_or_after"),
    )
    return outcome_flags(outcome_before(found, index, name), index, name)
