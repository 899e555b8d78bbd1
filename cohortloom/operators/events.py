"""Coded events and first events per patient."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortloom.functions.dates import after_birth_year
from cohortloom.operators.joins import lookup_join


#: Codes of a set up to which they go to the reader of the events as a filter.
PUSHED_CODES = 5_000


def coded_events(events: DataFrame, codes: DataFrame, on: str, category: bool = False) -> DataFrame:
    """Events whose code is in the set, optionally with the set's category.

    The codes of a set of at most ``PUSHED_CODES`` become a filter that Parquet readers
    are given: over events stored by ``by_code``, row groups without a wanted code are not
    read. Larger sets meet the events in a join after a size check.
    """
    wanted = codes.select(F.col("code").alias(on), *(["category"] if category else []))
    listed = [r[0] for r in wanted.where(F.col(on).isNotNull()).select(on).distinct().limit(PUSHED_CODES + 1).collect()]
    few = len(listed) <= PUSHED_CODES
    found = events.where(F.col(on).isin(listed)) if few else events
    if category:
        found = lookup_join(found, wanted.dropDuplicates([on]), on, "inner")
    elif not few:
        found = lookup_join(found, wanted, on, "left_semi")
    return found.select(*events.columns, *(["category"] if category else []))


def by_code(events: DataFrame, path: str, on: str, files: int = 200, row_group_bytes: int = 16 << 20) -> DataFrame:
    """Events stored in the order of their code, then patient, so that files and row groups hold few codes each.

    A hot code spans many files: patients part its rows.
    """
    (
        events.repartitionByRange(files, on, "patid").sortWithinPartitions(on, "patid")
        .write.option("parquet.block.size", row_group_bytes).parquet(path)
    )
    return events.sparkSession.read.schema(events.schema).parquet(path)


def acceptable(patients: DataFrame) -> DataFrame:
    return patients.where(F.col("acceptable") != 0)


def has_date(events: DataFrame, date: str) -> DataFrame:
    return events.where(F.col(date).isNotNull())


def plausible(df: DataFrame, date: str, yob: str = "yob") -> DataFrame:
    return df.where(after_birth_year(F.col(date), F.col(yob)))


def patient_events(patients: DataFrame, events: DataFrame) -> DataFrame:
    """Events with their patient's attributes, one row per event.

    The key is the patient alone; where both sides have a column, the patient's
    is kept. A patient with very many events is split by adaptive skew join.
    """
    clash = [c for c in events.columns if c in patients.columns and c != "patid"]
    return patients.join(events.drop(*clash), "patid")


def yearly_first(events: DataFrame, date: str) -> DataFrame:
    """Earliest event per patient and calendar year; undated events form a year of their own.

    Combined on the map side: however many events one patient has, later joins
    see at most one row per year.
    """
    return events.groupBy("patid", F.year(date).alias("event_year")).agg(
        F.min(date).alias("event_date"), F.lit(True).alias("any_event")
    )


def first_event(
    patients: DataFrame,
    events: DataFrame,
    date: str,
    keys: list[str],
    name: str,
    check_dates: bool = True,
) -> DataFrame:
    """Earliest event date of each acceptable patient.

    Events shrink to one row per patient and year before they meet the patients.
    The earliest date whose year passes the birth-year test is the earliest of
    those years' minima, so this is exact. ``check_dates=False`` leaves out the
    date tests, as the first draft did.
    """
    yearly = yearly_first(has_date(events, date) if check_dates else events, date)
    wanted = ["acceptable", "yob", *(c for c in keys if c != "yob")]
    joined = acceptable(patients).select(*wanted).join(yearly, "patid")
    if check_dates:
        joined = joined.where(F.col("event_year") > F.col("yob"))
    return joined.groupBy(*keys).agg(F.min("event_date").alias(name))


def distinct_patients(df: DataFrame) -> DataFrame:
    return df.select("patid").distinct()


def count_patients(df: DataFrame, name: str = "patients") -> DataFrame:
    """Exact number of patients, as one row."""
    return df.agg(F.countDistinct("patid").alias(name))


def patient_sample(df: DataFrame, key: str, fraction: float, salt: int = 0) -> DataFrame:
    """Development subset that keeps the same patients in every table.

    The test is a hash of the key alone, so it needs no join between tables and
    gives the same rows on every run.
    """
    slots = 1_000_000
    slot = F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(slots))
    return df.where(slot < F.lit(round(fraction * slots)))


def patient_modulus(df: DataFrame, key: str, divisor: int, remainder: int = 0) -> DataFrame:
    """The same kind of subset by remainder of a numeric key."""
    return df.where(F.pmod(F.col(key), F.lit(divisor)) == remainder)
