"""Selecting, combining and counting cohorts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from cohortloom.operators.joins import lookup_join


def ordered_before(df: DataFrame, earlier: str, later: str) -> DataFrame:
    """Rows whose first date is on or before the second."""
    return df.where(F.col(earlier) <= F.col(later))


def with_practice(df: DataFrame, practices: DataFrame) -> DataFrame:
    return lookup_join(df, practices.select("pracid", "lcd"), "pracid")


def never_exposed(df: DataFrame, exposures: DataFrame) -> DataFrame:
    """Patients without any coded prescription, dated or not.

    Prescriptions are reduced to patients first, so a patient with very many of
    them takes one row in the join.
    """
    return df.join(exposures.select("patid").distinct(), "patid", "left_anti")


def cohort_complement(everyone: DataFrame, members: DataFrame) -> DataFrame:
    return never_exposed(everyone, members)


def patients_in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("patid").distinct().join(b.select("patid").distinct(), "patid", "left_semi")


def with_arm(df: DataFrame, exposed: bool) -> DataFrame:
    return df.withColumn("case_control", F.lit(exposed))


def combine_arms(cases: DataFrame, controls: DataFrame) -> DataFrame:
    """Set union: a row identical in both arms appears once."""
    return cases.unionByName(controls).distinct()


def matching_input(
    cohort: DataFrame, index: str | None = None, placeholder: date | None = None
) -> DataFrame:
    """Columns for matching; without an index column the placeholder (or NULL) stands in."""
    index_date = F.col(index) if index else F.lit(placeholder).cast("date")
    return cohort.select(
        "patid",
        index_date.alias("index_date"),
        "end_date",
        "age",
        F.col("gender").alias("sex"),
        "case_control",
    )


def positive_follow_up(df: DataFrame, end: str = "end_date", index: str = "new_index_date") -> DataFrame:
    return df.where(F.col(end) > F.col(index))


def row_count(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def attrition(steps: list[tuple[str, DataFrame]]) -> DataFrame:
    """One row per selection step with its number of patients.

    All steps are counted by one grouping over rows tagged with their step. A
    row without a patient stands for each step, so that an empty one shows zero.
    """
    spark = steps[0][1].sparkSession
    tagged = spark.range(1, len(steps) + 1).select(
        F.col("id").cast("int").alias("step_no"), F.lit(None).cast("bigint").alias("patid")
    )
    for number, (_, df) in enumerate(steps, start=1):
        tagged = tagged.unionByName(df.select(F.lit(number).alias("step_no"), "patid"))
    names = F.array(*[F.lit(name) for name, _ in steps])
    return tagged.groupBy("step_no").agg(F.countDistinct("patid").alias("patients")).select(
        "step_no", F.element_at(names, F.col("step_no")).alias("step"), "patients"
    )
