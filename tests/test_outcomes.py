"""Outcome dates and flags around the index day."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from cohortloom.operators import outcomes as O

INDEX = date(2000, 1, 10)


def day(n):
    return INDEX + timedelta(days=n)


def result(spark, offsets_by_patient, **options):
    cohort = spark.createDataFrame(
        [(p, INDEX, day(400)) for p in offsets_by_patient], "patid bigint, new_index_date date, end_date date"
    )
    rows = [
        (p, None if n is None else day(n)) for p, offsets in offsets_by_patient.items() for n in offsets
    ]
    events = spark.createDataFrame(rows, "patid bigint, obsdate date")
    patients = cohort.selectExpr("patid", "1 AS acceptable", "1930 AS yob")
    table = O.outcome_table(cohort, patients, events, **options)
    first = events.groupBy("patid").agg(F.min("obsdate").alias("first_outcome"))
    after = O.outcome_after(cohort, events, **options)
    stepwise = O.outcome_flags(
        O.outcome_before(O.with_first_outcome(cohort, first)).join(after, ["patid", "new_index_date"])
    )
    assert sorted(map(str, table.select(sorted(table.columns)).collect())) == sorted(
        map(str, stepwise.select(sorted(stepwise.columns)).collect())
    )
    return {
        r.patid: (
            r.outcome_beforeindexdate, r.outcome_afterindexdate, r.outcome_beforeindex,
            r.outcome_in12monthsafterindex, r.outcome_anyafterindex,
        )
        for r in table.collect()
    }


def test_events_before_on_and_after_the_index(spark):
    got = result(spark, {
        1: [-5], 2: [0], 3: [5], 4: [None], 5: [None, 7], 6: [], 7: [-5, 0, 9], 8: [-3, 0],
    })
    assert got == {
        1: ("2000-01-05", None, 1, 0, 0),
        2: (None, None, 0, 0, 1),
        3: (None, day(5), 0, 1, 1),
        4: (None, None, 0, 0, 0),
        5: (None, day(7), 0, 1, 1),
        6: (None, None, 0, 0, 0),
        7: ("2000-01-05", day(9), 1, 1, 1),
        8: ("2000-01-07", None, 1, 0, 1),
    }


def test_twelve_months_are_365_days(spark):
    got = result(spark, {1: [365], 2: [366], 3: [366, 365]})
    assert {p: r[3] for p, r in got.items()} == {1: 1, 2: 0, 3: 1}


def test_censoring_is_optional(spark):
    assert result(spark, {1: [401]})[1][1] == day(401)
    assert result(spark, {1: [401], 2: [400]}, censor="end_date") == {
        1: (None, None, 0, 0, 0), 2: (None, day(400), 0, 0, 1),
    }


def test_outcome_positive_members(spark):
    cohort = spark.createDataFrame([(1,), (2,)], "patid bigint")
    first = spark.createDataFrame([(2, INDEX)], "patid bigint, first_outcome date")
    assert [r.patid for r in O.with_first_outcome(cohort, first, "inner").collect()] == [2]
    assert O.with_first_outcome(cohort, first).count() == 2


def test_first_outcome_needs_an_acceptable_patient_and_a_plausible_year(spark):
    cohort = spark.createDataFrame([(1, INDEX), (2, INDEX), (3, INDEX)], "patid bigint, new_index_date date")
    patients = spark.createDataFrame(
        [(1, 1, 2000), (2, 0, 1930), (3, 1, 1930)], "patid bigint, acceptable int, yob int"
    )
    events = spark.createDataFrame([(p, day(3)) for p in (1, 2, 3)], "patid bigint, obsdate date")
    got = {r.patid: (r.first_outcome, r.outcome_afterindexdate) for r in O.outcome_table(cohort, patients, events).collect()}
    assert got == {1: (None, day(3)), 2: (None, day(3)), 3: (day(3), day(3))}
