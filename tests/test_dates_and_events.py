"""Date rules and first events on hand-written rows."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from cohortloom.operators import cohort as C, demographics as G, events as E

D = date


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


PATIENT = (
    "patid bigint, pracid int, acceptable int, gender int, yob int, mob int, "
    "regenddate date, emis_ddate date"
)
KEYS = ["patid", "pracid", "regenddate", "emis_ddate", "yob", "mob", "gender"]


def patient(patid, acceptable=1, yob=1930, mob=None, pracid=1):
    return (patid, pracid, acceptable, 1, yob, mob, None, None)


def test_patient_practice_is_kept_and_is_not_a_key(spark):
    patients = table(spark, [patient(1, pracid=7)], PATIENT)
    events = table(spark, [(1, 7, D(2000, 1, 1)), (1, 8, D(2001, 1, 1))], "patid bigint, pracid int, obsdate date")
    got = E.patient_events(patients, events)
    assert values(got, "pracid", "obsdate") == [(7, D(2000, 1, 1)), (7, D(2001, 1, 1))]


def test_acceptable_drops_zero_and_null(spark):
    patients = table(spark, [patient(1, 0), patient(2, 1), patient(3, None)], PATIENT)
    assert values(E.acceptable(patients), "patid") == [(2,)]


def test_first_event_ignores_birth_year_earlier_and_null_dates(spark):
    patients = table(spark, [patient(1, yob=1950), patient(2, yob=1950), patient(3, acceptable=0)], PATIENT)
    events = table(
        spark,
        [
            (1, D(1949, 5, 1)), (1, D(1950, 12, 31)), (1, D(1951, 3, 2)), (1, D(1951, 1, 1)),
            (1, D(1999, 1, 1)), (1, None), (2, None), (2, D(1950, 6, 6)), (3, D(1990, 1, 1)),
        ],
        "patid bigint, obsdate date",
    )
    got = E.first_event(patients, events, "obsdate", KEYS, "first")
    assert values(got, "patid", "first") == [(1, D(1951, 1, 1))]
    draft = E.first_event(patients, events, "obsdate", ["patid"], "first", check_dates=False)
    assert values(draft, "patid", "first") == [(1, D(1949, 5, 1)), (2, D(1950, 6, 6))]


def test_plausible_is_strict_on_years(spark):
    df = table(spark, [(1950, D(1950, 12, 31)), (1950, D(1951, 1, 1)), (1950, None)], "yob int, obsdate date")
    assert values(E.plausible(df, "obsdate"), "obsdate") == [(D(1951, 1, 1),)]
    assert E.has_date(df, "obsdate").count() == 2


def test_date_of_birth(spark):
    rows = [(None,), (1,), (9,), (10,), (12,), (13,), (0,)]
    df = table(spark, rows, "mob int").withColumn("yob", F.lit(1940))
    got = {r.mob: r.dob for r in G.with_dob(df).collect()}
    assert got == {
        None: D(1940, 1, 1), 1: D(1940, 1, 1), 9: D(1940, 9, 1), 10: D(1940, 10, 1),
        12: D(1940, 12, 1), 13: None, 0: None,
    }
    no_year = table(spark, [(None, 5), (0, 5)], "yob int, mob int")
    assert [r.dob for r in G.with_dob(no_year).collect()] == [None, None]


def test_age_threshold_in_days(spark):
    end = D(2021, 6, 1)
    rows = [(n, end - timedelta(days=n), end) for n in (23_741, 23_742)]
    df = table(spark, rows, "n int, dob date, seen date")
    assert values(G.min_age_at(df, "seen", 65), "n") == [(23_742,)]
    # 1956-06-01 to 2021-06-01 is 23,741 days.
    assert table(spark, [(D(1956, 6, 1), end)], "dob date, seen date").select(
        F.datediff("seen", "dob")
    ).first()[0] == 23_741


def test_reached_age_with_missing_dates(spark):
    rows = [
        (1, D(1930, 1, 1), None, None),
        (2, D(1930, 1, 1), D(1980, 1, 1), None),
        (3, D(1930, 1, 1), D(2000, 1, 1), None),
        (4, D(1930, 1, 1), D(2000, 1, 1), D(2001, 1, 1)),
        (5, D(1990, 1, 1), None, None),
    ]
    df = table(spark, rows, "patid int, dob date, regenddate date, emis_ddate date")
    end = D(2021, 6, 1)
    assert values(G.reached_age(df, end, 65), "patid") == [(1,), (3,), (4,)]
    assert values(G.reached_age(df, end, 65, null_dates="drop"), "patid") == [(4,)]
    with pytest.raises(ValueError):
        G.reached_age(df, end, 65, null_dates="other")


def test_follow_up_end_takes_the_earliest_known_date(spark):
    a, b, c, end = D(2019, 1, 1), D(2019, 2, 1), D(2019, 3, 1), D(2021, 6, 1)
    rows = [(1, a, b, c), (2, None, b, c), (3, None, None, c), (4, None, None, None), (5, c, b, a), (6, c, a, None)]
    df = table(spark, rows, "patid int, regenddate date, emis_ddate date, lcd date")
    got = dict(values(G.follow_up_end(df, end), "patid", "end_date"))
    assert got == {1: a, 2: b, 3: c, 4: end, 5: a, 6: a}


def test_age_rules(spark):
    df = table(spark, [(1, D(1956, 6, 1), 1956)], "patid int, dob date, yob int")
    assert G.with_age(df, D(2021, 6, 1)).first()["age"] == pytest.approx(23_741 / 365.25)
    assert G.age_by_year(df, 2021, 65).count() == 1
    assert G.age_by_year(df, 2020, 65).count() == 0


def test_exposure_on_the_diagnosis_day_counts(spark):
    day = D(2000, 5, 5)
    rows = [(1, day, day), (2, day - timedelta(1), day), (3, day + timedelta(1), day)]
    df = table(spark, rows, "patid int, first_obsdate date, first_exposure date")
    assert values(C.ordered_before(df, "first_obsdate", "first_exposure"), "patid") == [(1,), (2,)]


def test_undated_prescription_still_means_exposed(spark):
    people = table(spark, [(1,), (2,)], "patid bigint")
    issues = table(spark, [(1, None), (1, None)], "patid bigint, issuedate date")
    assert values(C.never_exposed(people, issues), "patid") == [(2,)]


def test_union_of_arms_is_a_set(spark):
    rows = [(1, True), (2, False)]
    a = table(spark, rows, "patid int, case_control boolean")
    assert C.combine_arms(a, a).count() == 2


def test_follow_up_must_go_beyond_the_index_in_both_arms(spark):
    i = D(2000, 1, 1)
    rows = [(n, arm, i + timedelta(n), i) for n in (-1, 0, 1) for arm in (True, False)]
    df = table(spark, rows, "n int, case_control boolean, end_date date, new_index_date date")
    assert values(C.positive_follow_up(df), "n", "case_control") == [(1, False), (1, True)]


def test_recode(spark):
    df = table(spark, [(1,), (2,), (None,)], "sex int")
    assert [r.sex for r in G.recode(df, "sex", {1: 0}, 1).collect()] == [0, 1, 1]


def test_a_code_listed_twice_does_not_double_events(spark):
    events = table(spark, [(1, "a"), (2, "b")], "patid int, medcodeid string")
    codes = table(spark, [("a", "x"), ("a", "y")], "code string, category string")
    assert E.coded_events(events, codes, "medcodeid").count() == 1
    assert E.coded_events(events, codes, "medcodeid", category=True).count() == 1


def test_sample_keeps_the_same_patients_in_every_table(spark):
    ids = spark.range(2000).withColumnRenamed("id", "patid")
    events = ids.union(ids)
    some = {r.patid for r in E.patient_sample(ids, "patid", 0.25).collect()}
    assert {r.patid for r in E.patient_sample(events, "patid", 0.25).collect()} == some
    assert 400 < len(some) < 600
    assert {r.patid for r in E.patient_sample(ids, "patid", 0.25, salt=1).collect()} != some


def test_counts_and_attrition(spark):
    df = table(spark, [(1,), (1,), (2,)], "patid bigint")
    assert E.count_patients(df).first()["patients"] == 2
    assert C.row_count(df).first()["n"] == 3
    steps = C.attrition([("all", df), ("some", df.where("patid = 1"))])
    assert values(steps, "step_no", "step", "patients") == [(1, "all", 2), (2, "some", 1)]
