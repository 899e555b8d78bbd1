"""The study from coded events to summary tables.

Every step takes and returns DataFrames. Events come in already restricted to
their code sets: that is the step that reads the large tables, and it is done
once per code set however many cohorts use the result.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, functions as F

from cohortloom.functions import dates as D
from cohortloom.operators import cohort as C, demographics as G, events as E, summary as S
from cohortloom.operators.matching import assign_index, match_nearest, matched_members
from cohortloom.operators.outcomes import outcome_table
from cohortloom.operators.propensity import propensity_score
from cohortloom.session import stage
from cohortloom.sources.workspace import Workspace

# Fixed value: placeholder index date of a control before matching.
NO_INDEX = date(1900, 1, 1)

PATIENT_KEYS = ["patid", "pracid", "regenddate", "emis_ddate", "yob", "mob", "gender"]


@dataclass(frozen=True)
class Rules:
    study_end: date = date(2021, 6, 1)
    min_age: float = 65
    ratio: int = 10


def first_condition(patients: DataFrame, condition_events: DataFrame) -> DataFrame:
    return E.first_event(patients, condition_events, "obsdate", PATIENT_KEYS, "first_obsdate")


def first_exposure(patients: DataFrame, exposure_events: DataFrame) -> DataFrame:
    return E.first_event(patients, exposure_events, "issuedate", ["patid"], "first_exposure")


def first_outcome(patients: DataFrame, outcome_events: DataFrame) -> DataFrame:
    return E.first_event(patients, outcome_events, "obsdate", ["patid"], "first_outcome")


def _finish(df: DataFrame, practices: DataFrame, rules: Rules, exposed: bool) -> DataFrame:
    ended = G.follow_up_end(C.with_practice(df, practices), rules.study_end)
    return C.with_arm(G.with_age(ended, rules.study_end), exposed)


def case_cohort(
    diagnosed: DataFrame, exposed: DataFrame, practices: DataFrame, rules: Rules
) -> DataFrame:
    """Patients exposed at the minimum age or later, on or after their first diagnosis."""
    joined = G.with_dob(diagnosed.join(exposed, "patid"))
    ordered = C.ordered_before(joined, "first_obsdate", "first_exposure")
    return _finish(
        G.min_age_at(ordered, "first_exposure", rules.min_age), practices, rules, exposed=True
    )


def reached_age(diagnosed: DataFrame, rules: Rules) -> DataFrame:
    return G.reached_age(G.with_dob(diagnosed), rules.study_end, rules.min_age)


def control_cohort(
    diagnosed: DataFrame, exposure_events: DataFrame, practices: DataFrame, rules: Rules
) -> DataFrame:
    """Diagnosed patients who reached the age and were never prescribed the drug."""
    never = C.never_exposed(reached_age(diagnosed, rules), exposure_events)
    return _finish(never, practices, rules, exposed=False)


def combined_arms(cases: DataFrame, controls: DataFrame) -> DataFrame:
    """Matching input from two cohorts built separately."""
    return C.combine_arms(
        C.matching_input(cases, "first_exposure"),
        C.matching_input(controls, placeholder=NO_INDEX),
    )


def judged(
    patients: DataFrame, condition_events: DataFrame, exposure_events: DataFrame, rules: Rules
) -> DataFrame:
    """Each diagnosed patient once, with flags ``is_case``, ``reached`` (the age) and ``never`` (exposed)."""
    diagnosed = first_condition(patients, condition_events)
    # All prescriptions count against a control, dated and plausible or not.
    yearly = E.yearly_first(exposure_events, "issuedate")
    known = diagnosed.join(yearly, "patid", "left").groupBy(*PATIENT_KEYS, "first_obsdate").agg(
        F.min(F.when(F.col("event_year") > F.col("yob"), F.col("event_date"))).alias("first_exposure"),
        F.count(F.col("any_event")).alias("_prescribed_years"),
    )
    born = G.with_dob(known)
    end = F.lit(rules.study_end)
    is_case = (F.col("first_obsdate") <= F.col("first_exposure")) & D.has_age(
        F.col("first_exposure"), F.col("dob"), rules.min_age
    )
    reached = D.has_age(end, F.col("dob"), rules.min_age)
    for column in ("regenddate", "emis_ddate"):
        reached = reached & D.has_age(F.coalesce(F.col(column), end), F.col("dob"), rules.min_age)
    return born.select(
        "*",
        F.coalesce(is_case, F.lit(False)).alias("is_case"),
        F.coalesce(reached, F.lit(False)).alias("reached"),
        (F.col("_prescribed_years") == 0).alias("never"),
    ).drop("_prescribed_years")


def attrition(
    patients: DataFrame,
    practices: DataFrame,
    observations: DataFrame,
    condition_events: DataFrame,
    exposure_events: DataFrame,
    rules: Rules,
) -> DataFrame:
    """Patients left after each selection step: ``step_no, step, patients``.

    The steps after the diagnosis are flags of one pass over the diagnosed
    patients, counted by one grouping.
    """
    known = practices.select("pracid", F.lit(True).alias("_known"))
    diagnosed = judged(patients, condition_events, exposure_events, rules).join(known, "pracid", "left")
    listed = F.coalesce(F.col("_known"), F.lit(False))
    control = F.col("reached") & F.col("never")
    flags = [
        ("acceptable, dated, after birth year", F.lit(True)),
        ("exposed after it and at the age", F.col("is_case")),
        ("exposed cohort", F.col("is_case") & listed),
        ("reached the age", F.col("reached")),
        ("never exposed", control),
        ("control pool", control & listed),
    ]
    early = [("patients", patients), ("with any event", observations), ("with a condition code", condition_events)]
    counted = None
    for number, (name, df) in enumerate(early, start=1):
        one = df.agg(F.countDistinct("patid").alias("patients")).select(
            F.lit(number).alias("step_no"), F.lit(name).alias("step"), "patients"
        )
        counted = one if counted is None else counted.unionByName(one)
    sums = diagnosed.agg(*[F.count_if(test).alias(f"_{k}") for k, (_, test) in enumerate(flags)])
    rows = F.array(*[
        F.struct(F.lit(k + 1 + len(early)).alias("step_no"), F.lit(name).alias("step"), F.col(f"_{k}").alias("patients"))
        for k, (name, _) in enumerate(flags)
    ])
    return counted.unionByName(sums.select(F.inline(rows)))


def study_arms(
    patients: DataFrame,
    practices: DataFrame,
    condition_events: DataFrame,
    exposure_events: DataFrame,
    rules: Rules,
) -> DataFrame:
    """Matching input for both arms in one pass.

    The same rows as ``combined_arms`` of the two cohorts, but each event table
    is read once. Events are shuffled twice, first by patient and year, then, at
    most one row per year, by patient. A patient is in one arm at most, so no
    de-duplication is needed.
    """
    armed = judged(patients, condition_events, exposure_events, rules).withColumn(
        "case_control",
        F.when(F.col("is_case"), F.lit(True)).when(F.col("reached") & F.col("never"), F.lit(False)),
    ).where(F.col("case_control").isNotNull())
    ended = G.follow_up_end(C.with_practice(armed, practices), rules.study_end)
    return G.with_age(ended, rules.study_end).select(
        "patid",
        F.when(F.col("case_control"), F.col("first_exposure")).otherwise(F.lit(NO_INDEX)).alias("index_date"),
        "end_date",
        "age",
        F.col("gender").alias("sex"),
        "case_control",
    )


def scored_arms(arms: DataFrame, recode_sex: bool = True) -> DataFrame:
    """Arms with a propensity score on age and sex, stored for the steps that follow."""
    stored = stage(arms, "arms")
    recoded = G.recode(stored, "sex", {1: 0}, 1) if recode_sex else stored
    return propensity_score(recoded, "case_control", ["age", "sex"])


def match_arms(scored: DataFrame, ratio: int, **options) -> DataFrame:
    """Matched members in long form."""
    matches = match_nearest(scored, "case_control", "distance", ratio, **options)
    return matched_members(matches, scored)


def followed_members(members: DataFrame) -> DataFrame:
    """Members with their set's index date, if followed up beyond it."""
    return C.positive_follow_up(assign_index(members))


def matched_cohort(
    arms: DataFrame, rules: Rules, recode_sex: bool = True, **options
) -> DataFrame:
    return followed_members(match_arms(scored_arms(arms, recode_sex), rules.ratio, **options))


def run_study(
    patients: DataFrame,
    practices: DataFrame,
    condition_events: DataFrame,
    exposure_events: DataFrame,
    outcome_events: DataFrame,
    rules: Rules,
    name: str = "outcome",
    recode_sex: bool = True,
) -> DataFrame:
    """The matched outcome table; each event table is read once."""
    arms = study_arms(patients, practices, condition_events, exposure_events, rules)
    cohort = matched_cohort(arms, rules, recode_sex)
    return outcome_table(cohort, patients, outcome_events, name=name)


def stored_inputs(
    place: Workspace,
    patients: DataFrame,
    condition_events: DataFrame,
    exposure_events: DataFrame,
    outcome_events: DataFrame,
    buckets: int = 200,
    overwrite: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Patients and coded events as tables of a workspace, bucketed by patient.

    Events move once, when they are stored. What is asked of them afterwards, any number of
    times, is worked out bucket by bucket: first events, exposures and outcomes meet
    the patients without a shuffle of event rows.
    """
    named = {
        "patients": patients, "condition_events": condition_events,
        "exposure_events": exposure_events, "outcome_events": outcome_events,
    }
    return tuple(place.cached(name, df, ["patid"], buckets, overwrite) for name, df in named.items())


def study_report(
    patients: DataFrame,
    practices: DataFrame,
    condition_events: DataFrame,
    exposure_events: DataFrame,
    outcome_events: DataFrame,
    rules: Rules,
    name: str = "outcome",
    recode_sex: bool = True,
) -> dict[str, DataFrame]:
    """The tables reported on the matched study, from one stored outcome table.

    ``crosstabs``: arm by sex and by flag; ``flags``: members with each flag;
    ``flag_levels``: members by each level of each flag;
    ``ages``: age per arm; ``balance``: of the score and the covariates after
    matching; ``sizes``: all, matched and unmatched people per arm; ``counts``:
    sets, members, and members left by the follow-up rule.
    """
    arms = study_arms(patients, practices, condition_events, exposure_events, rules)
    scored = stage(scored_arms(arms, recode_sex), "scored")
    members = stage(match_arms(scored, rules.ratio), "members")
    outcomes = stage(
        outcome_table(followed_members(members), patients, outcome_events, name=name), "outcomes"
    )
    matched = members.agg(
        F.countDistinct("subclass").alias("matched sets"), F.count(F.lit(1)).alias("matched members")
    )
    left = outcomes.agg(
        F.count(F.lit(1)).alias("members left by follow-up"),
        F.count_if("case_control").alias("exposed members left"),
        F.count_if(~F.col("case_control")).alias("never exposed members left"),
    )
    return {
        "crosstabs": S.summary_tables(outcomes, name),
        "flags": S.flag_counts(outcomes, name),
        "flag_levels": S.flag_levels(outcomes, name),
        "ages": S.describe_by(outcomes, "case_control", "age"),
        "balance": S.balance(
            members, "case_control", ["distance", "age", "sex"], "weights", reference=scored
        ),
        "sizes": S.sample_sizes(scored, members, "case_control", "weights"),
        "counts": _listed(matched).unionByName(_listed(left)),
    }


def _listed(counts: DataFrame) -> DataFrame:
    """One row of counts as rows of ``measure, n``."""
    pairs = [F.struct(F.lit(c).alias("measure"), F.col(f"`{c}`").alias("n")) for c in counts.columns]
    return counts.select(F.inline(F.array(*pairs)))


def draft_cohorts(
    patients: DataFrame,
    condition_events: DataFrame,
    exposure_events: DataFrame,
    as_of_year: int,
    min_age: int = 65,
) -> tuple[DataFrame, DataFrame]:
    """First draft: old enough by calendar year, split by any prescription."""
    old = G.age_by_year(patients.select("patid", "yob"), as_of_year, min_age)
    diagnosed = E.distinct_patients(E.patient_events(old, E.distinct_patients(condition_events)))
    overlap = C.patients_in_both(diagnosed, exposure_events)
    return overlap, C.cohort_complement(diagnosed, overlap)


def draft_strict_cohorts(
    patients: DataFrame,
    condition_events: DataFrame,
    exposure_events: DataFrame,
    practices: DataFrame,
    rules: Rules,
) -> tuple[DataFrame, DataFrame]:
    """Second draft: no date tests on events, and leaving dates must exist for controls."""
    keys = ["patid", "pracid", "regenddate", "emis_ddate", "yob", "mob"]
    diagnosed = G.with_dob(
        E.first_event(patients, condition_events, "obsdate", keys, "first_obsdate", check_dates=False)
    )
    exposed = E.first_event(
        patients, exposure_events, "issuedate", ["patid"], "first_exposure", check_dates=False
    )
    ordered = C.ordered_before(diagnosed.join(exposed, "patid"), "first_obsdate", "first_exposure")
    aged = G.min_age_at(ordered, "first_exposure", rules.min_age)
    cases = G.follow_up_end(C.with_practice(aged, practices), rules.study_end).drop("first_exposure")
    reached = G.reached_age(diagnosed, rules.study_end, rules.min_age, null_dates="drop")
    return cases, C.never_exposed(reached, exposure_events)
