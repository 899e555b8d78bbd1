"""One query per operator, each over whole tables.

A query takes a session and a folder of parquet tables and returns a DataFrame.
Doubles are rounded, because engines differ in their last digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortloom.functions import dates as D
from cohortloom.operators import (
    codes as K,
    cohort as C,
    demographics as G,
    events as E,
    lists as L,
    matching as M,
    outcomes as O,
    summary as S,
)
from cohortloom.operators.numbering import number_rows
from cohortloom.operators.propensity import propensity_score as fit_propensity
from cohortloom.plans import codebooks, study
from cohortloom.session import fresh_path, stage
from cohortloom.sources import codesets, tables, text
from cohortloom.sources.star import CONDITION, OUTCOME, SECOND_OUTCOME, STUDY_END, Star
from cohortloom.sources.workspace import Workspace

RULES = study.Rules(study_end=STUDY_END, min_age=65, ratio=10)
DRAFT_YEAR = 2001
DIGITS = 6

# Study parameters standing in for a hand-made list of coded headings.
HEADINGS = [
    ("B1.2", "all"), ("B2", "all"), ("B2.3", "all"), ("B7", "all"),
    ("B2", "first"), ("B1", "first"),
    ("B1.2", "second"), ("B9", "second"),
]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Callable[[Star], DataFrame]) -> Callable[[Star], DataFrame]:
    """Register ``run`` under its own name."""
    QUERIES[run.__name__] = lambda spark, folder: run(Star(spark, folder))
    return run


# Shared building blocks


def _diagnosed(s: Star) -> DataFrame:
    return study.first_condition(s.patients(), s.condition_events())


def _exposed(s: Star) -> DataFrame:
    return study.first_exposure(s.patients(), s.exposure_events())


def _cases(s: Star) -> DataFrame:
    return study.case_cohort(_diagnosed(s), _exposed(s), s.practices(), RULES)


def _controls(s: Star) -> DataFrame:
    return study.control_cohort(_diagnosed(s), s.exposure_events(), s.practices(), RULES)


def _arms(s: Star) -> DataFrame:
    return study.study_arms(
        s.patients(), s.practices(), s.condition_events(), s.exposure_events(), RULES
    )


def _paired(s: Star) -> DataFrame:
    """Sets by a fixed rule: the j-th control joins case j modulo the number of cases."""
    arms = stage(_arms(s), "arms")
    cases = arms.where("case_control")
    n = max(cases.count(), 1)
    numbered = number_rows(cases, [], ["patid"], "set_no").select(
        F.col("patid").alias("subclass"), "set_no"
    )
    controls = number_rows(arms.where("not case_control"), [], ["patid"], "_no")
    assigned = controls.withColumn("set_no", F.col("_no") % n).drop("_no")
    members = assigned.join(numbered, "set_no").drop("set_no")
    return members.unionByName(cases.withColumn("subclass", F.col("patid")))


def _followed(s: Star) -> DataFrame:
    return study.followed_members(_paired(s))


def _followed_cases(s: Star) -> DataFrame:
    index = F.col("first_exposure").alias("new_index_date")
    cohort = _cases(s).select("patid", "end_date", "age", "gender", "case_control", index)
    return C.positive_follow_up(cohort)


def _outcomes(s: Star, cohort: DataFrame, code: str = OUTCOME) -> DataFrame:
    return O.outcome_table(cohort, s.patients(), s.outcome_events(code))


def _day_scored(s: Star) -> DataFrame:
    """Arms with a whole-number score, exact in any engine: age in days, sexes far apart."""
    arms = stage(_arms(s), "arms")
    days = F.round(F.col("age") * D.DAYS_PER_YEAR)
    return arms.withColumn("distance", days + F.col("sex") * 100_000)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, DIGITS) for c in columns})


def _medical_file(s: Star) -> str:
    path = fresh_path(s.spark, "dictionary")
    d = s.medical_dictionary()
    text.write_code_list(
        d.select(
            F.col("medcodeid").alias("MedCodeId"),
            F.col("original_code").alias("OriginalReadCode"),
            F.col("term").alias("Term"),
            F.col("concept_id").alias("SnomedCTConceptId"),
        ),
        path, sep="\t",
    )
    return path


def _product_file(s: Star) -> str:
    path = fresh_path(s.spark, "dictionary")
    d = s.product_dictionary()
    text.write_code_list(
        d.select(
            F.col("prodcodeid").alias("ProdCodeId"),
            F.col("term").alias("Term.from.EMIS"),
            F.col("substance").alias("DrugSubstanceName"),
        ),
        path, sep="\t",
    )
    return path


def _list_file(s: Star, codes: DataFrame) -> str:
    path = fresh_path(s.spark, "list")
    text.write_code_list(codes, path)
    return path


# Sources and sinks


@query
def dictionary_scan(s: Star) -> DataFrame:
    return text.read_dictionary(s.spark, _medical_file(s), "med").select(
        "medcodeid", "term", "original_code", "concept_id"
    )


@query
def product_dictionary_scan(s: Star) -> DataFrame:
    return text.read_dictionary(s.spark, _product_file(s), "prod").select(
        "prodcodeid", "term", "substance"
    )


@query
def record_tables(s: Star) -> DataFrame:
    """Every value of the four record tables, stored and read back under their declared schemas."""
    place = fresh_path(s.spark, "records")

    def scanned(name: str, df: DataFrame, read: Query, columns: str) -> DataFrame:
        df.write.parquet(f"{place}/{name}")
        cells = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns.split()]
        return read(s.spark, f"{place}/{name}").select(
            F.lit(name).alias("name"), F.concat_ws("|", *cells).alias("record")
        )

    observed = s.observations(with_practice=True).withColumn("enterdate", F.col("obsdate"))
    return (
        scanned(
            "patient", s.patients(), tables.read_patients,
            "patid pracid acceptable gender yob mob regenddate emis_ddate",
        )
        .unionByName(scanned("practice", s.practices(), tables.read_practices, "pracid lcd"))
        .unionByName(
            scanned("observation", observed, tables.read_observations, "patid pracid medcodeid obsdate")
        )
        .unionByName(
            scanned("drug_issue", s.drug_issues(), tables.read_drug_issues, "patid prodcodeid issuedate")
        )
    )


@query
def code_list_roundtrip(s: Star) -> DataFrame:
    """Separators, quotes, line breaks, outer blanks, a cell that reads NA, empty and missing cells."""
    path = fresh_path(s.spark, "list")
    name, kind, turn = F.col("p_name"), F.col("p_type"), F.col("p_partkey") % 8
    terms = [
        F.concat_ws(", ", name, kind), F.concat(F.lit('the "'), name, F.lit('" kind')),
        F.concat_ws("\n", name, kind), F.concat(F.lit("  "), name), F.concat(name, F.lit("  ")),
        F.lit("NA"), F.lit(""),
    ]
    term = F.lit(None).cast("string")
    for number, value in enumerate(terms):
        term = F.when(turn == number, value).otherwise(term)
    listed = s.raw("part").select(F.col("p_partkey").cast("string").alias("code"), term.alias("term"))
    text.write_code_list(listed, path, null_text="\\N")
    return text.read_code_list(s.spark, path, ",", "code", keep=["term"], null_text="\\N")


def _registered(s: Star) -> DataFrame:
    path = fresh_path(s.spark, "codesets")
    d, p = s.medical_dictionary(), s.product_dictionary()
    codesets.save_code_set(d, path, "condition", "01/01/2001", "med", "original_code", "concept_id")
    codesets.save_code_set(p, path, "drug", "01/01/2001", "prod", "prodcodeid", "term")
    codesets.save_code_set(d, path, "outcome", "02/02/2001", "med", "medcodeid", "term")
    # A set that an empty list replaces is gone.
    codesets.save_code_set(d, path, "withdrawn", "01/01/2001", "med", "medcodeid", "term")
    codesets.retire_code_set(s.spark, path, "withdrawn", "01/01/2001", "med")
    return codesets.read_code_sets(s.spark, path)


@query
def codeset_load(s: Star) -> DataFrame:
    return _registered(s)


@query
def codeset_version(s: Star) -> DataFrame:
    sets = _registered(s)
    return codesets.all_code_sets(sets, "01/01/2001")


@query
def codeset_by_name(s: Star) -> DataFrame:
    return codesets.code_set(_registered(s), "condition", "01/01/2001").select("code", "category")


@query
def materialize_roundtrip(s: Star) -> DataFrame:
    """Stored, replaced by another form, replaced again and read back."""
    place = Workspace(s.spark, fresh_path(s.spark, "workspace"), "check")
    place.cached("first_diagnosis", _exposed(s), cluster_by=["patid"], buckets=8)
    place.cached("first_diagnosis", _exposed(s), overwrite=True)
    place.cached("first_diagnosis", _diagnosed(s), cluster_by=["patid"], buckets=8, overwrite=True)
    # The stored table and its layout are used, not what is given with its name.
    return place.cached("first_diagnosis", _exposed(s), cluster_by=["yob", "gender"], buckets=3)


@query
def patient_subset(s: Star) -> DataFrame:
    return E.patient_modulus(s.observations(), "patid", 10, 3)


@query
def stored_patient_subsets(s: Star) -> DataFrame:
    """Observations stored by patient and read as four subsets, each out of its own buckets."""
    place = Workspace(s.spark, fresh_path(s.spark, "workspace"), "subsets")
    place.cached("observations", s.observations(), ["patid"], buckets=8)
    parts = [place.subset("observations", ["patid"], 4, [k]) for k in range(4)]
    # A patient is in one subset alone.
    whole = None
    for part in parts:
        one = part.groupBy("patid").agg(F.count(F.lit(1)).alias("events"), F.min("obsdate").alias("first_event"))
        whole = one if whole is None else whole.unionByName(one)
    return whole


# Projections, filters, predicates


@query
def cohort_report_cols(s: Star) -> DataFrame:
    return _rounded(C.matching_input(_cases(s), "first_exposure"), "age")


@query
def cohort_union(s: Star) -> DataFrame:
    return _rounded(study.combined_arms(_cases(s), _controls(s)), "age")


@query
def study_arms(s: Star) -> DataFrame:
    return _rounded(_arms(s), "age")


@query
def acceptable_patients(s: Star) -> DataFrame:
    return E.acceptable(s.patients())


@query
def plausible_events(s: Star) -> DataFrame:
    joined = E.patient_events(s.patients().select("patid", "yob"), s.condition_events())
    return E.plausible(E.has_date(joined, "obsdate"), "obsdate").select("patid", "yob", "obsdate")


@query
def derive_dob(s: Star) -> DataFrame:
    return G.with_dob(s.patients()).select("patid", "yob", "mob", "dob")


@query
def age_at_event(s: Star) -> DataFrame:
    born = G.with_dob(s.patients().select("patid", "yob", "mob"))
    joined = born.join(_exposed(s), "patid")
    return G.min_age_at(joined, "first_exposure", 65).select("patid", "dob", "first_exposure")


@query
def reached_age_65(s: Star) -> DataFrame:
    return study.reached_age(s.patients(), RULES).select("patid", "dob")


@query
def follow_up_end(s: Star) -> DataFrame:
    joined = C.with_practice(s.patients(), s.practices())
    return G.follow_up_end(joined, STUDY_END).select("patid", "pracid", "lcd", "end_date")


@query
def age_years(s: Star) -> DataFrame:
    aged = G.with_age(G.with_dob(s.patients()), STUDY_END)
    return _rounded(aged.select("patid", "age"), "age")


@query
def age_by_calendar_year(s: Star) -> DataFrame:
    return G.age_by_year(s.patients().select("patid", "yob"), DRAFT_YEAR, 65)


@query
def recode_sex(s: Star) -> DataFrame:
    sexed = s.patients().select("patid", F.col("gender").alias("sex"))
    return G.recode(sexed, "sex", {1: 0}, 1)


@query
def term_search(s: Star) -> DataFrame:
    return K.search_terms(s.product_dictionary(), ["term", "substance"], ["red plate", "promo"])


@query
def followup_filter(s: Star) -> DataFrame:
    return _rounded(_followed(s), "age")


# Joins


@query
def coded_observations(s: Star) -> DataFrame:
    codes = s.med_codes(CONDITION).withColumn("category", F.lit("condition"))
    return E.coded_events(s.observations(with_practice=True), codes, "medcodeid", category=True)


@query
def coded_outcomes(s: Star) -> DataFrame:
    return E.coded_events(
        s.observations(with_practice=True), s.med_codes(OUTCOME, SECOND_OUTCOME), "medcodeid"
    )


@query
def coded_prescriptions(s: Star) -> DataFrame:
    return s.exposure_events()


@query
def patient_events(s: Star) -> DataFrame:
    patients = s.patients().select("patid", "pracid", "gender", "yob")
    return E.patient_events(patients, s.observations(with_practice=True))


@query
def never_exposed(s: Star) -> DataFrame:
    reached = study.reached_age(_diagnosed(s), RULES).select("patid", "first_obsdate", "dob")
    return C.never_exposed(reached, s.exposure_events())


@query
def cohort_complement(s: Star) -> DataFrame:
    diagnosed = E.distinct_patients(s.condition_events())
    return C.cohort_complement(diagnosed, s.exposure_events())


@query
def cohort_overlap(s: Star) -> DataFrame:
    return C.patients_in_both(s.condition_events(), s.exposure_events())


def _legacy(s: Star) -> DataFrame:
    return s.med_codes("Brand#3", "Brand#12", "Brand#12", "Brand#21")


def _concepts(s: Star) -> DataFrame:
    return s.med_codes("PROMO", "ECONOMY")


@query
def map_codes_primary(s: Star) -> DataFrame:
    return K.map_codes(s.medical_dictionary(), _legacy(s), "original_code")


@query
def map_codes_secondary(s: Star) -> DataFrame:
    return K.map_codes(s.medical_dictionary(), _concepts(s), "concept_id")


@query
def assign_index_date(s: Star) -> DataFrame:
    return M.assign_index(_paired(s)).select(
        "patid", "subclass", "case_control", "index_date", "new_index_date"
    )


@query
def subclass_index_date(s: Star) -> DataFrame:
    return M.subclass_index(_paired(s))


# Aggregations


@query
def first_diagnosis(s: Star) -> DataFrame:
    return _diagnosed(s)


@query
def first_exposure(s: Star) -> DataFrame:
    return _exposed(s)


@query
def first_outcome(s: Star) -> DataFrame:
    return study.first_outcome(s.patients(), s.outcome_events())


@query
def distinct_patients(s: Star) -> DataFrame:
    return E.distinct_patients(s.condition_events())


@query
def count_distinct_patients(s: Star) -> DataFrame:
    return E.count_patients(s.observations())


@query
def cohort_row_count(s: Star) -> DataFrame:
    return C.row_count(_controls(s))


@query
def attrition(s: Star) -> DataFrame:
    return study.attrition(
        s.patients(), s.practices(), s.observations(), s.condition_events(), s.exposure_events(), RULES
    )


@query
def count_by_arm(s: Star) -> DataFrame:
    return S.count_by(_followed(s), ["case_control"])


@query
def crosstab_by_arm(s: Star) -> DataFrame:
    return S.count_by(_followed(s), ["case_control", "sex"])


@query
def age_summary(s: Star) -> DataFrame:
    return _rounded(S.describe_by(_arms(s), "case_control", "age"), "sd", "mean")


# Set operations


@query
def combine_codes(s: Star) -> DataFrame:
    d = s.medical_dictionary()
    return K.combine_codes(
        K.map_codes(d, _legacy(s), "original_code"),
        K.map_codes(d, _concepts(s), "concept_id"),
        key="medcodeid",
    )


# Matching


@query
def propensity_score(s: Star) -> DataFrame:
    scored = study.scored_arms(_arms(s))
    return _rounded(scored.select("patid", "distance"), "distance")


@query
def match_nearest(s: Star) -> DataFrame:
    return M.match_nearest(_day_scored(s), "case_control", "distance", 2).select(
        "case_id", "control_id", "match_round"
    )


@query
def match_nearest_shortfall(s: Star) -> DataFrame:
    return M.match_nearest(_day_scored(s), "case_control", "distance", 10).select(
        "case_id", "control_id", "match_round"
    )


@query
def match_nearest_caliper(s: Star) -> DataFrame:
    return M.match_nearest(_day_scored(s), "case_control", "distance", 2, caliper=30).select(
        "case_id", "control_id", "match_round"
    )


@query
def match_nearest_blocks(s: Star) -> DataFrame:
    """Too few controls, every score distinct, and no task larger than an eighth of the arms."""
    scored = stage(
        _day_scored(s).withColumn("distance", F.col("distance") * 1_000_000 + F.col("patid")), "scored"
    )
    return M.match_nearest(
        scored, "case_control", "distance", 10, block_rows=max(1, scored.count() // (8 * M.LONGEST))
    ).select("case_id", "control_id", "match_round")


@query
def matched_members(s: Star) -> DataFrame:
    members = study.match_arms(_day_scored(s), 2)
    return _rounded(members.select("patid", "subclass", "weights", "case_control"), "weights")


@query
def balance_unmatched(s: Star) -> DataFrame:
    arms = G.recode(stage(_arms(s), "arms"), "sex", {1: 0}, 1)
    return _rounded(S.balance(arms, "case_control", ["age", "sex"]), *_BALANCE)


@query
def balance_matched(s: Star) -> DataFrame:
    scored = G.recode(_day_scored(s), "sex", {1: 0}, 1)
    members = stage(study.match_arms(scored, 2), "members")
    return _rounded(
        S.balance(members, "case_control", ["age", "sex"], "weights", reference=scored), *_BALANCE
    )


_BALANCE = ("mean_treated", "mean_control", "std_mean_diff", "var_ratio", "ecdf_mean", "ecdf_max")


@query
def arm_sizes(s: Star) -> DataFrame:
    members = study.match_arms(_day_scored(s), 2)
    return _rounded(S.arm_sizes(members, "case_control", "weights"), "effective_n")


@query
def matched_cohort(s: Star) -> DataFrame:
    cohort = study.matched_cohort(_arms(s), RULES)
    return _rounded(cohort, "age", "weights", "distance")


@query
def matched_outcomes(s: Star) -> DataFrame:
    return _rounded(
        study.run_study(
            s.patients(), s.practices(), s.condition_events(), s.exposure_events(),
            s.outcome_events(), RULES,
        ),
        "age", "weights", "distance",
    )


@query
def stored_matched_outcomes(s: Star) -> DataFrame:
    """The study on patients and events stored once, bucketed by patient."""
    place = Workspace(s.spark, fresh_path(s.spark, "workspace"), "study")
    patients, condition, exposure, outcome = study.stored_inputs(
        place, s.patients(), s.condition_events(), s.exposure_events(), s.outcome_events(), buckets=8
    )
    return _rounded(study.run_study(patients, s.practices(), condition, exposure, outcome, RULES), "age", "weights", "distance")


@query
def events_stored_by_code(s: Star) -> DataFrame:
    """Outcome events out of observations stored in the order of their code."""
    stored = E.by_code(s.observations(with_practice=True), fresh_path(s.spark, "by-code"), "medcodeid", files=16)
    return E.coded_events(stored, s.med_codes(OUTCOME, SECOND_OUTCOME), "medcodeid")


@query
def second_matched_outcomes(s: Star) -> DataFrame:
    """The study's second outcome; this variant leaves sex as recorded."""
    return _rounded(
        study.run_study(
            s.patients(), s.practices(), s.condition_events(), s.exposure_events(),
            s.outcome_events(SECOND_OUTCOME), RULES, name="second", recode_sex=False,
        ),
        "age", "weights", "distance",
    )


def _report(s: Star) -> dict[str, DataFrame]:
    return study.study_report(
        s.patients(), s.practices(), s.condition_events(), s.exposure_events(), s.outcome_events(), RULES
    )


@query
def report_crosstabs(s: Star) -> DataFrame:
    return _report(s)["crosstabs"]


@query
def report_flags(s: Star) -> DataFrame:
    return _report(s)["flags"]


@query
def report_flag_levels(s: Star) -> DataFrame:
    return _report(s)["flag_levels"]


@query
def report_ages(s: Star) -> DataFrame:
    return _rounded(_report(s)["ages"], "sd", "mean")


@query
def report_balance(s: Star) -> DataFrame:
    return _rounded(_report(s)["balance"], *_BALANCE)


@query
def report_sizes(s: Star) -> DataFrame:
    return _rounded(_report(s)["sizes"], "effective_n")


@query
def report_counts(s: Star) -> DataFrame:
    return _report(s)["counts"]


# Outcome features


@query
def outcome_before(s: Star) -> DataFrame:
    first = study.first_outcome(s.patients(), s.outcome_events())
    joined = O.with_first_outcome(_followed_cases(s), first)
    return O.outcome_before(joined).select(
        "patid", "new_index_date", "first_outcome", "outcome_beforeindexdate"
    )


@query
def outcome_after(s: Star) -> DataFrame:
    return O.outcome_after(_followed_cases(s), s.outcome_events()).drop("_on_or_after")


@query
def outcome_after_censored(s: Star) -> DataFrame:
    cohort = _followed_cases(s)
    return O.outcome_after(cohort, s.outcome_events(), censor="end_date").drop("_on_or_after")


@query
def outcome_flags(s: Star) -> DataFrame:
    return _outcomes(s, _followed_cases(s)).select(
        "patid", "outcome_beforeindex", "outcome_in12monthsafterindex", "outcome_anyafterindex"
    )


@query
def outcome_positive(s: Star) -> DataFrame:
    first = study.first_outcome(s.patients(), s.outcome_events(SECOND_OUTCOME))
    return O.with_first_outcome(_followed_cases(s), first, how="inner").select(
        "patid", "new_index_date", "first_outcome"
    )


# Code-list operators


def _coded_lines(s: Star) -> DataFrame:
    """Dispensed lines with the brand as a dotted, nested code: B1 above B1.2."""
    brands = s.raw("part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.concat(
            F.lit("B"),
            F.substring("p_brand", 7, 1),
            F.when(F.length("p_brand") == 8, F.concat(F.lit("."), F.substring("p_brand", 8, 1))).otherwise(""),
        ).alias("icd10"),
    )
    lines = s.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return lines.join(brands, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "icd10")


def _headings(s: Star) -> DataFrame:
    values = ", ".join(f"('{code}', '{label}')" for code, label in HEADINGS)
    return s.spark.sql(f"SELECT icd10, subtype FROM VALUES {values} AS headings(icd10, subtype)")


@query
def prefix_code_match(s: Star) -> DataFrame:
    return L.prefix_coded_events(_coded_lines(s), _headings(s).where("subtype = 'all'"), "icd10")


@query
def event_subtypes(s: Star) -> DataFrame:
    return L.label_events(_coded_lines(s), _headings(s), "icd10")


def _name_lookup(s: Star) -> DataFrame:
    """Names, generics and classes as they occur in the part table, conflicts included."""
    noun = F.split_part("p_name", F.lit(" "), F.lit(2))
    return s.raw("part").select(
        F.col("p_size").alias("brand_id"),
        F.col("p_name").alias("brand_name"),
        noun.alias("generic_name"),
        F.col("p_type").alias("class"),
    )


@query
def classify_products(s: Star) -> DataFrame:
    names = _name_lookup(s)
    # Two-word brands, and every generic under its own name.
    lookup = (
        names.select("brand_name", "generic_name", F.lower("class").alias("class"))
        .unionByName(names.select(
            F.col("generic_name").alias("brand_name"), "generic_name", F.lit("generic").alias("class")
        ))
        .distinct()
    )
    products = s.raw("part").select(
        F.col("p_partkey").cast("string").alias("prodcodeid"),
        F.concat(F.lower("p_type"), F.lit(" "), F.upper("p_name"), F.lit(" "), F.col("p_size"), F.lit("mg")).alias("text"),
    )
    return L.classify_products(products, lookup, "prodcodeid", "text", exclude_generics=["anvil"])


@query
def lookup_conflicts(s: Star) -> DataFrame:
    return L.lookup_conflicts(_name_lookup(s))


@query
def reconcile_lists(s: Star) -> DataFrame:
    return L.reconcile_lists(*_reviewers(s))


def _reviewers(s: Star) -> tuple[DataFrame, DataFrame]:
    part = s.raw("part")
    code = F.col("p_partkey").cast("string").alias("code")
    return (
        part.where(F.col("p_type").isin("PROMO", "SMALL")).select(code),
        part.where(F.col("p_name").like("red %")).select(code),
    )


@query
def included_codes(s: Star) -> DataFrame:
    decided = L.reconcile_lists(*_reviewers(s)).withColumn(
        "include", F.when(F.col("matchtotal") == 2, 1).otherwise(F.col("cal"))
    )
    return L.included(decided)


def _reviewed(s: Star) -> DataFrame:
    """Reviewed stems; linked rows carry a cleansed code, the others the text NA."""
    part = s.raw("part")
    return part.select(
        F.col("p_partkey"),
        F.substring("p_brand", 1, 5).alias("readcode"),
        F.when(F.col("p_size") > 20, F.concat("p_brand", F.lit("."), "p_type"))
        .when(F.col("p_size") > 10, F.lit("NA"))
        .alias("cleansed_code"),
    )


@query
def final_code(s: Star) -> DataFrame:
    return _reviewed(s).withColumn(
        "final_code", K.final_code(F.col("cleansed_code"), F.col("readcode"))
    )


@query
def link_by_stem(s: Star) -> DataFrame:
    dictionary = s.raw("part").select("p_partkey", F.replace("p_brand", F.lit("Brand#"), F.lit("E0")).alias("cleansed_code"))
    stems = s.raw("nation").select(
        F.concat(F.lit("E0"), F.col("n_nationkey").cast("string")).alias("readcode"),
        F.col("n_name").alias("term"),
    )
    return K.link_by_stem(dictionary, stems, "cleansed_code", "readcode", n=5)


@query
def code_list_issues(s: Star) -> DataFrame:
    listed = s.raw("part").select(
        F.when(F.col("p_size") <= 5, F.lit(" "))
        .when(F.col("p_size") <= 15, F.concat(F.col("p_size").cast("string"), F.lit(".25E+14")))
        .when(F.col("p_size") <= 30, F.concat(F.lit("8"), F.col("p_partkey").cast("string")))
        .otherwise(F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string")))
        .alias("code")
    )
    return L.code_list_issues(listed)


# End-to-end queries


@query
def build_code_set(s: Star) -> DataFrame:
    """Dictionary and two lists as text, match, list as text, registered, fetched by name and version."""
    return codebooks.build_condition_set(
        s.spark, _medical_file(s), _list_file(s, _legacy(s)), _list_file(s, _concepts(s)),
        fresh_path(s.spark, "list"), fresh_path(s.spark, "codesets"), "condition", "01/01/2001",
    ).select("kind", "code", "category", "name", "version")


@query
def build_drug_code_set(s: Star) -> DataFrame:
    return codebooks.build_drug_set(
        s.spark, _product_file(s), ["red plate", ""], fresh_path(s.spark, "list"),
        fresh_path(s.spark, "codesets"), "drug", "01/01/2001",
    ).select("kind", "code", "category", "name", "version")


@query
def register_prepared_list(s: Star) -> DataFrame:
    """Two versions of a prepared list read from text; the later one is fetched."""
    sets = fresh_path(s.spark, "codesets")
    listed = s.medical_dictionary().select(F.col("medcodeid").alias("code"), "term", "concept_id")
    early = _list_file(s, listed.where("concept_id = 'PROMO'"))
    codebooks.register_list(s.spark, early, sets, "prepared", "01/01/2001", "med", category="term")
    return codebooks.register_list(
        s.spark, _list_file(s, listed), sets, "prepared", "02/02/2001", "med", category="term"
    ).select("kind", "code", "category", "name", "version")


@query
def case_cohort(s: Star) -> DataFrame:
    return _rounded(_cases(s), "age")


@query
def control_cohort(s: Star) -> DataFrame:
    return _rounded(_controls(s), "age")


@query
def outcome_table(s: Star) -> DataFrame:
    return _rounded(_outcomes(s, _followed_cases(s)), "age")


@query
def second_outcome_table(s: Star) -> DataFrame:
    return _rounded(_outcomes(s, _followed_cases(s), SECOND_OUTCOME), "age")


@query
def summary_tables(s: Star) -> DataFrame:
    return S.summary_tables(_outcomes(s, _followed(s)))


@query
def draft_cohort_overlap(s: Star) -> DataFrame:
    return study.draft_cohorts(s.patients(), s.condition_events(), s.exposure_events(), DRAFT_YEAR)[0]


@query
def draft_cohort_complement(s: Star) -> DataFrame:
    return study.draft_cohorts(s.patients(), s.condition_events(), s.exposure_events(), DRAFT_YEAR)[1]


def _draft_strict(s: Star) -> tuple[DataFrame, DataFrame]:
    return study.draft_strict_cohorts(
        s.patients(), s.condition_events(), s.exposure_events(), s.practices(), RULES
    )


@query
def draft_case_cohort(s: Star) -> DataFrame:
    return _draft_strict(s)[0]


@query
def draft_control_cohort(s: Star) -> DataFrame:
    return _draft_strict(s)[1]


@query
def draft_reached_age(s: Star) -> DataFrame:
    """Patients left by each strict leaving-date rule, and by the production rule."""
    born = G.with_dob(s.patients())

    def kept(name: str, leaving: tuple[str, ...], null_dates: str) -> DataFrame:
        df = G.reached_age(born, STUDY_END, 65, leaving, null_dates)
        return df.agg(F.count(F.lit(1)).alias("patients")).select(F.lit(name).alias("rule"), "patients")

    both = ("regenddate", "emis_ddate")
    return (
        kept("left, must exist", both[:1], "drop")
        .unionByName(kept("died, must exist", both[1:], "drop"))
        .unionByName(kept("both must exist", both, "drop"))
        .unionByName(kept("missing means study end", both, "study_end"))
    )
