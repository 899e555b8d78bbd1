"""The catalogue's queries in plain SQL over the same tables.

Written from the rules, not from the Spark code: a join and a filter stand where
the library pre-aggregates, and one case at a time stands for the matching.
"""

from __future__ import annotations

from cohortloom.catalogue.queries import HEADINGS

END = "DATE '2001-06-01'"
AGE = "65 * 365.25"

# Record tables as views of the star schema, then the study's intermediate tables.
BASE = f"""
WITH RECURSIVE patient AS (
  SELECT c_custkey AS patid, CAST(c_nationkey AS INTEGER) AS pracid,
    CASE WHEN c_custkey % 20 = 0 THEN 0 ELSE 1 END AS acceptable,
    CAST(1 + c_custkey % 2 AS INTEGER) AS gender, CAST(1915 + c_custkey % 37 AS INTEGER) AS yob,
    CASE WHEN c_custkey % 4 = 0 THEN CAST(1 + c_custkey % 12 AS INTEGER) END AS mob,
    CASE WHEN c_custkey % 10 = 3 OR c_custkey % 7 = 5 THEN DATE '1999-01-01' + CAST(c_custkey % 900 AS INT) END AS regenddate,
    CASE WHEN c_custkey % 10 = 6 OR c_custkey % 7 = 5 THEN DATE '1999-06-01' + CAST(c_custkey % 700 AS INT) END AS emis_ddate
  FROM customer),
practice AS (
  SELECT n_nationkey AS pracid,
    CASE WHEN n_nationkey % 5 <> 0 THEN DATE '2000-06-01' + CAST(30 * n_nationkey AS INT) END AS lcd
  FROM nation),
observation AS (
  SELECT o_custkey AS patid,
    CAST((c_nationkey + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) % 25 AS INTEGER) AS pracid,
    CASE WHEN o_orderkey % 53 <> 0 THEN CAST(o_orderdate AS DATE) END AS obsdate,
    o_orderpriority AS medcodeid
  FROM orders JOIN customer ON o_custkey = c_custkey),
drug_issue AS (
  SELECT o_custkey AS patid, CASE WHEN l_orderkey % 41 <> 0 THEN CAST(l_shipdate AS DATE) END AS issuedate,
    CAST(l_partkey AS VARCHAR) AS prodcodeid
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
med_dict AS (
  SELECT CAST(p_partkey AS VARCHAR) AS medcodeid, p_name AS term, p_brand AS original_code,
    p_type AS concept_id FROM part),
prod_dict AS (
  SELECT CAST(p_partkey AS VARCHAR) AS prodcodeid, p_name AS term, p_type AS substance FROM part),
condition AS (SELECT * FROM observation WHERE medcodeid = '1-URGENT'),
outcome AS (SELECT * FROM observation WHERE medcodeid = '2-HIGH'),
outcome2 AS (SELECT * FROM observation WHERE medcodeid = '3-MEDIUM'),
exposure AS (
  SELECT * FROM drug_issue
  WHERE prodcodeid IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 200 = 7)),
born AS (
  SELECT *, make_date(yob, coalesce(mob, 1), 1) AS dob FROM patient),
diagnosed AS (
  SELECT p.patid, p.pracid, regenddate, emis_ddate, yob, mob, gender, dob, min(obsdate) AS first_obsdate
  FROM born p JOIN condition o ON p.patid = o.patid
  WHERE acceptable <> 0 AND year(obsdate) > yob GROUP BY ALL),
exposed AS (
  SELECT p.patid, min(issuedate) AS first_exposure FROM patient p JOIN exposure e ON p.patid = e.patid
  WHERE acceptable <> 0 AND year(issuedate) > yob GROUP BY p.patid),
first_out AS (
  SELECT p.patid, min(obsdate) AS first_outcome FROM patient p JOIN outcome o ON p.patid = o.patid
  WHERE acceptable <> 0 AND year(obsdate) > yob GROUP BY p.patid),
first_out2 AS (
  SELECT p.patid, min(obsdate) AS first_outcome FROM patient p JOIN outcome2 o ON p.patid = o.patid
  WHERE acceptable <> 0 AND year(obsdate) > yob GROUP BY p.patid),
cases AS (
  SELECT d.*, first_exposure, lcd,
    least({END}, coalesce(regenddate, {END}), coalesce(emis_ddate, {END}), coalesce(lcd, {END})) AS end_date,
    date_diff('day', dob, {END}) / 365.25 AS age, TRUE AS case_control
  FROM diagnosed d JOIN exposed USING (patid) JOIN practice USING (pracid)
  WHERE first_obsdate <= first_exposure AND date_diff('day', dob, first_exposure) >= {AGE}),
reached AS (
  SELECT * FROM diagnosed
  WHERE date_diff('day', dob, {END}) >= {AGE}
    AND date_diff('day', dob, coalesce(regenddate, {END})) >= {AGE}
    AND date_diff('day', dob, coalesce(emis_ddate, {END})) >= {AGE}),
never AS (SELECT * FROM reached WHERE patid NOT IN (SELECT patid FROM exposure)),
controls AS (
  SELECT d.*, lcd,
    least({END}, coalesce(regenddate, {END}), coalesce(emis_ddate, {END}), coalesce(lcd, {END})) AS end_date,
    date_diff('day', dob, {END}) / 365.25 AS age, FALSE AS case_control
  FROM never d JOIN practice USING (pracid)),
arms AS (
  SELECT patid, first_exposure AS index_date, end_date, age, gender AS sex, case_control FROM cases
  UNION
  SELECT patid, DATE '1900-01-01', end_date, age, gender, case_control FROM controls),
case_no AS (
  SELECT patid AS subclass, row_number() OVER (ORDER BY patid) - 1 AS set_no FROM arms WHERE case_control),
control_no AS (
  SELECT *, (row_number() OVER (ORDER BY patid) - 1) % (SELECT count(*) FROM case_no) AS set_no
  FROM arms WHERE NOT case_control),
paired AS (
  SELECT c.* EXCLUDE (set_no), subclass FROM control_no c JOIN case_no USING (set_no)
  UNION ALL
  SELECT a.*, patid FROM arms a WHERE case_control),
indexed AS (
  SELECT p.*, i.new_index_date
  FROM paired p JOIN (SELECT subclass, max(index_date) AS new_index_date FROM paired GROUP BY subclass) i
    USING (subclass)),
followed AS (SELECT * FROM indexed WHERE end_date > new_index_date),
followed_cases AS (
  SELECT patid, end_date, age, gender, case_control, first_exposure AS new_index_date
  FROM cases WHERE end_date > first_exposure)
"""


def _with_outcome(cohort: str, events: str, first: str) -> str:
    """Cohort rows with first outcome, dates around the index and flags."""
    return f"""
  SELECT c.*, first_outcome,
    CASE WHEN first_outcome < new_index_date THEN strftime(first_outcome, '%Y-%m-%d') END
      AS outcome_beforeindexdate,
    outcome_afterindexdate,
    CASE WHEN first_outcome < new_index_date THEN 1 ELSE 0 END AS outcome_beforeindex,
    CASE WHEN date_diff('day', new_index_date, outcome_afterindexdate) <= 365 THEN 1 ELSE 0 END
      AS outcome_in12monthsafterindex,
    CASE WHEN n_from_index > 0 THEN 1 ELSE 0 END AS outcome_anyafterindex
  FROM {cohort} c
  LEFT JOIN {first} f ON c.patid = f.patid
  LEFT JOIN (
    SELECT c.patid AS who, min(obsdate) FILTER (obsdate > new_index_date) AS outcome_afterindexdate,
      count(*) FILTER (obsdate >= new_index_date) AS n_from_index
    FROM {cohort} c JOIN {events} o ON c.patid = o.patid GROUP BY c.patid) a ON c.patid = a.who
"""


# Logistic regression by Newton's method on counted covariate combinations.
GLM = """,
cell AS (
  SELECT round(age * 365.25) / 365.25 AS age, CASE WHEN sex = 1 THEN 0 ELSE 1 END AS sex,
    count(*) AS n, count(*) FILTER (case_control) AS y
  FROM arms GROUP BY ALL),
newton AS (
  SELECT 0 AS turn, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2
  UNION ALL
  SELECT turn + 1,
    b0 + (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det,
    b1 + (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det,
    b2 + (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det
  FROM (
    SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02)
      + h02 * (h01 * h12 - h11 * h02) AS det
    FROM (
      SELECT turn, b0, b1, b2,
        sum(y - n * p) AS g0, sum((y - n * p) * x) AS g1, sum((y - n * p) * sex) AS g2,
        sum(n * p * (1 - p)) AS h00, sum(n * p * (1 - p) * x) AS h01, sum(n * p * (1 - p) * sex) AS h02,
        sum(n * p * (1 - p) * x * x) AS h11, sum(n * p * (1 - p) * x * sex) AS h12,
        sum(n * p * (1 - p) * sex * sex) AS h22
      FROM (
        SELECT *, age - 70 AS x, 1 / (1 + exp(-(b0 + b1 * (age - 70) + b2 * sex))) AS p
        FROM newton, cell WHERE turn < 15)
      GROUP BY turn, b0, b1, b2))),
fitted AS (
  SELECT patid, index_date, end_date, age, CASE WHEN sex = 1 THEN 0 ELSE 1 END AS sex, case_control,
    1 / (1 + exp(-(b0 + b1 * (age - 70) + b2 * CASE WHEN sex = 1 THEN 0 ELSE 1 END))) AS distance
  FROM arms, newton WHERE turn = 15)
"""


DAY_SCORE = "SELECT *, round(age * 365.25) + sex * 100000 AS score FROM arms"
DISTINCT_SCORE = "SELECT *, (round(age * 365.25) + sex * 100000) * 1000000 + patid AS score FROM arms"
FITTED_SCORE = "SELECT *, round(distance, 12) AS score FROM fitted"


def _walk(ratio: int, caliper: str = "", scored: str = DAY_SCORE) -> str:
    """Sequential matching, one case per step: ``pairs`` of case, control and round."""
    gap = f"AND abs(c.score - s.score) <= {caliper}" if caliper else ""
    return f""",
scored AS ({scored}),
ordered AS (
  SELECT patid, score, row_number() OVER (ORDER BY score DESC, patid) AS n
  FROM scored WHERE case_control),
steps AS (
  SELECT patid, score, r AS match_round, n + (r - 1) * (SELECT count(*) FROM ordered) AS step
  FROM ordered, (SELECT CAST(unnest(range(1, {ratio + 1})) AS INTEGER) AS r)),
walk AS (
  SELECT CAST(0 AS BIGINT) AS step, CAST(NULL AS BIGINT) AS case_id, CAST(NULL AS BIGINT) AS control_id,
    CAST(NULL AS INTEGER) AS match_round, CAST([] AS BIGINT[]) AS used
  UNION ALL
  SELECT step, case_id, pick, match_round, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END
  FROM (
    SELECT s.step, any_value(s.patid) AS case_id, any_value(s.match_round) AS match_round,
      any_value(w.used) AS used, arg_min(c.patid, (abs(c.score - s.score), c.score, c.patid)) AS pick
    FROM walk w JOIN steps s ON s.step = w.step + 1
    LEFT JOIN scored c ON NOT c.case_control AND NOT list_contains(w.used, c.patid) {gap}
    GROUP BY s.step)),
pairs AS (SELECT case_id, control_id, match_round FROM walk WHERE control_id IS NOT NULL),
members AS (
  SELECT control_id AS patid, case_id AS subclass,
    1.0 / count(*) OVER (PARTITION BY case_id) AS weights FROM pairs
  UNION ALL
  SELECT DISTINCT case_id, case_id, 1.0 FROM pairs)
"""


def _balance(sample: str, reference: str, covariates: tuple[str, ...] = ("age", "sex")) -> str:
    """Balance of the covariates in ``sample(case_control, w, ...)``."""
    per_covariate = []
    for covariate in covariates:
        binary = covariate == "sex"
        var = "m * (1 - m)" if binary else "sq / (1 - conc)"

        def moments(table: str, c: str = covariate, v: str = var) -> str:
            return f"""(
    SELECT case_control, m, {v} AS var FROM (
      SELECT t.case_control, any_value(m) AS m,
        sum(w / total * ({c} - m) * ({c} - m)) AS sq, sum((w / total) * (w / total)) AS conc
      FROM {table} t JOIN (
        SELECT case_control, sum(w) AS total, sum(w * {c}) / sum(w) AS m FROM {table} GROUP BY 1) USING (case_control)
      GROUP BY t.case_control))"""

        per_covariate.append(f"""
  SELECT '{covariate}' AS covariate, round(t.m, 6) AS mean_treated, round(c.m, 6) AS mean_control,
    round((t.m - c.m) / sqrt(r.var), 6) AS std_mean_diff,
    {'CAST(NULL AS DOUBLE)' if binary else 'round(t.var / c.var, 6)'} AS var_ratio,
    {'round(abs(t.m - c.m), 6)' if binary else f'round((SELECT avg(abs(gap)) FROM gaps_{covariate}), 6)'} AS ecdf_mean,
    {'round(abs(t.m - c.m), 6)' if binary else f'round((SELECT max(abs(gap)) FROM gaps_{covariate}), 6)'} AS ecdf_max
  FROM {moments(sample)} t, {moments(sample)} c, {moments(reference)} r
  WHERE t.case_control AND NOT c.case_control AND r.case_control""")
    gaps = "".join(f""",
gaps_{c} AS (
  SELECT sum(step) OVER (ORDER BY {c} ROWS UNBOUNDED PRECEDING) AS gap FROM (
    SELECT {c}, sum(CASE WHEN case_control THEN w / wt ELSE -w / wc END) AS step
    FROM {sample}, (SELECT sum(w) FILTER (case_control) AS wt, sum(w) FILTER (NOT case_control) AS wc FROM {sample})
    GROUP BY {c}))""" for c in covariates if c != "sex")
    return gaps + " UNION ALL ".join(per_covariate)


_HEADINGS = ", ".join(f"('{code}', '{label}')" for code, label in HEADINGS)
_LINES = """
lines AS (
  SELECT l_orderkey, l_linenumber, l_partkey,
    'B' || substr(p_brand, 7, 1) || CASE WHEN length(p_brand) = 8 THEN '.' || substr(p_brand, 8, 1) ELSE '' END
      AS icd10
  FROM lineitem JOIN part ON l_partkey = p_partkey)
"""
_NAMES = """
names AS (
  SELECT p_size AS brand_id, p_name AS brand_name, split_part(p_name, ' ', 2) AS generic_name,
    p_type AS class FROM part)
"""
_LEGACY = "('Brand#3', 'Brand#12', 'Brand#21')"
_CONCEPTS = "('PROMO', 'ECONOMY')"
_OUTCOME_COLUMNS = """patid, end_date, round(age, 6) AS age, gender, case_control, new_index_date,
  first_outcome, outcome_beforeindexdate, outcome_afterindexdate, outcome_beforeindex,
  outcome_in12monthsafterindex, outcome_anyafterindex"""
_COHORT = "patid, pracid, regenddate, emis_ddate, yob, mob, gender, first_obsdate"


def _study(select: str) -> str:
    return BASE + select


def _matching(ratio: int, select: str, caliper: str = "") -> str:
    return BASE + _walk(ratio, caliper) + select


# The study's own matching, on the fitted score, with index dates and follow-up.
MATCHED = BASE + GLM + _walk(10, scored=FITTED_SCORE) + """,
matched AS (
  SELECT f.*, subclass, weights, new_index_date
  FROM members JOIN fitted f USING (patid)
  JOIN (SELECT patid AS subclass, index_date AS new_index_date FROM arms) USING (subclass)
  WHERE end_date > new_index_date)
"""

REPORTED = MATCHED + f""", result AS ({_with_outcome('matched', 'outcome', 'first_out')})
"""

ORACLE: dict[str, str] = {
    "dictionary_scan": _study("SELECT * FROM med_dict"),
    "product_dictionary_scan": _study("SELECT * FROM prod_dict"),
    "record_tables": _study(" UNION ALL ".join(
        f"SELECT '{name}' AS name, concat_ws('|', {', '.join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in columns.split())}) AS record FROM {name}"
        for name, columns in (
            ("patient", "patid pracid acceptable gender yob mob regenddate emis_ddate"),
            ("practice", "pracid lcd"), ("observation", "patid pracid medcodeid obsdate"),
            ("drug_issue", "patid prodcodeid issuedate"),
        )
    )),
    "code_list_roundtrip": """
        SELECT CAST(p_partkey AS VARCHAR) AS code, CASE p_partkey % 8
          WHEN 0 THEN p_name || ', ' || p_type WHEN 1 THEN 'the "' || p_name || '" kind'
          WHEN 2 THEN p_name || chr(10) || p_type WHEN 3 THEN '  ' || p_name WHEN 4 THEN p_name || '  '
          WHEN 5 THEN 'NA' WHEN 6 THEN '' END AS term
        FROM part""",
    "codeset_load": _study("""
        SELECT 'condition' AS name, '01/01/2001' AS version, 'med' AS kind, original_code AS code,
          min(concept_id) AS category FROM med_dict GROUP BY original_code
        UNION ALL SELECT 'drug', '01/01/2001', 'prod', prodcodeid, term FROM prod_dict
        UNION ALL SELECT 'outcome', '02/02/2001', 'med', medcodeid, term FROM med_dict"""),
    "codeset_version": _study("""
        SELECT 'condition' AS name, '01/01/2001' AS version, 'med' AS kind, original_code AS code,
          min(concept_id) AS category FROM med_dict GROUP BY original_code
        UNION ALL SELECT 'drug', '01/01/2001', 'prod', prodcodeid, term FROM prod_dict"""),
    "codeset_by_name": _study(
        "SELECT original_code AS code, min(concept_id) AS category FROM med_dict GROUP BY 1"
    ),
    "materialize_roundtrip": _study(f"SELECT {_COHORT} FROM diagnosed"),
    "patient_subset": _study("SELECT patid, obsdate, medcodeid FROM observation WHERE patid % 10 = 3"),
    "stored_patient_subsets": _study(
        "SELECT patid, count(*) AS events, min(obsdate) AS first_event FROM observation GROUP BY patid"
    ),
    "cohort_report_cols": _study("""
        SELECT patid, first_exposure AS index_date, end_date, round(age, 6) AS age, gender AS sex,
          case_control FROM cases"""),
    "cohort_union": _study(
        "SELECT patid, index_date, end_date, round(age, 6) AS age, sex, case_control FROM arms"
    ),
    "study_arms": _study(
        "SELECT patid, index_date, end_date, round(age, 6) AS age, sex, case_control FROM arms"
    ),
    "acceptable_patients": _study("SELECT * FROM patient WHERE acceptable <> 0"),
    "plausible_events": _study("""
        SELECT p.patid, yob, obsdate FROM patient p JOIN condition o ON p.patid = o.patid
        WHERE obsdate IS NOT NULL AND year(obsdate) > yob"""),
    "derive_dob": _study("SELECT patid, yob, mob, dob FROM born"),
    "age_at_event": _study(f"""
        SELECT patid, dob, first_exposure FROM born JOIN exposed USING (patid)
        WHERE date_diff('day', dob, first_exposure) >= {AGE}"""),
    "reached_age_65": _study(f"""
        SELECT patid, dob FROM born
        WHERE date_diff('day', dob, {END}) >= {AGE}
          AND (regenddate IS NULL OR date_diff('day', dob, regenddate) >= {AGE})
          AND (emis_ddate IS NULL OR date_diff('day', dob, emis_ddate) >= {AGE})"""),
    "case_cohort": _study(
        f"SELECT {_COHORT}, dob, first_exposure, lcd, end_date, round(age, 6) AS age, case_control FROM cases"
    ),
    "control_cohort": _study(
        f"SELECT {_COHORT}, dob, lcd, end_date, round(age, 6) AS age, case_control FROM controls"
    ),
    "follow_up_end": _study(f"""
        SELECT patid, pracid, lcd, least({END}, coalesce(regenddate, {END}), coalesce(emis_ddate, {END}),
          coalesce(lcd, {END})) AS end_date
        FROM patient JOIN practice USING (pracid)"""),
    "age_years": _study(f"SELECT patid, round(date_diff('day', dob, {END}) / 365.25, 6) AS age FROM born"),
    "age_by_calendar_year": _study("SELECT patid, yob FROM patient WHERE 2001 - yob >= 65"),
    "recode_sex": _study("SELECT patid, CASE WHEN gender = 1 THEN 0 ELSE 1 END AS sex FROM patient"),
    "term_search": _study("""
        SELECT * FROM prod_dict WHERE lower(term) LIKE '%red plate%' OR lower(substance) LIKE '%red plate%'
          OR lower(term) LIKE '%promo%' OR lower(substance) LIKE '%promo%'"""),
    "followup_filter": _study("""
        SELECT patid, index_date, end_date, round(age, 6) AS age, sex, case_control, subclass,
          new_index_date FROM followed"""),
    "coded_observations": _study("SELECT *, 'condition' AS category FROM condition"),
    "coded_outcomes": _study("SELECT * FROM outcome UNION ALL SELECT * FROM outcome2"),
    "coded_prescriptions": _study("SELECT * FROM exposure"),
    "patient_events": _study("""
        SELECT p.patid, p.pracid, gender, yob, obsdate, medcodeid
        FROM patient p JOIN observation o ON p.patid = o.patid"""),
    "never_exposed": _study("SELECT patid, first_obsdate, dob FROM never"),
    "cohort_complement": _study("SELECT patid FROM condition EXCEPT SELECT patid FROM exposure"),
    "cohort_overlap": _study("SELECT patid FROM condition INTERSECT SELECT patid FROM exposure"),
    "map_codes_primary": _study(f"SELECT * FROM med_dict WHERE original_code IN {_LEGACY}"),
    "map_codes_secondary": _study(f"SELECT * FROM med_dict WHERE concept_id IN {_CONCEPTS}"),
    "combine_codes": _study(
        f"SELECT * FROM med_dict WHERE original_code IN {_LEGACY} OR concept_id IN {_CONCEPTS}"
    ),
    "assign_index_date": _study(
        "SELECT patid, subclass, case_control, index_date, new_index_date FROM indexed"
    ),
    "subclass_index_date": _study("SELECT DISTINCT subclass, new_index_date FROM indexed"),
    "first_diagnosis": _study(f"SELECT {_COHORT} FROM diagnosed"),
    "first_exposure": _study("SELECT * FROM exposed"),
    "first_outcome": _study("SELECT * FROM first_out"),
    "distinct_patients": _study("SELECT DISTINCT patid FROM condition"),
    "count_distinct_patients": _study("SELECT count(DISTINCT patid) AS patients FROM observation"),
    "cohort_row_count": _study("SELECT count(*) AS n FROM controls"),
    "attrition": _study(" UNION ALL ".join(
        f"SELECT {number} AS step_no, '{step}' AS step, count(DISTINCT patid) AS patients FROM {table}"
        for number, (step, table) in enumerate([
            ("patients", "patient"), ("with any event", "observation"),
            ("with a condition code", "condition"),
            ("acceptable, dated, after birth year", "diagnosed"),
            ("exposed after it and at the age", f"""(SELECT patid FROM diagnosed JOIN exposed USING (patid)
              WHERE first_obsdate <= first_exposure AND date_diff('day', dob, first_exposure) >= {AGE})"""),
            ("exposed cohort", "cases"),
            ("reached the age", "reached"), ("never exposed", "never"), ("control pool", "controls"),
        ], start=1)
    )),
    "count_by_arm": _study("SELECT case_control, count(*) AS n FROM followed GROUP BY 1"),
    "crosstab_by_arm": _study("SELECT case_control, sex, count(*) AS n FROM followed GROUP BY 1, 2"),
    "age_summary": _study("""
        SELECT case_control, round(stddev_samp(age), 6) AS sd, round(avg(age), 6) AS mean,
          printf('%.2f - %.2f', min(age), max(age)) AS range, count(age) AS n
        FROM arms GROUP BY 1"""),
    "propensity_score": BASE + GLM + "SELECT patid, round(distance, 6) AS distance FROM fitted",
    "matched_cohort": MATCHED + """
        SELECT patid, subclass, round(weights, 6) AS weights, index_date, end_date, round(age, 6) AS age,
          sex, case_control, round(distance, 6) AS distance, new_index_date FROM matched""",
    "matched_outcomes": MATCHED + f"""
        SELECT patid, subclass, round(weights, 6) AS weights, index_date, end_date, round(age, 6) AS age,
          sex, case_control, round(distance, 6) AS distance, new_index_date, first_outcome,
          outcome_beforeindexdate, outcome_afterindexdate, outcome_beforeindex,
          outcome_in12monthsafterindex, outcome_anyafterindex
        FROM ({_with_outcome('matched', 'outcome', 'first_out')})""",
    "second_matched_outcomes": MATCHED + f"""
        SELECT c.patid, subclass, round(weights, 6) AS weights, c.index_date, c.end_date,
          round(c.age, 6) AS age, a.sex, c.case_control, round(distance, 6) AS distance, new_index_date,
          first_outcome, outcome_beforeindexdate AS second_beforeindexdate,
          outcome_afterindexdate AS second_afterindexdate, outcome_beforeindex AS second_beforeindex,
          outcome_in12monthsafterindex AS second_in12monthsafterindex,
          outcome_anyafterindex AS second_anyafterindex
        FROM ({_with_outcome('matched', 'outcome2', 'first_out2')}) c JOIN arms a ON a.patid = c.patid""",
    "match_nearest": _matching(2, "SELECT * FROM pairs"),
    "match_nearest_shortfall": _matching(10, "SELECT * FROM pairs"),
    "match_nearest_caliper": _matching(2, "SELECT * FROM pairs", caliper="30"),
    "match_nearest_blocks": BASE + _walk(10, scored=DISTINCT_SCORE) + "SELECT * FROM pairs",
    "matched_members": _matching(2, """
        SELECT patid, subclass, round(weights, 6) AS weights, case_control
        FROM members JOIN arms USING (patid)"""),
    "arm_sizes": _matching(2, """
        SELECT case_control, count(*) AS n, round(sum(weights) * sum(weights) / sum(weights * weights), 6)
          AS effective_n
        FROM members JOIN arms USING (patid) GROUP BY 1"""),
    "balance_unmatched": BASE + """,
        sample AS (
          SELECT case_control, age, CASE WHEN sex = 1 THEN 0 ELSE 1 END AS sex, 1.0 AS w FROM arms)"""
    + _balance("sample", "sample"),
    "balance_matched": BASE + _walk(2) + """,
        everyone AS (
          SELECT case_control, age, CASE WHEN sex = 1 THEN 0 ELSE 1 END AS sex, 1.0 AS w FROM arms),
        sample AS (
          SELECT case_control, age, CASE WHEN sex = 1 THEN 0 ELSE 1 END AS sex, weights AS w
          FROM members JOIN arms USING (patid))""" + _balance("sample", "everyone"),
    "report_crosstabs": REPORTED + " UNION ALL ".join(
        f"SELECT case_control, '{c}' AS variable, CAST({c} AS INTEGER) AS level, count(*) AS n FROM result GROUP BY ALL"
        for c in ("sex", "outcome_beforeindex", "outcome_in12monthsafterindex", "outcome_anyafterindex")
    ),
    "report_flags": REPORTED + " UNION ALL ".join(
        f"SELECT '{c}' AS variable, count(*) FILTER ({c} = 1) AS n FROM result"
        for c in ("outcome_beforeindex", "outcome_in12monthsafterindex", "outcome_anyafterindex")
    ),
    "report_flag_levels": REPORTED + " UNION ALL ".join(
        f"SELECT '{c}' AS variable, CAST({c} AS INTEGER) AS level, count(*) AS n FROM result GROUP BY 2"
        for c in ("outcome_beforeindex", "outcome_in12monthsafterindex", "outcome_anyafterindex")
    ),
    "report_ages": REPORTED + """
        SELECT case_control, round(stddev_samp(age), 6) AS sd, round(avg(age), 6) AS mean,
          printf('%.2f - %.2f', min(age), max(age)) AS range, count(age) AS n
        FROM result GROUP BY 1""",
    "report_balance": MATCHED + """,
        everyone AS (SELECT case_control, distance, age, sex, 1.0 AS w FROM fitted),
        sample AS (
          SELECT case_control, distance, age, sex, weights AS w FROM members JOIN fitted USING (patid))"""
    + _balance("sample", "everyone", ("distance", "age", "sex")),
    "report_sizes": MATCHED + """
        SELECT case_control, count(*) AS everyone, count(weights) AS matched,
          count(*) - count(weights) AS unmatched,
          round(sum(weights) * sum(weights) / sum(weights * weights), 6) AS effective_n
        FROM arms LEFT JOIN members USING (patid) GROUP BY 1""",
    "report_counts": REPORTED + """
        SELECT 'matched sets' AS measure, count(DISTINCT subclass) AS n FROM members
        UNION ALL SELECT 'matched members', count(*) FROM members
        UNION ALL SELECT 'members left by follow-up', count(*) FROM result
        UNION ALL SELECT 'exposed members left', count(*) FROM result WHERE case_control
        UNION ALL SELECT 'never exposed members left', count(*) FROM result WHERE NOT case_control""",
    "outcome_before": _study(f"""
        SELECT patid, new_index_date, first_outcome, outcome_beforeindexdate
        FROM ({_with_outcome('followed_cases', 'outcome', 'first_out')})"""),
    "outcome_after": _study(f"""
        SELECT patid, new_index_date, outcome_afterindexdate
        FROM ({_with_outcome('followed_cases', 'outcome', 'first_out')})"""),
    "outcome_after_censored": _study("""
        SELECT c.patid, new_index_date,
          min(obsdate) FILTER (obsdate > new_index_date AND obsdate <= end_date) AS outcome_afterindexdate
        FROM followed_cases c LEFT JOIN outcome o ON c.patid = o.patid GROUP BY 1, 2"""),
    "outcome_flags": _study(f"""
        SELECT patid, outcome_beforeindex, outcome_in12monthsafterindex, outcome_anyafterindex
        FROM ({_with_outcome('followed_cases', 'outcome', 'first_out')})"""),
    "outcome_positive": _study("""
        SELECT patid, new_index_date, first_outcome FROM followed_cases JOIN first_out2 USING (patid)"""),
    "outcome_table": _study(
        f"SELECT {_OUTCOME_COLUMNS} FROM ({_with_outcome('followed_cases', 'outcome', 'first_out')})"
    ),
    "second_outcome_table": _study(
        f"SELECT {_OUTCOME_COLUMNS} FROM ({_with_outcome('followed_cases', 'outcome2', 'first_out2')})"
    ),
    "summary_tables": _study(f""",
        result AS ({_with_outcome('followed', 'outcome', 'first_out')})
        """ + " UNION ALL ".join(
        f"SELECT case_control, '{c}' AS variable, CAST({c} AS INTEGER) AS level, count(*) AS n FROM result GROUP BY ALL"
        for c in ("sex", "outcome_beforeindex", "outcome_in12monthsafterindex", "outcome_anyafterindex")
    )),
    "prefix_code_match": f"""
        WITH {_LINES}, heading(icd10, subtype) AS (VALUES {_HEADINGS})
        SELECT * FROM lines l WHERE EXISTS (
          SELECT 1 FROM heading h
          WHERE subtype = 'all' AND starts_with(replace(l.icd10, '.', ''), replace(h.icd10, '.', '')))""",
    "event_subtypes": f"""
        WITH {_LINES}, heading(icd10, subtype) AS (VALUES {_HEADINGS})
        SELECT l.*, subtype FROM lines l JOIN (
          SELECT DISTINCT code.icd10, subtype FROM (SELECT DISTINCT icd10 FROM lines) code JOIN heading h
            ON starts_with(replace(code.icd10, '.', ''), replace(h.icd10, '.', ''))) USING (icd10)""",
    "classify_products": f"""
        WITH {_NAMES}, lookup AS (
          SELECT brand_name, min((generic_name, class)) AS meaning FROM (
            SELECT brand_name, generic_name, lower(class) AS class FROM names
            UNION SELECT generic_name, generic_name, 'generic' FROM names)
          WHERE generic_name <> 'anvil' GROUP BY brand_name),
        product AS (
          SELECT CAST(p_partkey AS VARCHAR) AS prodcodeid,
            ' ' || lower(p_type || ' ' || p_name || ' ' || p_size || 'mg') || ' ' AS text FROM part),
        hit AS (
          SELECT prodcodeid, brand_name, meaning, row_number() OVER (
            PARTITION BY prodcodeid
            ORDER BY len(string_split(brand_name, ' ')) DESC, strpos(text, ' ' || brand_name || ' ')) AS best
          FROM product JOIN lookup ON contains(text, ' ' || brand_name || ' '))
        SELECT prodcodeid, brand_name, struct_extract(meaning, 1) AS generic_name,
          struct_extract(meaning, 2) AS class FROM hit WHERE best = 1""",
    "lookup_conflicts": f"""
        WITH {_NAMES}
        SELECT 'name_listed_twice' AS issue, brand_name AS subject, count(*) AS n FROM names
        GROUP BY brand_name HAVING count(*) > 1
        UNION ALL
        SELECT 'id_with_several_generics', CAST(brand_id AS VARCHAR), count(DISTINCT generic_name) FROM names
        GROUP BY brand_id HAVING count(DISTINCT generic_name) > 1
        UNION ALL
        SELECT 'generic_with_several_classes', generic_name, count(DISTINCT class) FROM names
        GROUP BY generic_name HAVING count(DISTINCT class) > 1""",
    "reconcile_lists": """
        WITH a AS (SELECT p_partkey FROM part WHERE p_type IN ('PROMO', 'SMALL')),
          b AS (SELECT p_partkey FROM part WHERE p_name LIKE 'red %')
        SELECT CAST(coalesce(a.p_partkey, b.p_partkey) AS VARCHAR) AS code,
          CASE WHEN a.p_partkey IS NULL THEN 0 ELSE 1 END AS cal,
          CASE WHEN b.p_partkey IS NULL THEN 0 ELSE 1 END AS os,
          CASE WHEN a.p_partkey IS NULL THEN 0 ELSE 1 END + CASE WHEN b.p_partkey IS NULL THEN 0 ELSE 1 END
            AS matchtotal
        FROM a FULL OUTER JOIN b ON a.p_partkey = b.p_partkey""",
    "included_codes": """
        SELECT CAST(p_partkey AS VARCHAR) AS code, 1 AS cal,
          CASE WHEN p_name LIKE 'red %' THEN 1 ELSE 0 END AS os,
          CASE WHEN p_name LIKE 'red %' THEN 2 ELSE 1 END AS matchtotal, 1 AS include
        FROM part WHERE p_type IN ('PROMO', 'SMALL')""",
    "final_code": """
        SELECT p_partkey, substr(p_brand, 1, 5) AS readcode,
          CASE WHEN p_size > 20 THEN p_brand || '.' || p_type WHEN p_size > 10 THEN 'NA' END AS cleansed_code,
          CASE WHEN p_size > 20 THEN p_brand || '.' || p_type ELSE substr(p_brand, 1, 5) END AS final_code
        FROM part""",
    "link_by_stem": """
        SELECT p_partkey, replace(p_brand, 'Brand#', 'E0') AS cleansed_code,
          'E0' || n_nationkey AS readcode, n_name AS term
        FROM part JOIN nation ON substr(replace(p_brand, 'Brand#', 'E0'), 1, 5) = 'E0' || n_nationkey""",
    "code_list_issues": """
        WITH listed AS (
          SELECT trim(CASE WHEN p_size <= 5 THEN ' ' WHEN p_size <= 15 THEN p_size || '.25E+14'
            WHEN p_size <= 30 THEN '8' || p_partkey ELSE p_brand || '-' || p_size END) AS code FROM part),
          counted AS (SELECT code, count(*) AS n FROM listed GROUP BY code)
        SELECT code, 'blank' AS issue, n FROM counted WHERE code = ''
        UNION ALL SELECT code, 'rounded', n FROM counted WHERE code LIKE '%E+%'
        UNION ALL SELECT code, 'duplicate', n FROM counted WHERE code <> '' AND n > 1""",
    "build_code_set": _study(f"""
        SELECT 'med' AS kind, medcodeid AS code, term AS category, 'condition' AS name,
          '01/01/2001' AS version
        FROM med_dict WHERE original_code IN {_LEGACY} OR concept_id IN {_CONCEPTS}"""),
    "build_drug_code_set": _study("""
        SELECT 'prod' AS kind, prodcodeid AS code, term AS category, 'drug' AS name, '01/01/2001' AS version
        FROM prod_dict WHERE lower(term) LIKE '%red plate%' OR lower(substance) LIKE '%red plate%'"""),
    "register_prepared_list": _study("""
        SELECT 'med' AS kind, medcodeid AS code, term AS category, 'prepared' AS name,
          '02/02/2001' AS version FROM med_dict"""),
    "draft_cohort_overlap": _study("""
        SELECT DISTINCT patid FROM patient
        WHERE 2001 - yob >= 65 AND patid IN (SELECT patid FROM condition)
          AND patid IN (SELECT patid FROM exposure)"""),
    "draft_cohort_complement": _study("""
        SELECT DISTINCT patid FROM patient
        WHERE 2001 - yob >= 65 AND patid IN (SELECT patid FROM condition)
          AND patid NOT IN (SELECT patid FROM exposure)"""),
    "draft_case_cohort": _study(f"""
        SELECT d.patid, pracid, regenddate, emis_ddate, yob, mob, first_obsdate, dob, lcd,
          least({END}, coalesce(regenddate, {END}), coalesce(emis_ddate, {END}), coalesce(lcd, {END})) AS end_date
        FROM (
          SELECT p.patid, p.pracid, regenddate, emis_ddate, yob, mob, dob, min(obsdate) AS first_obsdate
          FROM born p JOIN condition o ON p.patid = o.patid WHERE acceptable <> 0 GROUP BY ALL) d
        JOIN (
          SELECT p.patid, min(issuedate) AS first_exposure
          FROM patient p JOIN exposure e ON p.patid = e.patid WHERE acceptable <> 0 GROUP BY p.patid) e
          ON d.patid = e.patid
        JOIN practice USING (pracid)
        WHERE first_obsdate <= first_exposure AND date_diff('day', dob, first_exposure) >= {AGE}"""),
    "draft_control_cohort": _study(f"""
        SELECT patid, pracid, regenddate, emis_ddate, yob, mob, first_obsdate, dob FROM (
          SELECT p.patid, p.pracid, regenddate, emis_ddate, yob, mob, dob, min(obsdate) AS first_obsdate
          FROM born p JOIN condition o ON p.patid = o.patid WHERE acceptable <> 0 GROUP BY ALL)
        WHERE date_diff('day', dob, {END}) >= {AGE} AND date_diff('day', dob, regenddate) >= {AGE}
          AND date_diff('day', dob, emis_ddate) >= {AGE} AND patid NOT IN (SELECT patid FROM exposure)"""),
    "draft_reached_age": _study(f""",
        aged AS (SELECT * FROM born WHERE date_diff('day', dob, {END}) >= {AGE})
        SELECT 'left, must exist' AS rule, count(*) AS patients FROM aged
        WHERE date_diff('day', dob, regenddate) >= {AGE}
        UNION ALL SELECT 'died, must exist', count(*) FROM aged WHERE date_diff('day', dob, emis_ddate) >= {AGE}
        UNION ALL SELECT 'both must exist', count(*) FROM aged
        WHERE date_diff('day', dob, regenddate) >= {AGE} AND date_diff('day', dob, emis_ddate) >= {AGE}
        UNION ALL SELECT 'missing means study end', count(*) FROM aged
        WHERE date_diff('day', dob, coalesce(regenddate, {END})) >= {AGE}
          AND date_diff('day', dob, coalesce(emis_ddate, {END})) >= {AGE}"""),
}

# The same rows by another way of storing the inputs.
ORACLE["stored_matched_outcomes"] = ORACLE["matched_outcomes"]
ORACLE["events_stored_by_code"] = ORACLE["coded_outcomes"]
