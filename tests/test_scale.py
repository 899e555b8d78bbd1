"""The ways taken beyond a size bound give the same rows, and plans avoid shuffles."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cohortloom.operators import events as E, summary as S
from cohortloom.operators.joins import lookup_join
from cohortloom.operators.matching import assign_index, matched_members
from cohortloom.operators.numbering import number_rows, running_total
from cohortloom.operators.propensity import NotConverged, propensity_score
from cohortloom.plans import study
from cohortloom.session import shared_folder, stage, stage_measured
from cohortloom.sources import tables as T
from cohortloom.sources.workspace import Workspace, in_slots


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("bound", [{"max_rows": 1}, {"max_bytes": 1}])
def test_join_beyond_its_bounds_equals_broadcast_join(spark, how, bound):
    # One code holds most events.
    code = F.when(F.col("id") < 300, "hot").when(F.col("id") % 9 != 0, F.col("id").cast("string"))
    events = spark.range(400).select("id", code.alias("code"))
    events = events.unionByName(events.limit(3))
    rows = [("hot", 1), ("301", 2), ("301", 2), ("302", 3), ("none", 4), (None, 5)]
    small = spark.createDataFrame(rows, "code string, label int")
    wide, far = lookup_join(events, small, "code", how), lookup_join(events, small, "code", how, **bound)
    assert "BroadcastHashJoin" in plan(wide) and "SortMergeJoin" in plan(far)
    assert sorted(map(str, wide.collect())) == sorted(map(str, far.collect()))


def test_coded_events_do_not_shuffle(spark):
    events = spark.range(1000).select("id", (F.col("id") % 7).cast("string").alias("medcodeid"))
    codes = spark.createDataFrame([("3",)], "code string")
    assert "hashpartitioning" not in plan(E.coded_events(events, codes, "medcodeid"))


def test_running_totals_over_slices_equal_a_window(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.8 else rng.choice(["a", "b", None]), i, rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, k int, v bigint").repartition(3)
    small = running_total(df, ["g"], ["k"], F.col("v"), "t")
    large = running_total(df, ["g"], ["k"], F.col("v"), "t", window_rows=0)
    assert sorted(small.collect(), key=str) == sorted(large.collect(), key=str)
    assert large.where("g is null").count() > 10
    numbers = number_rows(df, [], ["k"], "n", window_rows=0)
    assert [r.n for r in numbers.orderBy("k").collect()] == list(range(500))


def test_shared_folder_follows_the_session_setting(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    kept = stage(spark.range(5))
    assert kept.count() == 5 and shared_folder(spark) in kept.inputFiles()[0]
    kept, seen = stage_measured(spark.range(5), "m", total=F.sum("id"))
    assert seen["total"] == 10


def test_clustered_tables_join_and_group_without_a_shuffle(spark, tmp_path):
    place = Workspace(spark, str(tmp_path), "study")
    a = place.cached("a", spark.range(100).withColumnRenamed("id", "patid"), ["patid"], buckets=4)
    b = place.cached("b", spark.range(50, 150).withColumnRenamed("id", "patid"), ["patid"], buckets=4)
    joined = a.hint("merge").join(b, "patid").groupBy("patid").count()
    assert "Exchange" not in plan(joined)
    assert joined.count() == 50
    # A stored table is read back, not computed again; also by a session that has not seen it.
    name = next(t.name for t in spark.catalog.listTables() if t.name.startswith("study_a_"))
    spark.sql(f"DROP TABLE {name}")
    again = place.cached("a", spark.range(3).withColumnRenamed("id", "patid"), ["patid"], buckets=4)
    assert again.count() == 100
    assert place.cached("c", spark.range(3)).count() == place.cached("c", spark.range(9)).count() == 3
    assert place.cached("c", spark.range(9), overwrite=True).count() == place.table("c").count() == 9
    hot = spark.range(20).selectExpr("0L AS patid", "id")
    kept = place.cached("hot", hot, ["patid"], buckets=4, rows_per_key=10)
    assert kept.count() == place.table("hot").count() == 20
    assert "plain" in kept.inputFiles()[0]
    # Another form in place of a clustered table leaves nothing of it, also for a reader of the table itself.
    hot = spark.range(50).selectExpr("0L AS patid")
    kept = place.cached("a", hot, ["patid"], buckets=4, overwrite=True, rows_per_key=10)
    assert kept.count() == place.table("a").count() == place.cached("a", hot, ["patid"], buckets=4).count() == 50
    doubled = place.table("a").unionByName(place.table("a"))
    assert place.cached("a", doubled, overwrite=True).count() == place.table("a").count() == 100
    # A workspace of the same prefix elsewhere is another one.
    other = Workspace(spark, str(tmp_path / "other"), "study")
    assert other.cached("b", spark.range(3).withColumnRenamed("id", "patid"), ["patid"], buckets=4).count() == 3
    with pytest.raises(KeyError):
        place.table("absent")


def test_stored_tables_keep_their_layout(spark, tmp_path):
    place = Workspace(spark, str(tmp_path), "layout")
    people = spark.range(2000).select(F.col("id").alias("patid"), (F.col("id") % 7).alias("other"))
    a = place.cached("a", people, ["patid"], buckets=4)
    place.cached("b", people, ["patid"], buckets=8)
    manifest = place.manifests("a")[-1]
    assert (manifest["keys"], manifest["buckets"], manifest["rows"]) == (["patid"], 4, 2000)
    for table in spark.catalog.listTables():
        if table.name.startswith("layout_"):
            spark.sql(f"DROP TABLE {table.name}")
    # A session that knows nothing of the table, asked for other buckets and other keys.
    b = place.cached("b", people.limit(1), ["patid"], buckets=8)
    for keys, buckets in ((["patid"], 8), (["other"], 4), (["other", "patid"], 3), (None, 0)):
        again = place.cached("a", people.limit(1), keys, buckets)
        assert again.dtypes == people.dtypes and again.count() == 2000
        for hint in ("merge", "shuffle_hash"):
            assert again.hint(hint).join(b, "patid").count() == 2000
        assert again.groupBy("other").count().count() == 7
    # An overwrite leaves those alone who read the version before.
    new = place.cached("a", people.where("patid < 10"), ["patid"], buckets=2, overwrite=True)
    assert new.count() == place.table("a").count() == 10 and a.join(b, "patid").count() == 2000
    assert place.table("a", manifest["version"]).count() == 2000
    # A write that fails is no version.
    bad = people.selectExpr("IF(patid = 1999, raise_error('stop'), patid) AS patid")
    for keys in (None, ["patid"]):
        with pytest.raises(Exception, match="stop"):
            place.cached("a", bad, keys, buckets=2, overwrite=True)
    assert place.table("a").count() == 10
    # Versions go some time after they were replaced.
    brief = Workspace(spark, str(tmp_path), "layout", retained=0)
    brief.cached("a", people.where("patid < 20"), overwrite=True)
    assert len(brief.manifests("a")) == 1 and brief.table("a").count() == 20


def exchanged_tables(df):
    """Paths or names of scans that lie below a shuffle of the executed plan."""
    text = df._jdf.queryExecution().executedPlan().toString()
    found, depths = [], []
    for line in text.splitlines():
        depth = len(re.match(r"[\s:|+\-*()0-9]*", line).group())
        depths = [d for d in depths if d < depth]
        if "Exchange hashpartitioning" in line:
            depths.append(depth)
        if "FileScan" in line and depths:
            found.append(line)
    return found


def test_the_study_on_stored_events_moves_no_event(spark, tmp_path):
    rng = random.Random(4)
    day = lambda: F.to_date(F.lit(f"{rng.randint(1990, 2020)}-0{rng.randint(1, 9)}-11"))
    patients = spark.range(200).select(
        F.col("id").alias("patid"), (F.col("id") % 3).cast("int").alias("pracid"), F.lit(1).alias("acceptable"), (F.col("id") % 2).cast("int").alias("gender"),
        F.lit(1930).alias("yob"), F.lit(None).cast("int").alias("mob"), F.lit(None).cast("date").alias("regenddate"), F.lit(None).cast("date").alias("emis_ddate"),
    )
    practices = spark.range(3).select(F.col("id").cast("int").alias("pracid"), F.lit(None).cast("date").alias("lcd"))
    condition = spark.range(400).select((F.col("id") % 200).alias("patid"), day().alias("obsdate"))
    exposure = spark.range(40).select((F.col("id") % 30).alias("patid"), day().alias("issuedate"))
    outcome = spark.range(300).select((F.col("id") % 150).alias("patid"), day().alias("obsdate"))
    place = Workspace(spark, str(tmp_path), "moved")
    stored = study.stored_inputs(place, patients, condition, exposure, outcome, buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rules = study.Rules(ratio=2)
        arms = study.study_arms(stored[0], practices, *stored[1:3], rules)
        assert not [line for line in exchanged_tables(arms) if "_events" in line]
        assert exchanged_tables(study.study_arms(patients, practices, stage(condition), stage(exposure), rules))
        cohort = place.cached("cohort", arms.withColumn("new_index_date", F.to_date(F.lit("2005-01-01"))), ["patid"], buckets=4)
        outcomes = study.outcome_table(cohort, stored[0], stored[3])
        assert not exchanged_tables(outcomes) and "SortMergeJoin" in plan(outcomes)
        plain = study.outcome_table(stage(cohort), patients, outcome)
        assert sorted(map(str, outcomes.collect())) == sorted(map(str, plain.collect())) and outcomes.count() > 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_subset_reads_its_own_buckets_only(spark, tmp_path):
    place = Workspace(spark, str(tmp_path), "subset")
    rows = spark.range(3000).select(
        F.when(F.col("id") % 50 > 0, F.col("id") % 170).alias("patid"), F.col("id").alias("event"), F.lit("x").alias("file_name")
    )
    place.cached("events", rows, ["patid"], buckets=8)
    place.cached("plain", rows)

    def told(df):
        return sorted(map(str, df.collect()))

    slots = [told(place.subset("events", ["patid"], 4, [k])) for k in range(4)]
    assert sorted(sum(slots, [])) == told(rows) and all(slots)
    for k in range(4):
        assert told(place.subset("plain", ["patid"], 4, [k])) == told(rows.where(in_slots(["patid"], 4, [k]))) == slots[k]
    # Slots that are no part of the buckets are a filter; so are other keys.
    assert sorted(sum([told(place.subset("events", ["patid"], 3, [k])) for k in range(3)], [])) == told(rows)
    assert told(place.subset("events", ["event"], 2, [1])) == told(rows.where(in_slots(["event"], 2, [1])))
    assert told(place.subset("events", ["patid"], 4, [])) == [] and told(place.subset("events", ["patid"], 4, [0, 1, 2, 3])) == told(rows)
    with pytest.raises(KeyError):
        place.subset("none", ["patid"], 4, [0])
    # Files of other buckets are not even opened, and the groups need no exchange.
    spoiled = 0
    for file in tmp_path.rglob("part-*.parquet"):
        found = re.search(r"_(\d+)(?:\.|$)", file.name)
        if found and int(found.group(1)) % 4 != 2:
            file.write_bytes(b"spoiled")
            spoiled += 1
    assert spoiled == 6
    own = place.subset("events", ["patid"], 4, [2])
    assert told(own) == slots[2]
    assert "Exchange" not in plan(own.groupBy("patid").count())
    with pytest.raises(Exception):
        place.subset("events", ["patid"], 4, [1]).collect()


def test_levels_of_flags(spark):
    rows = [(1, 0, 1), (1, 0, 0), (0, 0, None)]
    df = spark.createDataFrame(rows, "o_beforeindex int, o_in12monthsafterindex int, o_anyafterindex int")
    assert sorted(map(tuple, S.flag_levels(df, "o").collect()), key=str) == sorted([
        ("o_beforeindex", 0, 1), ("o_beforeindex", 1, 2), ("o_in12monthsafterindex", 0, 3),
        ("o_anyafterindex", 0, 1), ("o_anyafterindex", 1, 1), ("o_anyafterindex", None, 1),
    ], key=str)


def rows_scanned(df):
    """Rows that the scan of a plan has put out."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan()
    found = re.findall(r"FileScan.*", leaf.toString())
    assert len(found) == 1, found
    node = leaf
    while node.children().size():
        node = node.children().head()
    if not node.metrics().contains("numOutputRows"):
        node = node.executedPlan() if hasattr(node, "executedPlan") else node
        while node.children().size():
            node = node.children().head()
    return node.metrics().apply("numOutputRows").value()


def test_codes_reach_the_reader(spark, tmp_path):
    events = spark.range(60_000).select(
        (F.col("id") % 500).alias("patid"), F.format_string("%06d", F.pmod(F.xxhash64("id"), F.lit(3000))).alias("medcodeid")
    )
    stored = E.by_code(events, str(tmp_path / "by-code"), "medcodeid", files=12, row_group_bytes=8192)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        read = {}
        for n in (1, 40, 2000):
            codes = spark.createDataFrame([(f"{k:06d}",) for k in range(100, 100 + n)] + [("000100",), (None,)], "code string")
            got = E.coded_events(stored, codes, "medcodeid")
            assert re.search(r"PushedFilters: \[[^]]*(In\(medcodeid|EqualTo\(medcodeid)", plan(got)), plan(got)
            want = events.join(codes.distinct(), F.col("medcodeid") == F.col("code"), "left_semi")
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
            read[n] = rows_scanned(got)
        assert read[1] < 0.15 * 60_000 and read[1] < read[40] + 1 and read[40] < 0.3 * 60_000 < read[2000]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_larger_code_sets_are_joined(spark, monkeypatch):
    events = spark.range(300).select("id", (F.col("id") % 50).cast("string").alias("medcodeid"))
    codes = spark.createDataFrame([(str(k), f"c{k}") for k in range(20)] + [(None, "n")], "code string, category string")
    near = [sorted(map(str, E.coded_events(events, codes, "medcodeid", category=c).collect())) for c in (False, True)]
    monkeypatch.setattr(E, "PUSHED_CODES", 5)
    far = [sorted(map(str, E.coded_events(events, codes, "medcodeid", category=c).collect())) for c in (False, True)]
    assert near == far and len(near[0]) == len(near[1]) == 120
    assert E.coded_events(events, codes.limit(0), "medcodeid").count() == 0


def test_record_tables_are_read_with_their_schemas(spark, tmp_path):
    rows = {
        T.read_patients: ("SELECT 1L patid, 2 pracid, 1 acceptable, 1 gender, 1930 yob, CAST(NULL AS INT) mob, "
                          "DATE '2000-01-01' regenddate, CAST(NULL AS DATE) emis_ddate"),
        T.read_observations: "SELECT 1L patid, 2 pracid, '12345678901234567' medcodeid, DATE '2000-01-01' obsdate, DATE '2000-01-02' enterdate",
        T.read_drug_issues: "SELECT 1L patid, '12345678901234567' prodcodeid, DATE '2000-01-01' issuedate",
        T.read_practices: "SELECT 2 pracid, DATE '2000-01-01' lcd",
    }
    for read, sql in rows.items():
        path = str(tmp_path / read.__name__)
        spark.sql(sql).write.parquet(path)
        got = read(spark, path)
        assert got.collect() == spark.sql(sql).collect()
        assert f"ReadSchema: struct<{got.columns[0]}:" in plan(got.select(got.columns[0]))
        spark.sql(sql).drop(got.columns[-1]).write.parquet(path + "-short")
        with pytest.raises(T.MissingColumns):
            read(spark, path + "-short")


def test_propensity_equals_the_likelihood_maximum(spark):
    rng = random.Random(2)
    rows = [(i, rng.random() < 0.2 + 0.1 * (i % 4), float(i % 4), i % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "patid int, arm boolean, x double, sex int")
    got = propensity_score(df, "arm", ["x", "sex"]).collect()
    # Score equations: residuals are orthogonal to every covariate.
    for pick in (lambda r: 1.0, lambda r: r.x, lambda r: r.sex):
        assert sum((r.arm - r.distance) * pick(r) for r in got) == pytest.approx(0, abs=1e-6)


def test_propensity_reports_what_it_cannot_fit(spark):
    separated = spark.createDataFrame([(i, i >= 10, float(i)) for i in range(20)], "patid int, arm boolean, x double")
    with pytest.raises(NotConverged):
        propensity_score(separated, "arm", ["x"])
    with pytest.raises(ValueError):
        propensity_score(separated.where("arm"), "arm", ["x"])


def test_members_weights_and_index_dates(spark):
    pairs = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1)], "case_id bigint, control_id bigint, match_round int")
    people = spark.createDataFrame(
        [(1, "2001-01-01"), (2, "2002-02-02"), (10, None), (11, None), (12, None), (13, None)], "patid bigint, d string"
    ).select("patid", F.to_date("d").alias("index_date"))
    got = {r.patid: (r.subclass, r.weights, str(r.new_index_date)) for r in assign_index(matched_members(pairs, people)).collect()}
    assert got == {
        1: (1, 1.0, "2001-01-01"), 10: (1, 0.5, "2001-01-01"), 11: (1, 0.5, "2001-01-01"),
        2: (2, 1.0, "2002-02-02"), 12: (2, 1.0, "2002-02-02"),
    }


def test_balance_beyond_the_window_bound(spark):
    rng = random.Random(9)
    rows = [(i % 3 == 0, rng.gauss(70, 8), rng.randint(0, 1), rng.random() + 0.1) for i in range(300)]
    df = spark.createDataFrame(rows, "arm boolean, age double, sex int, w double")
    near = {r.covariate: r for r in S.balance(df, "arm", ["age", "sex"], "w").collect()}
    far = {r.covariate: r for r in S.balance(df, "arm", ["age", "sex"], "w", window_rows=0).collect()}
    for name, row in near.items():
        assert [far[name][c] is None if v is None else far[name][c] == pytest.approx(v) if isinstance(v, float) else True
                for c, v in row.asDict().items()] == [True] * len(row)
    treated = [(a, w) for arm, a, _, w in rows if arm]
    assert near["age"].mean_treated == pytest.approx(sum(a * w for a, w in treated) / sum(w for _, w in treated))
