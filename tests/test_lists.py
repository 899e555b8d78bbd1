"""Code lists: text files, prefixes, names and quality checks."""

import random
import re

import pytest

from cohortloom.operators import codes as K, lists as L
from cohortloom.plans import codebooks
from cohortloom.sources import codesets, text


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def write(path, content, encoding="utf-8"):
    path.write_bytes(content.encode(encoding))
    return str(path)


def test_code_list_with_mark_blanks_and_carriage_returns(spark, tmp_path):
    path = write(tmp_path / "codes.csv", "﻿Read_Codes\r\nAb00\r\n\r\n Ab001 \r\n\r\n12345678901234567\r\n")
    assert values(text.read_code_list(spark, path), "code") == [("12345678901234567",), ("Ab00",), ("Ab001",)]


def test_ragged_rows_keep_the_columns_before_the_text(spark, tmp_path):
    path = write(
        tmp_path / "ragged.csv",
        "Observations,MedCodeId,Term,Release\n5,111,Plain,1\n6,222,Two, with comma,1\n7,333,NA,1\n",
    )
    got = text.read_code_list(spark, path, ",", "MedCodeId", keep=["Observations"])
    assert values(got, "code", "Observations") == [("111", "5"), ("222", "6"), ("333", "7")]


def test_round_trip_quotes_separators(spark, tmp_path):
    rows = [("1", 'a, "b"'), ("2", None), ("12345678901234567", "tab\there")]
    df = spark.createDataFrame(rows, "code string, term string")
    for sep in (",", "\t"):
        path = str(tmp_path / f"out{ord(sep)}")
        text.write_code_list(df, path, sep)
        assert values(text.read_code_list(spark, path, sep, "code", keep=["term"]), "code", "term") == sorted(rows, key=str)
    rows = [("1", "  lead"), ("2", "NA"), ("3", ""), ("4", "line\nbreak"), ("5", "trail  "), ("6", None), ("7", 'a "b",\r\nc')]
    df = spark.createDataFrame(rows, "code string, term string")
    text.write_code_list(df, str(tmp_path / "exact"), null_text="\\N")
    got = text.read_code_list(spark, str(tmp_path / "exact"), column="code", keep=["term"], null_text="\\N")
    assert values(got, "code", "term") == rows


def quoted_lines(rng, end):
    """Lines of three cells, many of them quoted, with separators, quotes and line breaks inside."""

    def cell():
        if rng.random() < 0.4:
            return rng.choice(["", "NA", '5" pipe', 'a"b', "é", " x y ", "z" * 40])
        inside = "".join(rng.choice(["a", '"', '"', ",", "\n", end, " ", "é", "\t", "NA"]) for _ in range(rng.randint(0, 7)))
        return '"' + inside.replace('"', '""') + '"' + rng.choice(["", "", "", "x", ' "y"'])

    lines = []
    for k in range(80):
        lines.append(",".join([str(k), cell(), cell()]) + end)
        if rng.random() < 0.1:
            lines.append(end)
    return "".join(lines)


@pytest.fixture
def small_splits(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"]

    def cut(size):
        for name, value in zip(names, (size, 1, 1)):
            spark.conf.set(name, value)

    yield cut
    for name in names:
        spark.conf.unset(name)


@pytest.mark.parametrize("end, header", [("\n", "code,term,more"), ("\r\n", "code,term,more"), ("\n", 'code,"te\nrm",more')])
def test_quoted_text_reads_alike_from_any_split(spark, tmp_path, small_splits, end, header):
    rng = random.Random(len(end + header))
    folder = tmp_path / "lists"
    folder.mkdir()
    for k in range(2):
        write(folder / f"{k}.csv", header + end + quoted_lines(rng, end))
    whole = spark.read.csv(str(folder), header=True, sep=",", quote='"', escape='"', nullValue="NA", multiLine=True)

    def told(df):
        # Where text follows a closing quote, the reader of whole files turns breaks of the cell into line feeds; here they stay.
        return sorted(str(r).replace("\\r\\n", "\\n") for r in df.toDF("code", "term", "more").collect())

    want = told(whole)
    assert len(want) == 160
    for size in (1 << 27, 400, 61):
        small_splits(size)
        assert told(text._read_text(spark, str(folder), ",", "NA")) == want
    assert spark.read.text(str(folder)).select("_metadata.file_block_start").distinct().count() > 16


def test_a_cell_over_many_splits_and_an_open_quote(spark, tmp_path, small_splits):
    long = "\n".join(f"line {k}, of \"\"many\"\"" for k in range(40))
    path = write(tmp_path / "long.csv", f'code,term\n1,a\n2,"{long}"\n3,b\n\n4,"open\nto the end\n')
    small_splits(64)
    got = dict(values(text.read_code_list(spark, path, ",", "code", keep=["term"]), "code", "term"))
    assert got["1"] == "a" and got["2"] == long.replace('""', '"') and got["3"] == "b"
    assert got["4"].startswith("open\nto the end") and len(got) == 4
    kept = write(tmp_path / "kept.csv", 'code,term\r\n1,"p\r\nq"\r\n2,"p\nq"\r\n')
    assert values(text.read_code_list(spark, kept, ",", "code", keep=["term"]), "term") == [("p\nq",), ("p\r\nq",)]
    nothing = write(tmp_path / "none.csv", "code,term\n")
    assert text.read_code_list(spark, nothing, ",", "code", keep=["term"]).count() == 0


def test_dictionary_ids_stay_text(spark, tmp_path):
    path = write(
        tmp_path / "product.txt",
        "ProdCodeId\tdmdid\tTerm.from.EMIS\tProductName\tDrugSubstanceName\tDrugIssues\r\n"
        "12345678901234567\t0012\tDrug A 1mg\tDrug A\tAlpha\t300\r\n",
    )
    row = text.read_dictionary(spark, path, "prod").first()
    assert (row.prodcodeid, row.dmdid, row.term, row.substance, row.drug_issues, row.route) == (
        "12345678901234567", "0012", "Drug A 1mg", "Alpha", 300, None
    )


def test_code_sets_by_version_and_replacement(spark, tmp_path):
    path = str(tmp_path / "sets")
    first = spark.createDataFrame([("a", "x"), ("a", "w"), ("b", "y"), (" ", "z"), (None, "z")], "code string, term string")
    codesets.save_code_set(first, path, "one", "19/06/2023", "med", "code", "term")
    codesets.save_code_set(first, path, "two", "03/08/2023", "prod", "code")
    codesets.save_code_set(first.where("code = 'b'"), path, "two", "03/08/2023", "prod", "code")
    sets = codesets.read_code_sets(spark, path)
    assert values(codesets.code_set(sets, "one", "19/06/2023"), "code", "category") == [("a", "w"), ("b", "y")]
    assert values(codesets.all_code_sets(sets, "03/08/2023"), "name", "code", "kind") == [("two", "b", "prod")]


def test_an_empty_list_replaces_and_readers_see_whole_sets(spark, tmp_path):
    path = str(tmp_path / "sets")
    assert codesets.read_code_sets(spark, path).count() == 0
    first = spark.createDataFrame([("a", "x"), ("b", "y")], "code string, term string")
    for name in ("one", "two"):
        codesets.save_code_set(first, path, name, "19/06/2023", "med", "code", "term")
    opened = codesets.read_code_sets(spark, path)
    codesets.save_code_set(first.limit(0), path, "one", "19/06/2023", "med", "code", "term")
    codesets.retire_code_set(spark, path, "two", "never", "med")
    sets = codesets.read_code_sets(spark, path)
    assert codesets.code_set(sets, "one", "19/06/2023").count() == 0
    assert values(codesets.code_set(sets, "two", "19/06/2023"), "code") == [("a",), ("b",)]
    # What was opened before stays what it was.
    assert opened.count() == 4
    # A write that fails half way is not seen.
    bad = spark.range(4000).repartition(4).selectExpr("CAST(IF(id = 3999, raise_error('stop'), id) AS STRING) AS code")
    with pytest.raises(Exception, match="stop"):
        codesets.save_code_set(bad, path, "two", "19/06/2023", "med", "code")
    assert values(codesets.code_set(codesets.read_code_sets(spark, path), "two", "19/06/2023"), "code") == [("a",), ("b",)]
    codesets.save_code_set(first.where("code = 'b'"), path, "one", "19/06/2023", "med", "code", "term")
    assert values(codesets.code_set(codesets.read_code_sets(spark, path), "one", "19/06/2023"), "code", "category") == [("b", "y")]


def test_term_search_looks_into_both_columns(spark):
    df = spark.createDataFrame(
        [("1", "ALPHA tab", None), ("2", "brand", "alpha"), ("3", None, "beta"), ("4", "gamma", "x")],
        "prodcodeid string, term string, substance string",
    )
    assert values(K.search_terms(df, ["term", "substance"], ["alpha", "bet.$"]), "prodcodeid") == [("1",), ("2",), ("3",)]
    assert values(K.search_terms(df, ["term"], ["bet."], regex=False), "prodcodeid") == []
    assert values(K.search_terms(df, ["term"], ["gamma", "", "  "]), "prodcodeid") == [("4",)]
    for terms in ([], [""], [" "]):
        with pytest.raises(ValueError):
            K.search_terms(df, ["term"], terms)


def test_code_found_through_both_systems_is_kept_once(spark):
    dictionary = spark.createDataFrame(
        [("m1", "t1", "R1", "S1"), ("m2", "t2", "R2", "S9"), ("m3", "t3", "R9", "S3"), ("m4", "t4", "R9", "S9")],
        "medcodeid string, term string, original_code string, concept_id string",
    )
    legacy = spark.createDataFrame([("R1",), ("R2",), ("R2",)], "code string")
    concepts = spark.createDataFrame([("S1",), ("S3",)], "code string")
    got = codebooks.condition_code_set(dictionary, legacy, concepts, "c", "v")
    assert values(got, "code", "category") == [("m1", "t1"), ("m2", "t2"), ("m3", "t3")]


def test_heading_covers_its_subcodes(spark):
    events = spark.createDataFrame([(i, c) for i, c in enumerate(["I610", "I61.9", "I6", "I62", "I61", None])], "id int, code string")
    heading = spark.createDataFrame([("I61",), ("I61.9",), ("G46.3",)], "icd10 string")
    assert values(L.prefix_coded_events(events, heading, "code"), "code") == [("I61",), ("I61.9",), ("I610",)]


def test_labels_equal_a_pairwise_prefix_test(spark):
    rng = random.Random(3)
    codes = ["".join(rng.choice("AB1.") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    lists = [("".join(rng.choice("AB1") for _ in range(rng.randint(1, 3))), rng.choice("xyz")) for _ in range(12)]
    events = spark.createDataFrame(list(enumerate(codes)), "id int, code string")
    got = values(L.label_events(events, spark.createDataFrame(lists, "icd10 string, subtype string"), "code"), "id", "subtype")
    want = sorted(
        {(i, s) for i, c in enumerate(codes) for p, s in lists if c.replace(".", "").startswith(p)}, key=str
    )
    assert got == want


def test_longest_name_wins_on_whole_words(spark):
    lookup = spark.createDataFrame(
        [
            (1, "Alpha", "alpha", "typical"), (1, "alpha  depot", "alpha", "typical"),
            (2, "betan", "beta", "atypical"), (3, "alpha depot plus", "combo", "atypical"),
            (4, "gamma", "gamma", "typical"),
        ],
        "brand_id int, brand_name string, generic_name string, class string",
    )
    products = spark.createDataFrame(
        [("1", "ALPHA 5mg"), ("2", "Alpha-Depot 5mg"), ("3", "betani"), ("4", "x betan, alpha"),
         ("5", "alpha depot plus gamma"), ("6", None), ("7", "gamma gamma")],
        "prodcodeid string, text string",
    )
    got = values(L.classify_products(products, lookup, "prodcodeid", "text"), "prodcodeid", "brand_name", "class")
    assert got == [
        ("1", "alpha", "typical"), ("2", "alpha depot", "typical"), ("4", "betan", "atypical"),
        ("5", "alpha depot plus", "atypical"), ("7", "gamma", "typical"),
    ]
    without = L.classify_products(products, lookup, "prodcodeid", "text", exclude_generics=["combo", "beta"])
    assert dict(values(without, "prodcodeid", "brand_name"))["5"] == "alpha depot"
    assert L.classify_products(products, lookup.where("false"), "prodcodeid", "text").count() == 0


def test_only_runs_that_can_begin_a_name_are_made(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(30)]
    names = {" ".join(rng.choices(vocabulary[:8], k=rng.randint(1, 4))) for _ in range(12)}
    lookup = spark.createDataFrame([(n, n[:2], "c") for n in names], "brand_name string, generic_name string, class string")
    texts = [(str(k), " ".join(rng.choices(vocabulary, k=rng.randint(0, 40)))) for k in range(200)]
    texts += [(f"n{k}", f"x {n} y") for k, n in enumerate(sorted(names))] + [("null", None)]
    products = spark.createDataFrame(texts, "id string, text string")

    def best(t):
        w = (t or "").split()
        found = [(-n, s, " ".join(w[s : s + n])) for n in range(1, 5) for s in range(len(w) - n + 1)]
        return min((f for f in found if f[2] in names), default=(0, 0, None))[2]

    want = {k: best(t) for k, t in texts if best(t)}
    known = L.product_names(lookup)
    made = {}
    for bound in (L.FIRST_WORDS, 1, 0):
        monkeypatch.setattr(L, "FIRST_WORDS", bound)
        assert dict(values(L.classify_products(products, lookup, "id", "text"), "id", "brand_name")) == want
        made[bound] = L.name_runs(products, known, "id", "text").count()
    hits = L.name_runs(products, known, "id", "text").join(known, "brand_name").count()
    assert hits <= made[5_000] < 4 * hits and made[5_000] < made[0] / 5


def test_lookup_conflicts(spark):
    lookup = spark.createDataFrame(
        [(1, "a", "g", "typical"), (1, "a", "h", "typical"), (2, "b", "k", "typical"),
         (2, "c", "k", "atypical"), (3, "d", "m", "typical")],
        "brand_id int, brand_name string, generic_name string, class string",
    )
    assert values(L.lookup_conflicts(lookup), "issue", "subject", "n") == [
        ("generic_with_several_classes", "k", 2), ("id_with_several_generics", "1", 2), ("name_listed_twice", "a", 2),
    ]


def test_reviewers_and_final_code(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "code string")
    b = spark.createDataFrame([("y",), ("z",)], "code string")
    assert values(L.reconcile_lists(a, b), "code", "cal", "os", "matchtotal") == [
        ("x", 1, 0, 1), ("y", 1, 1, 2), ("z", 0, 1, 1),
    ]
    df = spark.createDataFrame([("E00.9", "E00"), ("NA", "E01"), (None, "E02")], "cleansed string, stem string")
    assert [r[0] for r in df.select(K.final_code(df.cleansed, df.stem)).collect()] == ["E00.9", "E01", "E02"]


def test_stem_link(spark):
    dictionary = spark.createDataFrame([("X123.99", "a"), ("X123100", "b"), ("Y1", "c")], "cleansed string, term string")
    stems = spark.createDataFrame([("X123.", 1, "s"), ("Y1", 0, "t")], "readcode string, include int, term string")
    linked = K.link_by_stem(dictionary, stems, "cleansed", "readcode")
    assert values(linked, "cleansed", "term", "readcode", "list_term") == [
        ("X123.99", "a", "X123.", "s"), ("Y1", "c", "Y1", "t"),
    ]
    assert L.included(stems).count() == 1


def test_code_list_issues(spark):
    listed = ["1.23E+14", "12345678901234567", "12345678901234567", "", " ", None, "E00", "12E+3"]
    df = spark.createDataFrame([(c,) for c in listed], "code string")
    assert values(L.code_list_issues(df), "code", "issue", "n") == [
        ("", "blank", 3), ("1.23E+14", "rounded", 1), ("12345678901234567", "duplicate", 2), ("12E+3", "rounded", 1),
    ]
    assert not re.match(r"^[0-9]+$", "1.23E+14")
