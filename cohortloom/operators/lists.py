"""Prefix code lists, product names and list quality checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from cohortloom.functions.text import normal_name, undotted, words
from cohortloom.operators.joins import lookup_join
from cohortloom.session import stage

#: Distinct beginnings of names of one length up to which runs of words are tested for them.
FIRST_WORDS = 5_000


def shortest_headings(prefixes: DataFrame, group: list[str], column: str = "icd10") -> DataFrame:
    """Headings of each group not covered by a shorter one, so an event meets at most one."""
    listed = (
        prefixes.select(*group, undotted(F.col(column)).alias("heading"))
        .where(F.col("heading") != "")
        .distinct()
    )
    cuts = F.sequence(F.lit(1), F.length("heading"))
    parts = (
        listed.select(*group, "heading", F.explode(cuts).alias("n"))
        .where(F.col("n") < F.length("heading"))
        .select(*group, "heading", F.expr("substring(heading, 1, n)").alias("shorter"))
    )
    known = listed.select(*group, F.col("heading").alias("shorter"))
    covered = parts.join(known, group + ["shorter"], "left_semi").select(*group, "heading").distinct()
    return listed.join(covered, group + ["heading"], "left_anti")


def _match_headings(events: DataFrame, headings: DataFrame, code: str, how: str) -> DataFrame:
    """Join events to headings on each heading length that occurs.

    An event becomes one row per length, matched by equality against the list
    after a size check: no range join, and no shuffle of the events.
    """
    # Distinct lengths: a handful of numbers, however long the list.
    lengths = sorted(r[0] for r in headings.select(F.length("heading")).distinct().collect())
    bare = undotted(F.col(code))
    parts = [F.when(F.length(bare) >= n, F.substring(bare, 1, n)) for n in lengths]
    nothing = F.array(F.lit(None).cast("string"))
    parted = events.withColumn("heading", F.explode(F.array(*parts) if parts else nothing))
    return lookup_join(
        parted.where(F.col("heading").isNotNull()), headings, "heading", how
    ).drop("heading")


def prefix_coded_events(
    events: DataFrame, prefixes: DataFrame, code: str, column: str = "icd10"
) -> DataFrame:
    """Events whose code starts with a listed heading, dots ignored; one row per event."""
    headings = stage(shortest_headings(prefixes, [], column), "headings")
    return _match_headings(events, headings, code, "left_semi")


def label_events(
    events: DataFrame, lists: DataFrame, code: str, label: str = "subtype", column: str = "icd10"
) -> DataFrame:
    """Events with every label whose list holds a heading of their code: one row per label."""
    headings = stage(shortest_headings(lists, [label], column), "headings")
    return _match_headings(events, headings, code, "inner")


def classify_products(
    products: DataFrame,
    lookup: DataFrame,
    key: str,
    text: str,
    exclude_generics: Iterable[str] = (),
) -> DataFrame:
    """Brand, generic and class of each product from the names its text contains.

    Names match on whole words. The longest name wins, then the earliest in the
    text, then the first in name, generic and class order. A text's runs that can
    begin a name meet the lookup by equality, and the best run is picked within its
    partition before the one shuffle by key.
    """
    known = product_names(lookup, exclude_generics)
    best = (
        lookup_join(name_runs(products, known, key, text), known, "brand_name")
        .groupBy(key)
        .agg(F.min(F.struct(-F.col("length"), "start", "brand_name", "meaning")).alias("best"))
    )
    return best.select(
        key,
        F.col("best.brand_name").alias("brand_name"),
        F.col("best.meaning.generic_name").alias("generic_name"),
        F.col("best.meaning.class").alias("class"),
    )


def product_names(lookup: DataFrame, exclude_generics: Iterable[str] = ()) -> DataFrame:
    """Each name once as ``brand_name``, with its first generic and class as ``meaning``; stored."""
    names = lookup.select(
        normal_name(F.col("brand_name")).alias("brand_name"), "generic_name", "class"
    ).where(F.col("brand_name") != "")
    excluded = list(exclude_generics)
    if excluded:
        names = names.where(~F.col("generic_name").isin(excluded))
    return stage(
        names.groupBy("brand_name").agg(F.min(F.struct("generic_name", "class")).alias("meaning")), "names"
    )

def name_runs(products: DataFrame, known: DataFrame, key: str, text: str) -> DataFrame:
    """Runs of a text's words that can begin a name: ``key, start, length, brand_name``.

    A run is kept if a name of its number of words begins with its first word, and, of
    names with more words, one begins with its first two. Each such test is a set of at
    most ``FIRST_WORDS`` strings inside the expression that makes the runs; where names
    have more beginnings, the test is left out and the join alone decides.
    """
    split = F.split("brand_name", " ")
    heads = known.select(
        F.size(split).alias("n"), split[0].alias("first"), F.array_join(F.slice(split, 1, 2), " ").alias("two")
    )
    # Numbers of words that names have: a handful, however long the lookup.
    counts = heads.groupBy("n").agg(F.countDistinct("first").alias("firsts"), F.countDistinct("two").alias("twos")).collect()
    sizes = {r.n: r for r in counts}
    few = {c: [n for n, r in sizes.items() if r[f"{c}s"] <= FIRST_WORDS] for c in ("first", "two")}
    held: dict = {(c, n): [] for c, ns in few.items() for n in ns}
    for c, ns in few.items():
        # At most FIRST_WORDS strings of each length.
        for r in heads.where(F.col("n").isin(ns)).select("n", c).distinct().collect() if ns else []:
            held[c, r.n].append(r[c])

    # All runs of a text are made in one expression, so its words are not copied from row to row.
    listed = F.col("words")

    def runs_of(n: int):
        starts = F.when(F.size(listed) >= n, F.sequence(F.lit(0), F.size(listed) - n)).otherwise(
            F.array().cast("array<int>")
        )
        if ("first", n) in held:
            starts = F.filter(starts, lambda s: F.get(listed, s).isin(held["first", n]))
        if n > 1 and ("two", n) in held:
            starts = F.filter(starts, lambda s: F.concat_ws(" ", F.get(listed, s), F.get(listed, s + 1)).isin(held["two", n]))
        return F.transform(
            starts,
            lambda s: F.struct(
                s.alias("start"), F.lit(n).alias("length"), F.array_join(F.slice(listed, s + 1, F.lit(n)), " ").alias("brand_name")
            ),
        )

    nothing = F.array().cast("array<struct<start:int,length:int,brand_name:string>>")
    every = F.concat(nothing, *[runs_of(n) for n in sorted(sizes)])
    worded = products.select(key, words(F.col(text)).alias("words"))
    return worded.select(key, F.explode(every).alias("run")).select(key, "run.*")


def lookup_conflicts(lookup: DataFrame) -> DataFrame:
    """Names listed twice, ids with several generics, generics with several classes."""

    def several(subject: str, count, issue: str) -> DataFrame:
        return (
            lookup.groupBy(F.col(subject).cast("string").alias("subject"))
            .agg(count.alias("n"))
            .where(F.col("n") > 1)
            .select(F.lit(issue).alias("issue"), "subject", "n")
        )

    return (
        several("brand_name", F.count(F.lit(1)), "name_listed_twice")
        .unionByName(several("brand_id", F.countDistinct("generic_name"), "id_with_several_generics"))
        .unionByName(several("generic_name", F.countDistinct("class"), "generic_with_several_classes"))
    )


def reconcile_lists(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("cal", "os")) -> DataFrame:
    """Codes chosen by either reviewer, a 0/1 flag for each, and ``matchtotal``."""
    first, second = names
    tagged = a.select("code", F.lit(1).alias(first), F.lit(0).alias(second)).unionByName(
        b.select("code", F.lit(0).alias(first), F.lit(1).alias(second))
    )
    return (
        tagged.groupBy("code")
        .agg(F.max(first).alias(first), F.max(second).alias(second))
        .withColumn("matchtotal", F.col(first) + F.col(second))
    )


def included(reviewed: DataFrame) -> DataFrame:
    return reviewed.where(F.col("include") == 1)


def code_list_issues(codes: DataFrame, column: str = "code") -> DataFrame:
    """Ids rounded to scientific notation, blank codes, and codes listed more than once."""
    code = F.trim(F.col(column))
    counted = codes.groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n"))
    blank = F.coalesce(F.col("code") == "", F.lit(True))
    issues = F.array_compact(
        F.array(
            F.when(blank, "blank"),
            F.when(F.col("code").rlike(r"^[0-9]+(\.[0-9]+)?[eE]\+[0-9]+$"), "rounded"),
            F.when(~blank & (F.col("n") > 1), "duplicate"),
        )
    )
    return counted.select(
        F.coalesce("code", F.lit("")).alias("code"), "n", F.explode(issues).alias("issue")
    ).groupBy("code", "issue").agg(F.sum("n").alias("n"))
