"""Building code sets from dictionaries and lists."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from cohortloom.functions.text import mentions
from cohortloom.operators.joins import lookup_join


def search_terms(
    dictionary: DataFrame, columns: Iterable[str], terms: Iterable[str], regex: bool = True
) -> DataFrame:
    """Rows where any of the columns mentions any of the terms, ignoring case."""
    wanted = list(terms)
    found = F.lit(False)
    for column in columns:
        found = found | mentions(F.col(column), wanted, regex)
    return dictionary.where(found)


def map_codes(dictionary: DataFrame, codes: DataFrame, left: str, right: str = "code") -> DataFrame:
    """Dictionary rows whose ``left`` code is in the list; duplicates in the list do not count."""
    wanted = codes.select(F.col(right).alias(left)).where(F.col(left).isNotNull()).distinct()
    return lookup_join(dictionary, wanted, left, "left_semi")


def combine_codes(*matches: DataFrame, key: str) -> DataFrame:
    """Stack matches and keep each code once.

    Rows that share the key come from one dictionary, so the minimum row is
    taken to make the choice independent of order.
    """
    stacked = matches[0]
    for match in matches[1:]:
        stacked = stacked.unionByName(match)
    rest = [c for c in stacked.columns if c != key]
    picked = stacked.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row"))
    return picked.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(stacked.columns)


def link_by_stem(
    dictionary: DataFrame, codes: DataFrame, code_col: str, list_col: str, n: int = 5
) -> DataFrame:
    """List rows joined to dictionary rows whose code starts with the list's stem.

    A list column that the dictionary has too is returned with ``list_`` before its name.
    """
    stemmed = dictionary.withColumn("_stem", F.substring(F.col(code_col), 1, n))
    taken = set(dictionary.columns)
    stems = codes.select(
        *[F.col(f"`{c}`").alias(f"list_{c}" if c in taken else c) for c in codes.columns],
        F.col(list_col).alias("_stem"),
    )
    return lookup_join(stemmed, stems, "_stem").drop("_stem")


def final_code(cleansed: Column, stem: Column) -> Column:
    """Dictionary code if the row was linked, else the reviewer's stem; ``NA`` means unlinked."""
    return F.coalesce(F.when(cleansed != "NA", cleansed), stem)
