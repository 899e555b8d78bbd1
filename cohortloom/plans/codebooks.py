"""From dictionaries and lists to registered code sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortloom.operators.codes import combine_codes, map_codes, search_terms
from cohortloom.sources import codesets
from cohortloom.sources.codesets import as_code_set
from cohortloom.sources.text import read_code_list, read_dictionary, write_code_list


def condition_code_set(
    dictionary: DataFrame,
    legacy_codes: DataFrame,
    concept_codes: DataFrame,
    name: str,
    version: str,
) -> DataFrame:
    """Medical codes found through either of two older code systems."""
    by_legacy = map_codes(dictionary, legacy_codes, "original_code")
    by_concept = map_codes(dictionary, concept_codes, "concept_id")
    found = combine_codes(by_legacy, by_concept, key="medcodeid")
    return as_code_set(found, name, version, "med", "medcodeid", "term")


def drug_code_set(dictionary: DataFrame, terms: list[str], name: str, version: str) -> DataFrame:
    """Product codes whose term or substance mentions one of the names."""
    found = search_terms(dictionary, ["term", "substance"], terms)
    return as_code_set(found, name, version, "prod", "prodcodeid", "term")


def register_list(
    spark: SparkSession,
    path: str,
    sets: str,
    name: str,
    version: str,
    kind: str,
    sep: str = ",",
    column: str | None = None,
    category: str | None = None,
    **options: str,
) -> DataFrame:
    """Read a prepared list, register it as a code set under ``sets``, and fetch it from there."""
    listed = read_code_list(spark, path, sep, column, [category] if category else None, **options)
    codesets.save_code_set(listed, sets, name, version, kind, "code", category)
    return codesets.code_set(codesets.read_code_sets(spark, sets), name, version)


def build_condition_set(
    spark: SparkSession,
    dictionary: str,
    legacy_list: str,
    concept_list: str,
    out: str,
    sets: str,
    name: str,
    version: str,
    sep: str = "\t",
) -> DataFrame:
    """A condition's code set from files: match, write the list to ``out``, register it, fetch it."""
    found = condition_code_set(
        read_dictionary(spark, dictionary, "med", sep),
        read_code_list(spark, legacy_list),
        read_code_list(spark, concept_list),
        name,
        version,
    )
    write_code_list(found.select("code", "category"), out)
    return register_list(spark, out, sets, name, version, "med", column="code", category="category")


def build_drug_set(
    spark: SparkSession,
    dictionary: str,
    terms: list[str],
    out: str,
    sets: str,
    name: str,
    version: str,
    sep: str = "\t",
) -> DataFrame:
    """A drug's code set from a dictionary file: search, write the list to ``out``, register it, fetch it."""
    found = drug_code_set(read_dictionary(spark, dictionary, "prod", sep), terms, name, version)
    write_code_list(found.select("code", "category"), out)
    return register_list(spark, out, sets, name, version, "prod", column="code", category="category")
