"""Versioned code sets, stored as a log of writes.

Each write of a set is a folder of its own, which a marker file commits: one small JSON
file, put in place in one step. The newest marker of a name and version says which folder
holds the set; an empty list has a marker like any other, so it replaces the codes before.
A reader lists the markers once and sees whole sets only.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortloom.functions.text import clean_code
from cohortloom.session import list_names, put_text, read_texts
from cohortloom.sources.tables import TEXT, table

MARKERS = "markers"
CODE_SET = table(kind=TEXT, code=TEXT, category=TEXT, name=TEXT, version=TEXT)


def as_code_set(
    df: DataFrame,
    name: str,
    version: str,
    kind: str,
    code_col: str,
    category_col: str | None = None,
) -> DataFrame:
    """Label codes with set name, version and kind; each code appears once.

    Of several categories for one code the alphabetically first is kept, so the
    result does not depend on row order.
    """
    if kind not in ("med", "prod"):
        raise ValueError(f"kind must be 'med' or 'prod', not {kind!r}")
    category = F.col(category_col) if category_col else F.lit(None)
    return (
        df.select(clean_code(F.col(code_col)).alias("code"), category.cast("string").alias("category"))
        .where(F.col("code").isNotNull())
        .groupBy("code")
        .agg(F.min("category").alias("category"))
        .select(
            F.lit(kind).alias("kind"),
            "code",
            "category",
            F.lit(name).alias("name"),
            F.lit(version).alias("version"),
        )
    )


def save_code_set(
    df: DataFrame,
    path: str,
    name: str,
    version: str,
    kind: str,
    code_col: str,
    category_col: str | None = None,
) -> None:
    """Register a list; saving the same name and version again replaces only that set, by an empty list too."""
    spark = df.sparkSession
    folder = f"data/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    as_code_set(df, name, version, kind, code_col, category_col).write.parquet(f"{path}/{folder}")
    # Until the marker is there no reader sees the folder.
    put_text(spark, f"{path}/{MARKERS}", folder.removeprefix("data/") + ".json", json.dumps({"name": name, "version": version, "folder": folder}))


def committed(spark: SparkSession, path: str) -> dict[tuple[str, str], str]:
    """The folder of each registered name and version: the newest write of each."""
    names = sorted(list_names(spark, f"{path}/{MARKERS}"))
    found = (json.loads(text) for text in read_texts(spark, f"{path}/{MARKERS}", names))
    return {(m["name"], m["version"]): m["folder"] for m in found}


def read_code_sets(spark: SparkSession, path: str) -> DataFrame:
    """All registered sets as they are now; later writes do not change what this reads."""
    folders = sorted(committed(spark, path).values())
    if not folders:
        return spark.createDataFrame([], CODE_SET)
    return spark.read.schema(CODE_SET).parquet(*[f"{path}/{folder}" for folder in folders])


def retire_code_set(spark: SparkSession, path: str, name: str, version: str, kind: str) -> None:
    """Register an empty list in place of a set."""
    save_code_set(spark.createDataFrame([], "code string"), path, name, version, kind, "code")


def all_code_sets(sets: DataFrame, version: str) -> DataFrame:
    """Every set of one version."""
    return sets.where(F.col("version") == version)


def code_set(sets: DataFrame, name: str, version: str) -> DataFrame:
    return all_code_sets(sets, version).where(F.col("name") == name)
