"""Record tables: explicit schemas and scans.

Codes are text from the first read on; 17-digit ids do not survive a double.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import (
    DataType,
    DateType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

LONG, INT, TEXT, DAY = LongType(), IntegerType(), StringType(), DateType()


def table(**columns: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


PATIENT = table(
    patid=LONG, pracid=INT, acceptable=INT, gender=INT, yob=INT, mob=INT, regenddate=DAY, emis_ddate=DAY
)
OBSERVATION = table(patid=LONG, pracid=INT, medcodeid=TEXT, obsdate=DAY, enterdate=DAY)
DRUG_ISSUE = table(patid=LONG, prodcodeid=TEXT, issuedate=DAY)
PRACTICE = table(pracid=INT, lcd=DAY)


class MissingColumns(ValueError):
    """A record table lacks columns that its readers rely on."""


def _scan(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table under its declared schema; a file that lacks a column is refused, not read as NULL."""
    held = set(spark.read.parquet(path).columns)
    missing = [name for name in schema.names if name not in held]
    if missing:
        raise MissingColumns(f"{path} lacks {', '.join(missing)}")
    return spark.read.schema(schema).parquet(path)


def read_patients(spark: SparkSession, path: str) -> DataFrame:
    return _scan(spark, path, PATIENT)


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    return _scan(spark, path, OBSERVATION)


def read_drug_issues(spark: SparkSession, path: str) -> DataFrame:
    return _scan(spark, path, DRUG_ISSUE)


def read_practices(spark: SparkSession, path: str) -> DataFrame:
    return _scan(spark, path, PRACTICE)
