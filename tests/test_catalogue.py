"""Every query against its SQL on the smallest tables, and the documented row counts."""

from pathlib import Path

import pytest

import check
from __spark_entry__ import entry
from cohortloom.catalogue.oracle import ORACLE
from cohortloom.catalogue.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    return check.connect(FOLDER)


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


@needs_data
@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, db, name):
    ok, note = check.compare(spark, db, FOLDER, name, ORACLE[name])
    assert ok, note


@needs_data
def test_entry(spark):
    assert entry(spark).count() == 5


@needs_data
@pytest.mark.parametrize("name,rows", [
    ("first_diagnosis", 123), ("first_exposure", 37), ("case_cohort", 5), ("control_cohort", 55),
])
def test_documented_counts(spark, name, rows):
    assert QUERIES[name](spark, FOLDER).count() == rows
