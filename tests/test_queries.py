"""Every registered query against its SQL counterpart."""

import oracle
import pytest

import __spark_entry__ as entry_points
from rowmend.plans import catalogue

SMALL = entry_points.SMALL
QUERIES, SQL = entry_points.queries(), catalogue.ORACLES


@pytest.fixture(scope="module")
def db():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, db, name):
    assert oracle.differences(QUERIES[name](spark, SMALL), db, SQL[name]) == []


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(SQL)


def test_entry(spark):
    assert entry_points.entry(spark).count() == spark.read.parquet(f"{SMALL}/orders.parquet").count()


def test_dry_run_is_the_job_on_the_first_rows(spark):
    from rowmend.operators.clean import clean, dry_run
    from rowmend.plans.clean_queries import WHOLE_JOB, events

    table = events(spark, SMALL)
    assert dry_run(table, WHOLE_JOB).collect() == clean(table.limit(500), WHOLE_JOB).collect()
