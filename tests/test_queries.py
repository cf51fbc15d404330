"""Every registered query against its DuckDB text on the smallest tables."""

import os

import pytest
from compare import compare_all

import __spark_entry__ as entry
from chalkline import plans

FOLDER = os.environ.get("CHALKLINE_SF_DIR", "/root/testdata/sf0.001")
# empty at this scale on both sides; compared on larger tables
MAY_BE_EMPTY = {"A14_compare_cohorts", "D1_cooling_down", "E2_mutual_knn", "P1_filter_page"}


@pytest.fixture(scope="module")
def results(spark):
    return {name: problem for name, problem, _ in compare_all(spark, FOLDER, plans.QUERIES, plans.ORACLES)}


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(results, name):
    problem = results[name]
    if name in MAY_BE_EMPTY and problem in ("no rows on either side", "no rows"):
        return
    assert problem is None, problem


def test_entry(spark):
    df = entry.entry(spark)
    assert "cohort_week" in df.columns and df.count() > 0


def test_entry_has_all_queries():
    assert set(plans.QUERIES) <= set(entry.queries())


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_policies_reach_every_document(spark):
    got = plans.QUERIES["N3_policies_all_frameworks"](spark, FOLDER)
    assert got.count() == spark.read.parquet(f"{FOLDER}/orders.parquet").count()
    assert got.select("framework").distinct().count() == 5 and got.where("weakest IS NULL OR last_named IS NULL").isEmpty()
