"""Every registered query against its SQL on the smallest shared tables."""

from pathlib import Path

import oracle
import pytest

import __spark_entry__ as contract
from rolesieve.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the shared test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(catalog.QUERIES) <= set(QUERIES) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    assert oracle.differences(QUERIES[name](spark, SF), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", ["dedup_first", "rank_stable", "cooldown", "run_medians", "board_probe"])
def test_result_does_not_depend_on_partitions(spark, con, name):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert oracle.differences(QUERIES[name](spark, SF), con, ORACLES[name]) is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and rows
