"""All named queries against their SQL, and what their plans must (not) contain."""

import os

import pytest

from __spark_entry__ import entry
from oracle import compare, database
from tarnbook.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    physical = df._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython", "InPandas"):
        assert operator not in physical
    assert compare(df, con, ORACLES[name]) is None


def test_entry(spark):
    assert entry(spark).count() > 0


def test_results_do_not_depend_on_partitioning(spark, con):
    for partitions in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            for name in ("site_status_v3", "deduped_identities", "side_by_side"):
                assert compare(QUERIES[name](spark, FOLDER), con, ORACLES[name]) is None
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_results_do_not_depend_on_broadcasts(spark, con):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("site_master", "points_in_polygons", "name_match_best"):
            assert compare(QUERIES[name](spark, FOLDER), con, ORACLES[name]) is None
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
