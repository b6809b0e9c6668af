"""Every registered query: its SQL where it has one, and the shape of its plan."""

import os
import re

import pytest

import __spark_entry__ as entry
from compare import compare, duck

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, con, name):
    msg, ok = compare(spark, con, FOLDER, QUERIES[name], ORACLES.get(name))
    assert ok, msg


# Streams and queries that run jobs while they are built have no single plan to look at.
PLANNED = [n for n in QUERIES if not re.match(r"stream_|op\d+_|pipeline$", n)]


@pytest.mark.parametrize("name", PLANNED)
def test_no_pairwise_joins(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_only_what_it_needs_and_searches_once(spark):
    plan = QUERIES["corpus_report"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert plan.count("AKIA[0-9A-Z]{16}") <= 6


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0


def test_names_match():
    assert set(ORACLES) <= set(QUERIES)
