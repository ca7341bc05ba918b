"""Every registered query with SQL gives the same rows as that SQL; every other one runs."""

import os
import re

import pytest
from oracle import DATA, compare, duck

import __spark_entry__ as entry

FOLDER = f"{DATA}/sf0.001"
# covered on small graphs in test_brute.py; these take up to a minute each
LONG = {"topo_dataset", "topo_tiles", "apls_tiles", "soft_topo", "topo_from_nodes", "topo_from_random_nodes", "label_samples",
        "control_points", "large_graph"}
LLM = {n for n in entry.queries() if re.match(r"op\d+_|pipeline$", n)}  # have tests of their own in tests/llm
if os.environ.get("WAYLOOM_ALL"):
    LONG = set()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - LLM))
def test_same_rows_as_sql(spark, con, name):
    problem, _, _, _ = compare(spark, con, FOLDER, entry.queries()[name], entry.oracle_sql()[name])
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - LONG - LLM))
def test_runs(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    assert df.columns and df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
