import importlib.util
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_registry():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 50


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["spelling_cascade_counts", "quality_drop_counts", "taxonomy_severity", "sample_stratified", "lattice_long"])
def test_queries_run(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0


def test_core_does_not_need_the_optional_part():
    root = os.path.dirname(importlib.util.find_spec("lekhya").origin)
    for folder in ("functions", "operators", "sources", "plans", "streaming"):
        for f in os.listdir(os.path.join(root, folder)):
            if f.endswith(".py"):
                assert "lekhya.llm" not in open(os.path.join(root, folder, f), encoding="utf-8").read()
