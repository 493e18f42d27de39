"""Every registered document-format query against its SQL on the smallest tables."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

from foliant import registry
from tests.oracle import actual, expected


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, name):
    got = actual(registry.QUERIES[name](spark, sf))
    assert got == expected(sf, registry.SQL[name])


def test_contract_without_a_session():
    """The driver's contract is importable before Spark runs, and every SQL belongs to a query."""
    code = "import __spark_entry__ as e; assert e.oracle_sql().keys() <= e.queries().keys() and len(e.queries()) > 190"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_language_split_is_linear(spark):
    """A run of 64,000 characters in pieces takes about as long as one of 1,000: nothing is written out again per piece."""
    import time

    from foliant.operators import write

    took = []
    for n in (1_000, 1_000, 64_000):
        runs = spark.createDataFrame([("r", ("word 中文, mixed。 text " * n)[:n])], "run_id string, text string")
        began = time.perf_counter()
        assert write.split_language(runs).selectExpr("sum(length(text))").first()[0] == n
        took.append(time.perf_counter() - began)
    assert took[2] < took[1] + 5
