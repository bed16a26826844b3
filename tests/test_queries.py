"""Every named query against its checking SQL, on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tamperlens.plans.catalog import CHECKS, QUERIES  # noqa: E402
from tools.check import compare, engine  # noqa: E402

SMALL = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="tables are not there")


@pytest.fixture(scope="module")
def connection():
    return engine(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, connection, name):
    message, _, _ = compare(spark, connection, name, QUERIES[name], CHECKS.get(name), SMALL)
    assert message == ""


def test_entry_has_rows(spark):
    import __spark_entry__ as contract

    frame = contract.entry(spark)
    assert frame.columns == ["target", "total_vulnerabilities", "critical", "high", "medium", "low"]
    assert frame.count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
