"""The driver contract."""

import pytest

import __spark_entry__ as entry_point
from tarnish.catalog.registry import ORACLES, QUERIES
from tarnish.session import drop_staged

SF_DIR = "/root/testdata/sf0.001"


def test_contract(spark):
    names = set(entry_point.queries())
    assert set(entry_point.oracle_sql()) <= names and len(names) > 60
    df = entry_point.entry(spark)
    assert df.columns == ["metric", "dimension", "kind", "family"]
    assert df.count() == 20


#: Costly to plan, and called with the same arguments by tests of their own.
TESTED = ("degrade_", "composite_", "scenario_grid", "change_rate", "severity_profile")


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(TESTED)))
def test_plans(spark, name):
    """Every query can be built, and names its columns once."""
    df = QUERIES[name](spark, SF_DIR)
    assert len(set(df.columns)) == len(df.columns) > 0
    drop_staged(spark)


def test_oracles():
    assert set(ORACLES) <= set(QUERIES)
