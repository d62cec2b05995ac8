"""Every query of the library against its SQL, and the driver contract."""

import pytest

import __spark_entry__ as contract
from parcelry.plans import load_all
from parcelry.plans.compare import differences
from parcelry.plans.registry import ORACLES, QUERIES

load_all()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    assert differences(spark, sf, QUERIES[name], ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) <= set(contract.queries())


def test_entry_has_one_row_per_slice(spark):
    rows = contract.entry(spark).orderBy("slice").collect()
    assert [r["slice"] for r in rows] == list(range(len(rows)))
    assert sum(r["rows"] for r in rows) == 1500
