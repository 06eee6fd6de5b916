"""Every registered query against its SQL, on the smallest tables."""

import pytest
from compare import difference
from conftest import SF

import __spark_entry__ as entry
from tallyhouse.oracles import ORACLES
from tallyhouse.plans.catalogue import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, SF), duck, ORACLES[name]) is None


def test_every_query_but_the_fit_has_sql():
    assert set(QUERIES) - set(ORACLES) == {"fit_forecast"}
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
