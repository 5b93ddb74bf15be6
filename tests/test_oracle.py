"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry

# No such rows exist at the smallest scale; both sides must agree on that.
MAY_BE_EMPTY = {"rule_sar004", "rule_risk001", "hot_customers"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(entry.QUERIES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    difference = compare(entry.queries()[name](spark, sf_dir), duck, entry.oracle_sql()[name])
    assert difference is None or (difference == "EMPTY" and name in MAY_BE_EMPTY), difference


def test_entry_returns_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
