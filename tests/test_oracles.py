"""Every query of the library's own operators against its SQL twin, in full."""

from __future__ import annotations

from decimal import Decimal

import pytest

import __spark_entry__ as driver
from cohortlens.plans.oracles import ORACLES
from cohortlens.plans.queries import QUERIES


def comparable(value):
    if isinstance(value, Decimal):
        return float(value)
    return round(value, 9) + 0.0 if isinstance(value, float) else value


def sorted_rows(names, rows, order):
    picked = [tuple(comparable(row[names.index(name)]) for name in order) for row in rows]
    return sorted(picked, key=repr)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


def test_every_query_is_registered():
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_twin(spark, duck, folder, name):
    df = QUERIES[name](spark, folder)
    result = duck.execute(ORACLES[name])
    names = [item[0] for item in result.description]
    order = sorted(names)
    assert sorted(df.columns) == order
    expected = sorted_rows(names, result.fetchall(), order)
    assert sorted_rows(df.columns, [tuple(r) for r in df.collect()], order) == expected


def test_entry(spark):
    assert driver.entry(spark).count() > 0
