"""Every query that has a statement gives exactly the statement's rows."""

from __future__ import annotations

import pytest

from creditloom.plans.catalog import all_queries
from oracles.compare import compare, connect
from oracles.statements import STATEMENTS
from tests.conftest import SF


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_statement_has_a_query():
    assert set(STATEMENTS) <= set(all_queries())


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_query_equals_statement(spark, con, name):
    assert compare(spark, con, SF, all_queries()[name], STATEMENTS[name]) == []
