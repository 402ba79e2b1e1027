"""Every registered query against its oracle SQL on the smallest data."""

from __future__ import annotations

import pytest

import __spark_entry__ as registry
from checks.compare import compare, connect
from playlens.plans.queries import REPORTS
from tests.conftest import DATA

#: Every player of the smallest tables has a transaction; `players_without_kind` has rows.
MAY_BE_EMPTY = {"nonpaying_players"}

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are not mounted")


@pytest.fixture(scope="module")
def duck():
    return connect(str(DATA))


def test_every_report_has_an_oracle():
    assert set(REPORTS) == set(registry.oracle_sql()) & set(REPORTS)
    assert set(REPORTS) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_matches_oracle(spark, duck, name):
    problems, rows = compare(
        registry.queries()[name](spark, str(DATA)), duck, registry.oracle_sql()[name]
    )
    assert not problems
    assert rows > 0 or name in MAY_BE_EMPTY


def test_entry(spark):
    assert registry.entry(spark).count() > 0
