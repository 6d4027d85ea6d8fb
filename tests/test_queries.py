import pytest

import __spark_entry__ as entry
import meandra.plans.belts  # noqa: F401
import meandra.plans.lines  # noqa: F401
import meandra.plans.more  # noqa: F401
import meandra.plans.reaches  # noqa: F401
import meandra.plans.wider  # noqa: F401
from meandra.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, same):
    same(QUERIES[name], ORACLES[name])


def test_entry_has_rows(spark, sf):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
