"""Every query that has an SQL twin gives the twin's rows."""

from __future__ import annotations

import pytest
from twins import same

from sparkloom.plans import catalogue

CASES = {k: (r.queries[k], s) for r in catalogue.REGISTRIES for k, s in r.sql.items()}


@pytest.mark.parametrize("name", sorted(CASES))
def test_twin(spark, sf, name):
    same(spark, sf, *CASES[name])


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
