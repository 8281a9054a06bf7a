from __future__ import annotations

import pytest

from docgrid.plans.queries import ORACLE, QUERIES
from tests.compare import connect, same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    same(QUERIES[name](spark, SF), connect(SF), ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLE) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
